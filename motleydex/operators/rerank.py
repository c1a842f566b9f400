"""Reranking the first candidates by a pluggable scorer."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import description
from .fulltext import query_terms

MOST_CANDIDATES = 15
LEAST_SCORE = 2.0


class Reranker(Protocol):
    """Scores a description against a query from 0 to 10; raises or gives None on failure."""

    def score(self, query: str, description: str) -> float | None: ...


class OverlapReranker:
    """A deterministic stand-in: ten times the share of the query's terms that the description holds."""

    def score(self, query: str, description: str) -> float | None:
        wanted = set(query_terms(query))
        return 10.0 * len(wanted & set(query_terms(description))) / len(wanted) if wanted else 0.0


class FailingReranker:
    """Always fails; for the failure path."""

    def score(self, query: str, description: str) -> float | None:
        raise RuntimeError("no model")


def cross_encode(hits: DataFrame, query: str, top_k: int, reranker: Reranker) -> DataFrame:
    """Adds cross_score to fused hits and keeps those of at least 2.

    The first min(top_k, 15) are scored; if that fails, by 100 times the fused score; the
    rest by 50 times the fused score. Scored rows number at most 15, so the scorer runs in one Arrow batch.
    """
    most = min(top_k, MOST_CANDIDATES)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        def one(text: str) -> float | None:
            try:
                s = reranker.score(query, text)
                return None if s is None or not 0 <= s <= 10 else float(s)
            except Exception:
                return None

        return texts.map(one).astype("float64")

    first = hits.filter(F.col("pos") <= most).withColumn("cross_score", F.coalesce(F.nanvl(scored(description()), F.lit(None).cast("double")), F.col("rrf_score") * 100))
    rest = hits.filter(F.col("pos") > most).withColumn("cross_score", F.col("rrf_score") * 50)
    kept = first.unionByName(rest).filter(F.coalesce("cross_score", F.lit(0.0)) >= LEAST_SCORE)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("cross_score", 9)), "pos")))
