"""Measuring retrieval: which items are found by their own example queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .embed_job import Embedder, embedded
from .vector_search import nearest_for_queries

LANGS = ("english", "hindi", "hinglish")


def golden_cases(items: DataFrame) -> DataFrame:
    """(id, lang, query): every example query that is not blank, trimmed."""
    per = F.array(*[F.struct(F.lit(x).alias("lang"), F.col(f"query_examples.{x}").alias("qs")) for x in LANGS])
    rows = items.select("id", F.explode(per).alias("p")).select("id", "p.lang", F.posexplode("p.qs").alias("at", "q"))
    return rows.select("id", "lang", "at", trimmed(F.col("q")).alias("query")).filter("query <> ''")


def crosslingual_cases(items: DataFrame) -> DataFrame:
    """(id, theme, english, hindi, hinglish): the first example of each language, for items that have all three."""
    first = {x: F.get(F.filter(F.transform(F.col(f"query_examples.{x}"), trimmed), lambda q: q != ""), F.lit(0)) for x in LANGS}
    return items.select("id", F.coalesce("image_path", "id").alias("theme"), *[c.alias(x) for x, c in first.items()]).na.drop(subset=list(LANGS))


def hits(cases: DataFrame, vectors: DataFrame, embedder: Embedder, k: int) -> DataFrame:
    """(case_id, id, lang, hit_rank): at which place, if at all, each case finds its own item among the k nearest.

    Equal queries are embedded and searched once.
    """
    texts = cases.select("query").distinct().select(F.sha2("query", 256).alias("query_id"), F.col("query").alias("text"))
    queries = embedded(texts, embedder).select("query_id", F.col("embedding").alias("vector"))
    found = nearest_for_queries(vectors, queries, k)
    keyed = cases.withColumn("query_id", F.sha2("query", 256))
    return keyed.join(found.select("query_id", F.col("meme_id").alias("id"), F.col("pos").alias("hit_rank")), ["query_id", "id"], "left")


def recall(ranked: DataFrame, k: int, by: str = "lang") -> DataFrame:
    """(by, cases, found, recall) of hits within k."""
    found = F.count_if(F.col("hit_rank") <= k)
    return ranked.groupBy(by).agg(F.count("*").alias("cases"), found.alias("found"), (found / F.count("*")).alias("recall"))


def failures(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("hit_rank").isNull() | (F.col("hit_rank") > k))


def check_hits(similarities: np.ndarray, expected: int) -> bool:
    """Whether a result has as many hits as expected and similarities are cosines."""
    return len(similarities) == expected and bool(np.all((similarities >= -1.01) & (similarities <= 1.01)))
