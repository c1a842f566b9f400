"""Finding and filling missing vectors."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context_text, people_text, use_case_text
from ..sources.schema import ASPECTS

MODEL = "hash-embedder-1"


class Embedder(Protocol):
    """Gives one vector per text."""

    model: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A deterministic stand-in: words and their letter triples, hashed with signs, to unit length."""

    model = MODEL

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                for g in [w, *(f"#{w}#"[i : i + 3] for i in range(len(w)))]:
                    h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                    out[row, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class LetterEmbedder:
    """A deterministic stand-in that SQL can repeat: how often each letter a to z and digit stands in a text, to unit length."""

    model = "letter-embedder-1"
    dim = 36

    def embed(self, texts: list[str]) -> np.ndarray:
        signs = "abcdefghijklmnopqrstuvwxyz0123456789"
        out = np.array([[t.count(c) + (t.count(c.upper()) if c.isalpha() else 0) for c in signs] for t in (x or "" for x in texts)], np.float64).reshape(len(texts), self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def missing_aspects(items: DataFrame, vectors: dict[str, DataFrame]) -> DataFrame:
    """(id, missing): items without a vector in at least one aspect, with those aspects.

    By presence only: a changed text is not noticed. Ids are compared as NOT EXISTS does, so a
    null id among the vectors changes nothing. One pass: presence is gathered per id, then joined once.
    """
    seen = None
    for aspect, v in vectors.items():
        one = v.filter("meme_id is not null").select("meme_id", F.lit(aspect).alias("aspect"))
        seen = one if seen is None else seen.unionByName(one)
    have = seen.groupBy("meme_id").agg(F.collect_set("aspect").alias("have"))  # at most four values
    everything = F.array(*[F.lit(a) for a in vectors])
    left = items.select("id").join(have, F.col("id") == F.col("meme_id"), "left")
    return left.select("id", F.array_except(everything, F.coalesce("have", F.expr("cast(array() as array<string>)"))).alias("missing")).filter(F.size("missing") > 0)


def texts_to_search(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Items that have no search text yet."""
    return items.join(texts.select(F.col("meme_id").alias("id")), "id", "left_anti")


def aspect_texts(items: DataFrame, missing: DataFrame) -> DataFrame:
    """(id, aspect, text): the text to embed for each missing aspect."""
    text = {"main": F.col("multilingual_embedding_text"), "people": people_text(), "context": context_text(), "use_case": use_case_text()}
    return items.join(missing, "id").select("id", F.explode("missing").alias("aspect"), F.create_map(*[x for a in ASPECTS for x in (F.lit(a), text[a])]).alias("_t")).select("id", "aspect", F.col("_t")[F.col("aspect")].alias("text"))


def embedded(texts: DataFrame, embedder: Embedder, tasks: int | None = None) -> DataFrame:
    """Adds ``embedding`` and ``model``; ``tasks`` bounds how many calls run at once."""

    @F.pandas_udf("array<float>")
    def vector(col: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed(col.fillna("").tolist()).astype(np.float32)))

    df = texts.repartition(tasks) if tasks else texts
    return df.withColumn("embedding", vector("text")).withColumn("model", F.lit(embedder.model))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(meme_id, aspect, embedding, model, created_at): the latest vector per id and aspect; new ones win over equal times."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("meme_id", "aspect").orderBy(F.desc_nulls_last("created_at"), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def embed_missing(items: DataFrame, vectors: dict[str, DataFrame], embedder: Embedder, tasks: int | None = None) -> DataFrame:
    """(meme_id, aspect, embedding, model, created_at): vectors for all that is missing; append them with upsert_vectors."""
    made = embedded(aspect_texts(items, missing_aspects(items, vectors)), embedder, tasks)
    return made.select(F.col("id").alias("meme_id"), "aspect", "embedding", "model", F.current_timestamp().cast("timestamp_ntz").alias("created_at"))


def embed_result(missing: DataFrame) -> DataFrame:
    """(embedded): how many items had something missing."""
    return missing.agg(F.count_if(F.size("missing") > 0).alias("embedded"))


def label_cache(labels: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, embedding) for every row of a label file; a blank text is an error that names the id."""
    text = F.trim(F.coalesce("multilingual_embedding_text", F.lit("")))
    checked = labels.select("id", F.when(text != "", text).otherwise(F.raise_error(F.concat(F.lit("Missing multilingual_embedding_text for id "), F.coalesce("id", F.lit("null"))))).alias("text"))
    return embedded(checked, embedder).select("id", "embedding")
