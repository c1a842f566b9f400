"""Nearest vectors, exact: one query as a plan inside the JVM, many queries as matrix products with local top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.items import Items, as_items
from ..sources.schema import SearchOptions
from ..sources.tables import ship

MOST_QUERIES = 10_000


def as_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(meme_id, similarity): the k nearest vectors; ties go to the smaller id. No vector is shuffled.

    If there is a ``created_at``, an id may have several vectors and the latest counts (null is the oldest): all are
    scored where they are read and only (id, time, similarity) is moved to choose among them.
    """
    similarity = cosine(F.col("embedding"), as_vector(query)).alias("similarity")
    if "created_at" in vectors.columns:
        scored = vectors.select("meme_id", F.struct("created_at", similarity).alias("v")).groupBy("meme_id").agg(F.max("v").alias("v")).select("meme_id", "v.similarity")
    else:
        scored = vectors.select("meme_id", similarity)
    return scored.orderBy(F.desc("similarity"), "meme_id").limit(k)


def rankings(vectors: dict[str, DataFrame], items: Items | DataFrame, query: list[float], k: int, min_similarity: float) -> DataFrame:
    """(aspect, meme_id, similarity, pos): search_aspect() for several aspects in one pass over their vectors.

    Of each aspect the k nearest are found per task before anything is shuffled for the ranking; the ids of all are looked up together.
    """
    similarity = cosine(F.col("embedding"), as_vector(query)).alias("similarity")
    one = [v.select(F.lit(a).alias("aspect"), "meme_id", *(["created_at"] if "created_at" in v.columns else [F.lit(None).cast("timestamp_ntz").alias("created_at")]), similarity) for a, v in vectors.items()]
    scored = reduce(DataFrame.unionByName, one).groupBy("aspect", "meme_id").agg(F.max(F.struct("created_at", "similarity")).alias("v")).select("aspect", "meme_id", "v.similarity")
    order = Window.partitionBy("aspect").orderBy(F.desc("similarity"), "meme_id")
    top = scored.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
    known = as_items(items).known(top.select(F.col("meme_id").alias("id"))).select(F.col("id").alias("meme_id"))
    kept = top.join(F.broadcast(known), "meme_id", "left_semi").filter(F.col("similarity") >= min_similarity)  # at most k rows an aspect
    return kept.withColumn("pos", F.row_number().over(order))


def search_aspect(vectors: DataFrame, items: Items | DataFrame, query: list[float], k: int, min_similarity: float) -> DataFrame:
    """(meme_id, similarity, pos): the k nearest vectors first, then those with an item and at least the similarity, by rank.

    The order of steps is the meaning: an orphan or a distant vector uses up one of the k places.
    """
    top = nearest(vectors, query, k)
    known = as_items(items).known(top.select(F.col("meme_id").alias("id"))).select(F.col("id").alias("meme_id"))
    kept = top.join(F.broadcast(known), "meme_id", "left_semi").filter(F.col("similarity") >= min_similarity)
    return ranked(kept)


def ranked(df: DataFrame, key: str = "similarity") -> DataFrame:
    """Adds the position, from 1. The frame holds at most k rows, so one task is enough."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(key), "meme_id")))


def metadata_filter(options: SearchOptions) -> Column:
    """The filter on language, region and emotion; a region also passes by the wildcard pan_india."""
    cond = F.lit(True)
    if options.language:
        cond &= F.array_contains("supported_languages", options.language) | F.col("primary_language").eqNullSafe(options.language)
    if options.region:
        cond &= F.array_contains("regions", options.region) | F.array_contains("regions", "pan_india")
    if options.emotion:
        cond &= F.array_contains("emotion", options.emotion)
    return cond


def search(vectors: DataFrame, items: Items | DataFrame, query: list[float], options: SearchOptions) -> DataFrame:
    """Single-vector search: the 5 x limit nearest, joined to items, filtered, then the first ``limit``."""
    top = nearest(vectors, query, options.limit * 5)
    top = top.withColumnRenamed("meme_id", "id")
    hits = as_items(items).pick(top).join(F.broadcast(top), "id").filter(metadata_filter(options)).filter(F.col("similarity") >= options.min_similarity)
    return hits.orderBy(F.desc("similarity"), "id").limit(options.limit)


def nearest_for_queries(vectors: DataFrame, queries: DataFrame, k: int | str) -> DataFrame:
    """(query_id, meme_id, similarity, pos): the k nearest vectors of each query (query_id, vector[, k]).

    The queries are broadcast in blocks of ``MOST_QUERIES``, each a pass over the vectors; each task multiplies its
    batches of vectors with them and keeps its best k per query (similarities that agree in 12 digits are ties), so what is shuffled does not
    grow with the vectors but with tasks x queries x k.
    """
    ship(vectors.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in queries.schema}["query_id"]
    blocks, rows = [], []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == MOST_QUERIES:
            blocks.append(_nearest_for_block(vectors, rows, kind, k))
            rows = []
    if rows or not blocks:
        blocks.append(_nearest_for_block(vectors, rows, kind, k))
    return reduce(DataFrame.unionByName, blocks)


def _nearest_for_block(vectors: DataFrame, rows: list, kind: str, k: int | str) -> DataFrame:
    """nearest_for_queries() for one block of queries."""
    spark = vectors.sparkSession
    ids = [r["query_id"] for r in rows]
    most = [int(r[k]) if isinstance(k, str) else k for r in rows]
    matrix = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["vector"]) if rows else 0)
    norms = np.linalg.norm(matrix, axis=1)
    shared = spark.sparkContext.broadcast((ids, most, matrix, norms))

    def local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, kk, q, qn = shared.value
        n_queries = len(qids)
        if not n_queries:
            return
        kept = np.array(kk)
        bar = np.full(n_queries, -np.inf)  # the similarity that a vector must reach to be among a query's best so far
        at, name, sim = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        for b in batches:
            names = np.array(b.column("meme_id").to_pylist(), dtype=object)
            if not len(names):
                continue
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
            norm = np.linalg.norm(v, axis=1)
            rows = max(1, 4_000_000 // n_queries)
            for lo in range(0, len(names), rows):
                size = norm[lo : lo + rows, None] * qn[None, :]
                sims = np.round(np.divide(v[lo : lo + rows] @ q.T, size, out=np.zeros_like(size), where=size > 0), 12)
                i, j = np.nonzero(sims >= bar)
                at, name, sim = np.concatenate([at, j]), np.concatenate([name, names[lo + i]]), np.concatenate([sim, sims[i, j]])
                order = np.lexsort((name.astype(str), -sim, at))
                at, name, sim = at[order], name[order], sim[order]
                place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
                last = place == kept[at] - 1
                bar[at[last]] = sim[last]
                best = place < kept[at]
                at, name, sim = at[best], name[best], sim[best]
        yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in at.tolist()], pa.string() if kind == "string" else pa.int64()), pa.array(name.tolist(), pa.string()), pa.array(sim, pa.float64())], ["query_id", "meme_id", "similarity"])

    met = vectors.select("meme_id", "embedding").mapInArrow(local_best, f"query_id {'string' if kind == 'string' else 'long'}, meme_id string, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "meme_id")
    out = met.withColumn("pos", F.row_number().over(w))
    if isinstance(k, str):
        limits = spark.createDataFrame(list(zip(ids, most)), f"query_id {'string' if kind == 'string' else 'long'}, _k int")
        return out.join(F.broadcast(limits), "query_id").filter(F.col("pos") <= F.col("_k")).drop("_k")
    return out.filter(F.col("pos") <= (max(most) if most else 0))


def batch_search(vectors: DataFrame, items: Items | DataFrame, queries: DataFrame, limit: int = 5, min_similarity: float = 0.35) -> DataFrame:
    """Single-vector search for many queries (query_id, vector[, language, region]) in one plan.

    Per query: 10 x limit nearest, items joined, filters, at most 2 x limit, boosts, the best ``limit``.
    """
    top = nearest_for_queries(vectors, queries, limit * 10)
    options = queries.select("query_id", *[F.col(c) if c in queries.columns else F.lit(None).cast("string").alias(c) for c in ("language", "region")])
    top = top.withColumnRenamed("meme_id", "id")
    hits = top.join(as_items(items).among(top), "id").join(options, "query_id")
    lang = F.col("language").isNull() | (F.col("language") == "") | F.array_contains("supported_languages", F.col("language")) | F.col("primary_language").eqNullSafe(F.col("language"))
    region = F.col("region").isNull() | (F.col("region") == "") | F.array_contains("regions", F.col("region")) | F.array_contains("regions", "pan_india")
    kept = hits.filter(lang & region & (F.col("similarity") >= min_similarity))
    w = Window.partitionBy("query_id")
    first = kept.withColumn("_n", F.row_number().over(w.orderBy("pos"))).filter(F.col("_n") <= 2 * limit)
    score = F.when(F.col("similarity") == 0, 0.0).otherwise(F.col("similarity") * 100)
    score += F.when(F.col("primary_language").eqNullSafe(F.col("language")) & F.col("language").isNotNull(), 20).otherwise(0)
    score += F.when(F.coalesce(F.array_contains("regions", F.col("region")), F.lit(False)), 15).otherwise(0)
    score += F.when(F.array_contains("regions", "pan_india"), 5).otherwise(0) + F.least(F.coalesce("popularity_score", F.lit(0)), F.lit(50)) * 0.2
    best = first.withColumn("score", score).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "pos")))
    return best.filter(F.col("rank") <= limit).select("query_id", "rank", "id", "image_path", "caption", "similarity", "score")
