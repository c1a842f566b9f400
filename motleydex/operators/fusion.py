"""Fusing rankings and the searches built on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shown_caption
from ..sources.items import Items, as_items
from ..sources.schema import SearchOptions, SearchRequest
from ..sources.tables import persist_table
from .analysis import QueryAnalyzer, analysed_names
from .fulltext import bm25
from .people import exact_people
from .rerank import OverlapReranker, Reranker, cross_encode
from .vector_search import metadata_filter, rankings

RRF_K = 60


def union_rankings(rankings: list[DataFrame]) -> DataFrame:
    """(list_no, meme_id, pos) of rankings (meme_id, pos) in their order; a ranking given twice counts twice."""
    return reduce(DataFrame.unionByName, [r.select(F.lit(i).alias("list_no"), "meme_id", F.col("pos").cast("int").alias("pos")) for i, r in enumerate(rankings, 1)])


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(meme_id, rrf_score, first_list, first_pos): reciprocal-rank fusion of (list_no, meme_id, pos).

    The order of addition is fixed by summing rounded terms; ties keep the order of first appearance.
    """
    return lists.groupBy("meme_id").agg(F.round(F.sum(1.0 / (k + F.col("pos"))), 12).alias("rrf_score"), F.min(F.struct("list_no", "pos")).alias("_first")).select("meme_id", "rrf_score", F.col("_first.list_no").alias("first_list"), F.col("_first.pos").alias("first_pos"))


def fused_order() -> list[Column]:
    return [F.desc("rrf_score"), F.col("first_list"), F.col("first_pos")]


def fused_search(vectors: dict[str, DataFrame], texts: DataFrame, people: DataFrame, items: Items | DataFrame, query: list[float], text: str, names: list[str], options: SearchOptions) -> DataFrame:
    """The fused hits: items with rrf_score and their place, up to 4 x limit, after the metadata filter.

    Lists in order: exact people twice, the four vector rankings, BM25. Rankings carry ids only, and the vectors of all aspects are read in one
    pass; the at most 4 x limit ids that survive are stored once and broadcast to fetch the items.
    """
    k = max(options.limit * 8, 80)
    place = {a: i for i, a in enumerate(("main", "people", "context", "use_case"), 3)}
    same = {}  # aspects that read the same vectors are scored once
    for a in place:
        same.setdefault(id(vectors[a]), []).append(a)
    near = rankings({group[0]: vectors[group[0]] for group in same.values()}, items, query, k, options.min_similarity)
    numbers = F.create_map(*[x for group in same.values() for x in (F.lit(group[0]), F.array(*[F.lit(place[a]) for a in group]))])
    near = near.select(F.explode(numbers[F.col("aspect")]).alias("list_no"), "meme_id", F.col("pos").cast("int").alias("pos"))
    exact = exact_people(people, names).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("list_no"), "meme_id", F.col("pos").cast("int").alias("pos"))
    words = bm25(texts, text, k).select(F.lit(7).alias("list_no"), "meme_id", F.col("pos").cast("int").alias("pos"))
    top = rrf(exact.unionByName(near).unionByName(words)).orderBy(*fused_order()).limit(options.limit * 4)
    top = persist_table(top.withColumnRenamed("meme_id", "id"), "fused")
    hits = as_items(items).pick(top).join(F.broadcast(top), "id").filter(metadata_filter(options))
    return hits.withColumn("similarity", F.lit(1.0)).withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*fused_order())))


def boosts(options: SearchOptions) -> Column:
    """What language, region and popularity add to a score."""
    language = F.when(F.col("primary_language").eqNullSafe(options.language), 20).otherwise(0) if options.language else F.lit(0)
    region = F.when(F.array_contains("regions", options.region), 15).otherwise(0) if options.region else F.lit(0)
    everywhere = F.when(F.array_contains("regions", "pan_india"), 5).otherwise(0)
    return language + region + everywhere + F.least(F.coalesce("popularity_score", F.lit(0)), F.lit(50)) * 0.2


def rank(hits: DataFrame, options: SearchOptions) -> DataFrame:
    """Adds score and rank: ten times the cross score, or 100 times the fused score where that is null or 0, plus the boosts."""
    cross = F.col("cross_score") if "cross_score" in hits.columns else F.lit(None).cast("double")
    base = F.when(F.coalesce(cross, F.lit(0.0)) == 0, F.coalesce("rrf_score", "similarity") * 100).otherwise(cross * 10)
    scored = hits.withColumn("score", F.round(base + boosts(options), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "pos")))


def response(ranked: DataFrame, limit: int) -> DataFrame:
    """The answer to a search; total_results is counted before the limit."""
    cross = F.col("cross_score") if "cross_score" in ranked.columns else F.lit(None).cast("double")
    return (
        ranked.withColumn("total_results", F.count("*").over(Window.partitionBy(F.lit(0))))
        .filter(F.col("rank") <= limit)
        .select("rank", "id", "image_path", shown_caption().alias("caption"), "primary_language", "emotion", "regions", F.to_json("intent").alias("intent"), "people", F.coalesce("source", F.lit("")).alias("source"), "similarity", "rrf_score", cross.alias("cross_score"), "score", "total_results")
    )


def search(vectors: dict[str, DataFrame], texts: DataFrame, people: DataFrame, items: Items | DataFrame, query: list[float], request: SearchRequest, reranker: Reranker | None = None, names: list[str] | None = None, analyzer: QueryAnalyzer | None = None) -> DataFrame:
    """A whole search: fused with three times the limit, reranked if asked for, ranked, cut. One plan but for the reranker's rows.

    The people's ranking uses ``names``, or those that an ``analyzer`` finds in the query; the live request has neither.
    """
    options = SearchOptions(request.language, request.region, request.emotion, request.limit * 3, 0.30)
    hits = fused_search(vectors, texts, people, items, query, request.query, names or analysed_names(request.query, analyzer), options)
    if request.rerank:
        hits = cross_encode(hits, request.query, 15, reranker or OverlapReranker())
    return response(rank(hits, options), request.limit)
