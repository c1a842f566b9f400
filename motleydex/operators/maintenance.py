"""Statistics, export, filters, inserts, migration and reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_text
from ..sources.items import parsed
from ..sources.schema import NESTED


def vector_stats(vectors: dict[str, DataFrame], dim: int = 3072) -> DataFrame:
    """One row: vectors per aspect, and the memory of the main ones. One pass over the union, counted before the shuffle."""
    rows = None
    for aspect, v in vectors.items():
        one = v.select(F.lit(aspect).alias("aspect"))
        rows = one if rows is None else rows.unionByName(one)
    n = {a: F.count_if(F.col("aspect") == a) for a in vectors}
    return rows.agg(
        n["main"].alias("total_embeddings"),
        *[n[a].alias(f"embeddings_{a}") for a in vectors if a != "main"],
        (n["main"] * dim * 4 / (1024 * 1024)).alias("memory_mb"),
        F.lit(True).alias("ready"),
    )


def stats(vectors: dict[str, DataFrame], items: DataFrame, people: DataFrame, texts: DataFrame, dim: int = 3072) -> DataFrame:
    """One row: vector_stats, items, items counted as labelled (by their main vectors), items with people, search texts."""
    one = vector_stats(vectors, dim)
    for other in (items.agg(F.count("*").alias("total_memes")), people.agg(F.count_distinct("meme_id").alias("memes_with_people_index")), texts.agg(F.count("*").alias("fts_documents"))):
        one = one.join(F.broadcast(other))  # single rows
    return one.withColumn("total_labeled", F.col("total_embeddings"))


def like_prefix(prefix: str) -> Column:
    """image_path LIKE prefix%: without regard to case, % and _ in the prefix are wildcards."""
    return F.ilike("image_path", F.lit(prefix + "%"), F.lit("\x01"))


EXPORTED = ("id", "image_path", "primary_language", "supported_languages", "caption", "meaning", "tags", "query_examples", "emotion", "intent", "regions", "safety", "quality", "multilingual_embedding_text", "labeled_at", "reviewed")


def export_labels(items: DataFrame, path_prefix: str | None = None) -> DataFrame:
    """The rows of a label file from stored items (JSON text): labelled ones, of a path prefix if given.

    Only a missing list of languages becomes the empty list; other missing or unreadable values are null.
    """
    rows = items.filter(F.col("labeled_at").isNotNull())
    if path_prefix and path_prefix.strip():
        rows = rows.filter(like_prefix(path_prefix.strip()))

    def value(c: str) -> Column:
        if c not in NESTED:
            return F.coalesce(F.col(c), F.lit(False)) if c == "reviewed" else F.col(c)
        given = F.when(F.col(c) != "", parsed(c) if c == "intent" else F.from_json(c, NESTED[c]))  # the literal null stays null
        return F.when(F.col(c).isNull() | (F.col(c) == ""), F.expr("cast(array() as array<string>)")).otherwise(given) if c == "supported_languages" else given

    return rows.select(*[value(c).alias(c) for c in EXPORTED])


def filter_labels(labels: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of a label file by one key; unknown keys and empty values do not filter. nsfw keeps true whatever the value."""
    if not key or not value:
        return labels
    has = lambda c: F.coalesce(F.array_contains(c, value), F.lit(False))
    conditions = {"language": F.col("primary_language") == value, "emotion": has("emotion"), "region": has("regions"), "reviewed": F.col("reviewed") == F.lit(value == "true"), "nsfw": F.col("safety.nsfw") == F.lit(True)}
    return labels.filter(conditions[key]) if key in conditions else labels


def insert_items(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): new items whose id is not stored and stands once among the new; the others, reported."""
    repeated = new.groupBy("id").count().filter("count > 1").select("id")
    taken = new.select("id").join(stored.select("id"), "id", "left_semi").unionByName(repeated).distinct()
    return new.join(taken, "id", "left_anti"), new.join(taken, "id", "left_semi")


ADDED = {"ocr_text": "", "image_description": "", "people": "[]", "source": "", "cultural_references": "[]", "scene_description": ""}


def migrate_items(items: DataFrame) -> DataFrame:
    """The table with the six later columns; those it has stay as they are."""
    return items.withColumns({c: F.lit(d) for c, d in ADDED.items() if c not in items.columns})


def build_search_texts(items: DataFrame, backfill: bool = False) -> DataFrame:
    """(meme_id, search_text) of parsed items, with ``labeled_at`` if they are versions."""
    version = ["labeled_at"] if "labeled_at" in items.columns else []
    return items.select(F.col("id").alias("meme_id"), search_text(backfill).alias("search_text"), *version)


TABLES = {"items": "ITEMS", "vectors": "VECTORS", "people": "PEOPLE", "search_texts": "SEARCH_TEXTS"}


def create_tables(spark: SparkSession, root: str) -> list[str]:
    """Writes an empty table of each schema under ``root`` where none is; returns the names of those written.

    A table is made only where the path does not exist; one that cannot be read is an error and stays as it is.
    """
    from ..sources import schema
    from ..sources.tables import exists

    made = []
    for name, kind in TABLES.items():
        path = f"{root}/{name}.parquet"
        if not exists(spark, path):
            spark.createDataFrame([], getattr(schema, kind)).write.mode("errorifexists").parquet(path)
            made.append(name)
    return made


def reset_tables(spark: SparkSession, root: str) -> None:
    """Empties all tables under ``root``, keeping their schemas; dependants first."""
    from ..sources import schema

    for name in ("search_texts", "people", "vectors", "items"):
        spark.createDataFrame([], getattr(schema, TABLES[name])).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
