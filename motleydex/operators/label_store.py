"""Storing labels, and the pipeline from a folder of images to vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schema
from ..sources.files import image_files
from ..sources.items import parsed
from .embed_job import Embedder, embed_missing
from .labels import Labeler, label_images, outcome
from .maintenance import build_search_texts, create_tables, insert_items
from .people import index_people

PLAIN_FIELDS = ("primary_language", "multilingual_embedding_text", "ocr_text", "image_description", "source", "scene_description")


def stored_items(labelled: DataFrame) -> DataFrame:
    """Item rows from (path, label): nested values stay JSON text; the label's own id is the key."""
    get = lambda k: F.coalesce(F.get_json_object("label", f"$.{k}"), F.lit(""))
    value = {"id": F.get_json_object("label", "$.id"), "image_path": F.col("path"), "popularity_score": F.lit(0), "labeled_at": F.current_timestamp().cast("timestamp_ntz"), "reviewed": F.lit(False)}
    return labelled.filter("label is not null").select(*[value.get(c, get(c)).alias(c) for c in schema.ITEM_COLUMNS])


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stored tables under ``root``, created empty where missing."""
    create_tables(spark, root)
    kinds = {"items": schema.ITEMS, "vectors": schema.VECTORS, "people": schema.PEOPLE, "search_texts": schema.SEARCH_TEXTS}
    return {n: spark.read.schema(k).parquet(f"{root}/{n}.parquet") for n, k in kinds.items()}


def save_labels(spark: SparkSession, root: str, labelled: DataFrame) -> DataFrame:
    """Appends labelled items, their people and their search texts; returns the rejected rows (id taken or given twice)."""
    have = tables(spark, root)
    new = stored_items(labelled)
    accepted, rejected = insert_items(have["items"], new)
    path = f"{root}/items.parquet"
    accepted.write.mode("append").parquet(path)
    added = spark.read.schema(schema.ITEMS).parquet(path).join(new.select("id").distinct(), "id", "left_semi")
    items = added.withColumns({c: parsed(c) for c in schema.NESTED})
    people = index_people(items).join(have["people"], ["person_name", "meme_id"], "left_anti")
    people.select("person_name", "meme_id").write.mode("append").parquet(f"{root}/people.parquet")
    texts = build_search_texts(items.drop("labeled_at")).join(have["search_texts"].select("meme_id"), "meme_id", "left_anti")
    texts.write.mode("append").parquet(f"{root}/search_texts.parquet")
    return rejected


def label_folder(spark: SparkSession, root: str, folder: str, labeler: Labeler, limit: int | None = None) -> dict[str, int]:
    """Labels a folder's images in natural order of names and stores the labels: total, succeeded, failed."""
    from ..sources.tables import persist_table

    labelled = persist_table(label_images(image_files(spark, folder, limit), labeler), "labels")
    save_labels(spark, root, labelled)
    return {k: int(v) for k, v in outcome(labelled).first().asDict().items()}


def embed_items(spark: SparkSession, root: str, embedder: Embedder, tasks: int | None = None) -> dict[str, int]:
    """Fills the missing vectors of stored items: how many items got some."""
    from ..sources.tables import persist_table

    have = tables(spark, root)
    vectors = {a: have["vectors"].filter(F.col("aspect") == a) for a in schema.ASPECTS}
    items = have["items"].withColumns({c: parsed(c) for c in schema.NESTED})
    made = persist_table(embed_missing(items, vectors, embedder, tasks), "vectors")
    made.select("aspect", "meme_id", "embedding", "model", "created_at").write.mode("append").parquet(f"{root}/vectors.parquet")
    return {"embedded": made.select("meme_id").distinct().count()}


def pipeline(spark: SparkSession, root: str, folder: str, labeler: Labeler, embedder: Embedder, tasks: int | None = None) -> dict[str, object]:
    """label_folder, then embed_items."""
    return {"label": label_folder(spark, root, folder, labeler), "embed": embed_items(spark, root, embedder, tasks)}


def reload(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stored tables read anew, after files changed underneath."""
    for n in ("items", "vectors", "people", "search_texts"):
        spark.catalog.refreshByPath(f"{root}/{n}.parquet")
    return tables(spark, root)
