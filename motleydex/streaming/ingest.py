"""Incremental filling of missing vectors as a stream that takes what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.embed_job import Embedder, aspect_texts, embedded, missing_aspects
from ..sources.items import live_rows, parsed
from ..sources.schema import ASPECTS, ITEM_COLUMNS, ITEMS, NESTED, VECTORS
from ..sources.tables import exists


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored vectors; only a path that does not exist counts as none, any other failure is an error."""
    return spark.read.schema(VECTORS).parquet(path) if exists(spark, path) else spark.createDataFrame([], VECTORS)


def fill_vectors(spark: SparkSession, items_path: str, vectors_path: str, checkpoint: str, embedder: Embedder, files_per_batch: int = 100) -> StreamingQuery:
    """Embeds what new item files lack, batch by batch, and appends it to the table of vectors.

    Files are taken once (checkpoint); within a batch only aspects without a vector are made, so a batch that is
    run again after a failure adds nothing twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        live = live_rows(rows, list(ITEM_COLUMNS))
        items = live.withColumns({c: parsed(c) for c in NESTED})
        have = read_vectors(spark, vectors_path)
        todo = missing_aspects(items, {a: have.filter(F.col("aspect") == a) for a in ASPECTS})
        made = embedded(aspect_texts(items, todo), embedder)
        made.select("aspect", F.col("id").alias("meme_id"), "embedding", "model", F.current_timestamp().cast("timestamp_ntz").alias("created_at")).write.mode("append").partitionBy("aspect").parquet(vectors_path)

    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files_per_batch).parquet(items_path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(events: DataFrame, key: str, time: str, gap: str = "400 milliseconds") -> DataFrame:
    """Of a burst of events only the last: those after which ``gap`` passes without another of the same key. For batches."""
    from pyspark.sql import Window

    ties = [c for c in events.columns if c not in (key, time)]
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, *ties))
    return events.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") > F.col(time) + F.expr(f"interval {gap}"))).drop("_next")
