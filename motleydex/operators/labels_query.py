"""Nearest entries of an embedding cache, with the labels' fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_search import nearest


def label_hits(cache: DataFrame, labels: DataFrame, query: list[float], top_k: int = 5) -> DataFrame:
    """(id, similarity, image_path, caption_original): the nearest entries; ids without a label keep their place.

    Of labels with the same id the last in the file counts; a table has no such order, there the greatest path counts.
    """
    top = nearest(cache, query, top_k)
    last = labels.join(F.broadcast(top.select(F.col("meme_id").alias("id")).distinct()), "id", "left_semi").groupBy("id").agg(F.max(F.struct("image_path", F.col("caption.original").alias("o"))).alias("v"))
    return top.join(F.broadcast(last), top["meme_id"] == last["id"], "left").select(F.col("meme_id").alias("id"), "similarity", F.col("v.image_path").alias("image_path"), F.col("v.o").alias("caption_original")).orderBy(F.desc("similarity"), "id")
