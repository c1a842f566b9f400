"""The index of people: building it, and looking names up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_person


def index_people(items: DataFrame) -> DataFrame:
    """(person_name, meme_id), each pair once, from parsed items (id, people)."""
    each = items.select(F.explode("people").alias("p"), F.col("id").alias("meme_id"))
    return each.select(normalise_person(F.col("p")).alias("person_name"), "meme_id").distinct()


def add_people(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the pairs that it does not have yet."""
    return index.select("person_name", "meme_id").unionByName(new.select("person_name", "meme_id")).distinct()


def exact_people(index: DataFrame, names: list[str], per_name: int = 50) -> DataFrame:
    """(meme_id, pos): items whose indexed name contains one of the names, at most ``per_name`` rows a name.

    Names keep their order, items within a name are in the order of (name, id); an item counts
    once, where it stands first. A name that is empty after normalisation matches everyone.
    """
    spark = index.sparkSession
    if not names:
        return spark.createDataFrame([], "meme_id string, pos int")
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, raw string").select("ord", normalise_person(F.col("raw")).alias("wanted"))
    # the handful of names asked for is the broadcast side; the index is scanned once
    hits = index.join(F.broadcast(asked), F.contains("person_name", "wanted"))
    some = hits.withColumn("_n", F.row_number().over(Window.partitionBy("ord").orderBy("person_name", "meme_id"))).filter(F.col("_n") <= per_name)
    first = some.groupBy("meme_id").agg(F.min(F.struct("ord", "_n")).alias("at"))
    return first.select("meme_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at.ord", "at._n", "meme_id")).alias("pos"))
