"""From the stored tables to the model: live items with parsed fields, latest vectors, the people index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import ASPECTS, NESTED
from .tables import table

EMPTY_LIST = "cast(array() as array<string>)"


def string_list(column: str) -> Column:
    """A JSON list as an array; null, the literal null, other JSON and unreadable text give the empty array."""
    return F.coalesce(F.from_json(F.col(column), "array<string>"), F.expr(EMPTY_LIST))


def list_or_single(column: str) -> Column:
    """A JSON list, or a single JSON string as a list of one."""
    single = F.get_json_object(F.concat(F.lit('{"v":'), F.col(column), F.lit("}")), "$.v")
    return F.when(F.trim(F.col(column)).startswith('"'), F.when(single.isNotNull(), F.array(single)).otherwise(F.expr(EMPTY_LIST))).otherwise(string_list(column))


def parsed(column: str) -> Column:
    """A JSON column as its nested value."""
    if column == "intent":
        return list_or_single(column)
    kind = NESTED[column]
    return string_list(column) if kind.typeName() == "array" else F.from_json(F.col(column), kind)


def live_rows(memes: DataFrame, columns: list[str]) -> DataFrame:
    """The row with the latest ``labeled_at`` of each id (null is the oldest), of the columns asked for."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("labeled_at"), *[F.asc_nulls_last(c) for c in columns if c not in ("id", "labeled_at")])
    kept = memes.filter("id is not null").select(*dict.fromkeys(["id", "labeled_at", *columns]))
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").select(*columns)


def items(spark: SparkSession, sf_dir: str, columns: list[str], raw: bool = False) -> DataFrame:
    """Live items with the columns asked for, JSON parsed; only those columns are read."""
    live = live_rows(table(spark, sf_dir, "memes"), columns)
    return live if raw else live.withColumns({c: parsed(c) for c in columns if c in NESTED})


class Items:
    """Stored items by id, with the columns that a search shows.

    Searches ask for the few ids that survived, so these are broadcast to the raw rows first and only what
    is left is reduced to live versions and parsed; the texts of all other items never move.
    """

    def __init__(self, memes: DataFrame, columns: list[str]):
        self.memes, self.columns = memes, columns

    def _read(self, rows: DataFrame) -> DataFrame:
        return live_rows(rows, self.columns).withColumns({c: parsed(c) for c in self.columns if c in NESTED})

    def known(self, ids: DataFrame) -> DataFrame:
        """(id): those of the few ids that have a row."""
        return self.memes.select("id").join(F.broadcast(ids.select("id")), "id", "left_semi").distinct()

    def pick(self, ids: DataFrame) -> DataFrame:
        """The live items of the few ids."""
        return self._read(self.memes.join(F.broadcast(ids.select("id")), "id", "left_semi"))

    def among(self, ids: DataFrame) -> DataFrame:
        """The live items of ids that may be many; the join is left to the optimizer."""
        return self._read(self.memes.join(ids.select("id").distinct(), "id", "left_semi"))

    def every(self) -> DataFrame:
        return self._read(self.memes)


class LiveItems(Items):
    """Items that are live and parsed already."""

    def __init__(self, rows: DataFrame):
        super().__init__(rows, rows.columns)

    def _read(self, rows: DataFrame) -> DataFrame:
        return rows


def as_items(items: Items | DataFrame) -> Items:
    return LiveItems(items) if isinstance(items, DataFrame) else items


def versions(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """All stored versions of items, parsed, with ``labeled_at``: for operators that reduce to a few numbers before they choose the live one."""
    raw = table(spark, sf_dir, "memes").filter("id is not null").select(*dict.fromkeys([*columns, "labeled_at"]))
    return raw.withColumns({c: parsed(c) for c in columns if c in NESTED})


def compact_items(memes: DataFrame, path: str, files: int) -> None:
    """Writes the live rows once, in ranges of id, so that later reads need no window and prune by id.

    Every query over raw rows pays a shuffle of the columns it reads to find the live ones; a
    stored table of live rows removes it.
    """
    columns = memes.columns
    live_rows(memes, columns).repartitionByRange(files, "id").sortWithinPartitions("id").write.mode("overwrite").option("compression", "zstd").parquet(path)


def usable(column: str, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers."""
    return (F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def latest_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(meme_id, embedding): the usable vector with the latest ``created_at`` of each id."""
    w = Window.partitionBy("meme_id").orderBy(F.desc_nulls_last("created_at"), "embedding")
    return vectors.filter("meme_id is not null").filter(usable("embedding", dim)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("meme_id", "embedding")


def vector_versions(spark: SparkSession, sf_dir: str, dim: int = 64) -> dict[str, DataFrame]:
    """The usable vectors by aspect in all their versions, with ``created_at``."""
    out = {}
    for a in ASPECTS:
        t = table(spark, sf_dir, f"embeddings_{'context' if a == 'use_case' else a}")
        # the data have no use-case vectors; that aspect is the context's own frame, so searches read it once
        out[a] = out["context"] if a == "use_case" else t.filter("meme_id is not null").filter(usable("embedding", dim)).select("meme_id", "embedding", "created_at")
    return out


def aspect_vectors(spark: SparkSession, sf_dir: str, dim: int = 64) -> dict[str, DataFrame]:
    """The latest vectors by aspect. The data have no use-case vectors; the use-case ranking reads the context vectors."""
    return {a: latest_vectors(table(spark, sf_dir, f"embeddings_{'context' if a == 'use_case' else a}"), dim) for a in ASPECTS}
