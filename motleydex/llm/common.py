"""What the operators of this subpackage share."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

OLDEST = "timestamp_ntz'0001-01-01 00:00:00'"


def age(column: str = "labeled_at") -> Column:
    """A time stamp for comparing versions of a row; null is the oldest."""
    return F.coalesce(F.col(column).cast("timestamp_ntz"), F.expr(OLDEST))


def newest(df: DataFrame, keys: list[str], stamp: str, values: list[str]) -> DataFrame:
    """One row per key: the values of its row with the greatest stamp (ties: the greatest values).

    Aggregates before the shuffle; rows whose key is null are kept as one group.
    """
    best = F.max(F.struct(stamp, *values)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def parse(text: str | None) -> object:
    """JSON text as a value; null, empty and cut-off text give None."""
    if not text:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return None


def strings(value: object) -> Iterator[str]:
    """All strings in a parsed JSON value, keys left out."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v)


def original(text: str | None) -> str:
    """``caption.original`` of a caption's JSON text, or the empty string."""
    value = parse(text)
    if isinstance(value, dict):
        value = value.get("original")
    return value if isinstance(value, str) else ""


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str | object) -> DataFrame:
    """``mapInArrow`` over columns as Python lists. ``make`` runs once a task and gives the function of a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)  # frames that were not read by this package's own functions, too
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            out = step({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
