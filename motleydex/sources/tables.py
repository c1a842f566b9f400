"""Reading the Parquet tables and writing intermediate ones."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that none of them needs it installed.

    The archive lies in the shared folder. A cluster without one must have the package installed.
    Also turns off taking a union's partitioning from its inputs: in Spark 4.1 an aggregation or join above such a union goes without an
    exchange although adaptive execution may have merged the inputs' partitions differently, and then gives wrong rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    try:
        folder = scratch_root(spark)
    except ValueError:
        return
    package = Path(__file__).resolve().parents[1]
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    path = f"{folder}/{package.name}-{sc.applicationId}.zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(archive.getvalue()))
    finally:
        stream.close()
    sc.addPyFile(path)  # executors fetch it, also those that join later


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; lazily, so column pruning and filters reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at a path. Any failure to find out is an error, never an answer."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The session's ``spark.checkpoint.dir`` wins. Only a local session without
    that setting gets a temporary folder of this machine; a cluster without it
    is an error, as its executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="motleydex-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def persist_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = os.path.join(scratch_root(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
