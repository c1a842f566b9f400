"""Label files, embedding caches, panel files and image folders."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key
from .schema import EMBEDDING_CACHE, LABEL_ROW, PANELS

IMAGES = r"(?i)\.(jpg|jpeg|png|webp)$"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _first_sign(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        while (b := stream.read()) >= 0:
            if not chr(b).isspace() and b not in (0xEF, 0xBB, 0xBF):
                return chr(b)
    finally:
        stream.close()
    return ""


def read_labels_file(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a label file; a missing file or one that is no array is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(f"Labels file not found: {path}")
    if _first_sign(spark, path) != "[":
        raise ValueError(f"Expected {path} to be a JSON array")
    return spark.read.schema(LABEL_ROW).option("multiLine", True).json(path)


def cache_path(labels_path: str) -> str:
    return f"{labels_path}.embeddings.json"


def read_embedding_cache(spark: SparkSession, labels_path: str) -> DataFrame:
    """(meme_id, embedding, model, built_at) of a label file's cache; a missing one is an error.

    A cache with an entry per line, as write_embedding_cache lays it out, is read in parallel and a line that is no entry is
    an error; one in another layout is read as one row.
    """
    path = cache_path(labels_path)
    if not exists(spark, path):
        raise FileNotFoundError(f"No embedding cache for {labels_path}")
    if (head := _cache_head(spark, path)) is not None:
        line, about = head
        lines = spark.read.option("lineSep", "\n").text(path).filter(~F.col("value").isin(line, "]}"))
        entry = F.from_json(F.rtrim("value", F.lit(",")), EMBEDDING_CACHE["entries"].dataType.elementType, {"mode": "FAILFAST"})
        constant = [F.lit(about[k]).cast("string").alias(k) for k in ("model", "built_at")]
        return lines.select(entry.alias("e")).select(F.col("e.id").alias("meme_id"), "e.embedding", *constant)
    rows = spark.read.schema(EMBEDDING_CACHE).option("multiLine", True).json(path)
    return rows.select("model", "built_at", F.explode("entries").alias("e")).select(F.col("e.id").alias("meme_id"), "e.embedding", "model", "built_at")


def _cache_head(spark: SparkSession, path: str) -> tuple[str, dict[str, object]] | None:
    """The first line of a cache and what it says, if it opens the list of entries; None in another layout."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        line, end, _ = bytes(stream.readNBytes(1 << 16)).partition(b"\n")
    finally:
        stream.close()
    try:
        about = json.loads(line + b"]}") if end else None
    except ValueError:
        return None
    return (line.decode(), about) if isinstance(about, dict) and list(about) == ["model", "built_at", "entries"] and about["entries"] == [] else None


def write_embedding_cache(entries: DataFrame, labels_path: str, model: str) -> dict[str, object]:
    """Writes (id, embedding) as one JSON document beside the label file, an entry per line.

    The executors write the entries; the driver joins their files as bytes and holds none of them. An older cache stays until all are written.
    """
    spark, path = entries.sparkSession, cache_path(labels_path)
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    p, fs = _path(spark, parts)
    entry = F.struct("id", F.col("embedding").cast("array<double>").alias("embedding"))
    try:
        entries.select(F.to_json(entry, {"ignoreNullFields": "false"}).alias("value")).write.option("lineSep", ",\n").text(parts)
        count = spark.read.option("lineSep", ",\n").text(parts).count()
        about = json.dumps({"model": model, "built_at": datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "entries": []})
        _join_files(spark, path, about.removesuffix("]}"), sorted((f for f in fs.listStatus(p) if f.getLen() and f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName()), ",\n", "]}")
    finally:
        fs.delete(p, True)
    return {"path": path, "count": count}


def _join_files(spark: SparkSession, path: str, head: str, parts: list, separator: str, tail: str) -> None:
    """A file of lines: head, the bytes of the parts without the separator that ends the last, tail. A part goes once it is copied."""
    copy = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray((head + "\n").encode()))
        for n, part in enumerate(parts, 1):
            stream = fs.open(part.getPath())
            length = part.getLen() - (len(separator) if n == len(parts) else 0)
            try:
                if copy(stream, out, 0, length) != length:
                    raise OSError(f"{part.getPath()} ended early")
            finally:
                stream.close()
            fs.delete(part.getPath(), False)
        out.write(bytearray((("\n" if parts else "") + tail).encode()))
    finally:
        out.close()


def write_labels_file(rows: DataFrame, path: str) -> int:
    """Writes rows as one pretty JSON array, streaming partition by partition; returns their number."""
    spark = rows.sparkSession
    p, fs = _path(spark, path)
    stream = fs.create(p, True)
    n = 0
    try:
        stream.write(bytearray(b"["))
        for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(prefetchPartitions=True):
            body = json.dumps(json.loads(r.j), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            stream.write(bytearray((("," if n else "") + "\n  " + body).encode()))
            n += 1
        stream.write(bytearray(b"\n]" if n else b"]"))
    finally:
        stream.close()
    return n


def write_labels(rows: DataFrame, path: str) -> None:
    """Writes rows as JSON lines, in parallel: the form for large exports."""
    rows.write.mode("overwrite").json(path)


def query_labels_file(spark: SparkSession, labels_path: str, query: str, embedder, top_k: int = 5) -> DataFrame:
    """(id, similarity, image_path, caption_original): the entries of a label file's cache nearest to a query text."""
    from ..operators.labels_query import label_hits

    if not query.strip():
        raise ValueError("Query text is empty")
    cache = read_embedding_cache(spark, labels_path)
    vector = embedder.embed([query.strip()])[0].astype("float32").tolist()
    return label_hits(cache, read_labels_file(spark, labels_path), vector, top_k)


def image_files(spark: SparkSession, folder: str, limit: int | None = None, content: bool = True) -> DataFrame:
    """(path, name, content) of a folder's images, in natural order of names, the first ``limit`` if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).filter(F.col("path").rlike(IMAGES))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if limit is not None and limit > 0:
        files = files.orderBy(natural_key(F.col("name")), "name").limit(limit)
    return files.select("path", "name", *(["content"] if content else []))


def file_content(spark: SparkSession, folder: str, name: str) -> bytes | None:
    """A file of a folder by its name under the URL prefix, or None where there is none."""
    path = f"{folder}/{name.removeprefix('/memes/')}"
    return bytes(spark.read.format("binaryFile").load(path).first().content) if exists(spark, path) else None


def sample_names(spark: SparkSession, n: int = 4, of: int = 200, seed: int | None = None) -> DataFrame:
    """(id, image_path, image_url): a random sample of the names 0.jpg ..."""
    names = spark.range(of).select(F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("id"))
    return names.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n).select("id", F.col("id").alias("image_path"), F.concat(F.lit("/memes/"), "id").alias("image_url"))


def read_panels(spark: SparkSession, path: str) -> DataFrame:
    """Panel analyses; one JSON document per file."""
    return spark.read.schema(PANELS).option("multiLine", True).json(path)


def write_panels(analyses: DataFrame, path: str) -> None:
    """Writes panel analyses, a JSON document per line."""
    analyses.write.mode("overwrite").json(path)


def read_captions(spark: SparkSession, path: str) -> dict[str, str]:
    """The captions of panels by id, from a small JSON file."""
    rows = spark.read.schema("c string").text(path, wholetext=True).collect()
    return {str(k): str(v) for r in rows for k, v in json.loads(r[0]).items()}
