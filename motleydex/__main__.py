"""Command line: python -m motleydex TABLES_FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motleydex")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="a whole search over a data folder")
    s.add_argument("data")
    s.add_argument("query")
    s.add_argument("--language")
    s.add_argument("--region")
    s.add_argument("--emotion")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--no-rerank", action="store_true")
    s = sub.add_parser("stats", help="counts of a data folder")
    s.add_argument("data")
    s = sub.add_parser("export", help="label file of a data folder")
    s.add_argument("data")
    s.add_argument("output")
    s.add_argument("prefix", nargs="?")
    s = sub.add_parser("filter", help="filter a label file")
    for a in ("input", "output", "key", "value"):
        s.add_argument(a)
    s = sub.add_parser("build", help="embedding cache of a label file")
    s.add_argument("labels")
    s = sub.add_parser("query", help="nearest labels of a label file")
    s.add_argument("labels")
    s.add_argument("text", nargs="+")
    s = sub.add_parser("label", help="label a folder of images with the stand-in labeller")
    s.add_argument("root")
    s.add_argument("folder")
    s.add_argument("--limit", type=int)
    s = sub.add_parser("embed", help="fill missing vectors of stored items")
    s.add_argument("root")
    s = sub.add_parser("serve", help="answer requests over stored tables or, with --data, a data folder")
    s.add_argument("root")
    s.add_argument("--data", action="store_true")
    s.add_argument("--images", default="memes")
    s.add_argument("--port", type=int, default=3000)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .api import DataFolder, Service, StoredTables, serve
    from .operators import label_store, maintenance
    from .operators.embed_job import HashEmbedder, label_cache
    from .operators.labels import StubLabeler
    from .sources import files, items

    spark = spark or SparkSession.builder.appName("motleydex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = HashEmbedder()
    if a.command == "search":
        body = {k: v for k, v in {"query": a.query, "language": a.language, "region": a.region, "emotion": a.emotion, "limit": a.limit, "rerank": not a.no_rerank}.items() if v is not None}
        print(json.dumps(Service(spark, DataFolder(spark, a.data)).search(body), ensure_ascii=False, indent=2))
    elif a.command == "stats":
        print(json.dumps(Service(spark, DataFolder(spark, a.data)).stats()))
    elif a.command == "serve":
        serve(Service(spark, (DataFolder if a.data else StoredTables)(spark, a.root), a.images), a.port).serve_forever()
    elif a.command == "export":
        n = files.write_labels_file(maintenance.export_labels(items.items(spark, a.data, list(maintenance.EXPORTED), raw=True), a.prefix), a.output)
        print(f"Exported {n} labels to {a.output}")
    elif a.command == "filter":
        rows = files.read_labels_file(spark, a.input)
        n = files.write_labels_file(maintenance.filter_labels(rows, a.key, a.value), a.output)
        print(f"Filtered: {rows.count()} -> {n}")
    elif a.command == "build":
        print(json.dumps(files.write_embedding_cache(label_cache(files.read_labels_file(spark, a.labels), e), a.labels, e.model)))
    elif a.command == "query":
        print(json.dumps([r.asDict() for r in files.query_labels_file(spark, a.labels, " ".join(a.text), e).collect()], ensure_ascii=False, indent=2))
    elif a.command == "label":
        print(json.dumps(label_store.label_folder(spark, a.root, a.folder, StubLabeler(), a.limit)))
    elif a.command == "embed":
        print(json.dumps(label_store.embed_items(spark, a.root, e)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
