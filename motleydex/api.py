"""The service's answers as plain values, and an optional HTTP server for them.

``Service.handle(method, path, body)`` gives (status, answer) without a network; ``serve`` puts it behind
the standard library's HTTP server. Requests are small; all heavy work is in the plans they start.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fusion, label_store, maintenance
from .operators.embed_job import Embedder, HashEmbedder
from .operators.labels import Labeler, StubLabeler
from .operators.rerank import OverlapReranker, Reranker
from .operators.vector_search import batch_search
from .sources import files
from .sources.items import Items, vector_versions, versions
from .sources.schema import ASPECTS, SearchRequest, batch_queries
from .sources.tables import table

SHOWN = ["id", "image_path", "primary_language", "supported_languages", "caption", "emotion", "regions", "intent", "popularity_score", "people", "source", "scene_description", "meaning"]
SEARCHED = ["id", "caption", "ocr_text", "image_description", "scene_description", "meaning", "source", "people", "cultural_references", "tags", "query_examples"]


class DataFolder:
    """The tables of a data folder, with several versions per id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def vectors(self) -> dict[str, DataFrame]:
        return vector_versions(self.spark, self.path)

    def texts(self) -> DataFrame:
        return maintenance.build_search_texts(versions(self.spark, self.path, SEARCHED))

    def people(self) -> DataFrame:
        return table(self.spark, self.path, "meme_people")

    def items(self) -> Items:
        return Items(table(self.spark, self.path, "memes"), SHOWN)


class StoredTables:
    """The tables that label_store keeps under a root folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self) -> dict[str, DataFrame]:
        return label_store.tables(self.spark, self.path)

    def vectors(self) -> dict[str, DataFrame]:
        v = self._read()["vectors"]
        return {a: v.filter(F.col("aspect") == a).select("meme_id", "embedding", "created_at") for a in ASPECTS}

    def texts(self) -> DataFrame:
        return self._read()["search_texts"]

    def people(self) -> DataFrame:
        return self._read()["people"]

    def items(self) -> Items:
        return Items(self._read()["items"], SHOWN)


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


class Service:
    """Answers requests over a store."""

    def __init__(self, spark: SparkSession, store: DataFolder | StoredTables, images: str = "memes", embedder: Embedder | None = None, reranker: Reranker | None = None, labeler: Labeler | None = None):
        self.spark, self.store, self.images = spark, store, images
        self.embedder, self.reranker, self.labeler = embedder or HashEmbedder(), reranker or OverlapReranker(), labeler or StubLabeler()

    def search(self, body: dict) -> dict:
        request = SearchRequest(**{k: body[k] for k in ("query", "language", "region", "emotion", "limit", "rerank") if k in body})
        vector = self.embedder.embed([request.query])[0].tolist()
        found = rows(fusion.search(self.store.vectors(), self.store.texts(), self.store.people(), self.store.items(), vector, request, self.reranker).orderBy("rank"))
        total = found[0]["total_results"] if found else 0
        return {"memes": [{k: v for k, v in r.items() if k not in ("rank", "total_results")} for r in found], "query": request.query, "total_results": total}

    def batch(self, body: dict) -> dict:
        queries = batch_queries(body.get("queries"))
        vectors = self.embedder.embed([q.query for q in queries])
        answers: list[list[dict]] = [[] for _ in queries]
        for limit in sorted({q.limit for q in queries}):  # one plan per limit asked for
            some = [i for i, q in enumerate(queries) if q.limit == limit]
            asked = self.spark.createDataFrame([(i, vectors[i].tolist(), queries[i].language, queries[i].region) for i in some], "query_id long, vector array<double>, language string, region string")
            main = self.store.vectors()["main"]
            latest = main.groupBy("meme_id").agg(F.max(F.struct("created_at", "embedding")).alias("v")).select("meme_id", "v.embedding")
            for r in rows(batch_search(latest, self.store.items(), asked, limit).orderBy("query_id", "rank")):
                answers[r["query_id"]].append({"id": r["id"], "image_path": r.get("image_path"), "caption": r.get("caption"), "similarity": r["similarity"]})
        return {"results": [{"query": q.query, "memes": a} for q, a in zip(queries, answers)]}

    def stats(self) -> dict:
        live = {a: v.select("meme_id").distinct() for a, v in self.store.vectors().items()}
        ids = self.store.items().memes.filter("id is not null").select("id").distinct()
        texts = self.store.texts().select("meme_id").distinct()
        return rows(maintenance.stats(live, ids, self.store.people(), texts))[0]

    def reload(self) -> dict:
        if isinstance(self.store, StoredTables):
            label_store.reload(self.spark, self.store.path)
        return {"status": "reloaded", "stats": self.stats()}

    def _root(self) -> str:
        if not isinstance(self.store, StoredTables):
            raise ValueError("a data folder is read-only")
        return self.store.path

    def label(self, body: dict) -> dict:
        return {"success": True} | label_store.label_folder(self.spark, self._root(), body.get("folder", self.images), self.labeler)

    def embed(self, body: dict) -> dict:
        return {"success": True} | label_store.embed_items(self.spark, self._root(), self.embedder)

    def pipeline(self, body: dict) -> dict:
        return {"success": True} | label_store.pipeline(self.spark, self._root(), body.get("folder", self.images), self.labeler, self.embedder)

    def sample(self) -> dict:
        return {"memes": rows(files.sample_names(self.spark))}

    def handle(self, method: str, path: str, body: object = None) -> tuple[int, dict | bytes]:
        """(status, answer). Bad requests give 400, failed jobs 500, unknown paths 404."""
        body = body if isinstance(body, dict) else {}
        answers = {("GET", "/memes"): self.sample, ("GET", "/stats"): self.stats, ("POST", "/reload"): self.reload}
        searches = {("POST", "/search"): self.search, ("POST", "/batch-search"): self.batch}
        jobs = {("POST", "/label"): self.label, ("POST", "/embed"): self.embed, ("POST", "/pipeline"): self.pipeline}
        key = (method, path)
        if key in answers:
            return 200, answers[key]()
        if key in searches:
            try:
                return 200, searches[key](body)
            except Exception as e:
                return 400, {"error": str(e)}
        if key in jobs:
            try:
                return 200, jobs[key](body)
            except Exception as e:
                return 500, {"success": False, "error": str(e)}
        if method == "GET" and path.startswith("/memes/") and ".." not in path:
            content = files.file_content(self.spark, self.images, path)
            if content is not None:
                return 200, content
            return 404, {"error": "File not found"}
        return 404, {"error": "not found"}


def serve(service: Service, port: int = 3000) -> ThreadingHTTPServer:
    """An HTTP server for a service; call serve_forever on it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else None
            except ValueError as e:
                status, out = 400, {"error": str(e)}
            else:
                status, out = service.handle(self.command, self.path.partition("?")[0], body)
            data = out if isinstance(out, bytes) else json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/octet-stream" if isinstance(out, bytes) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
