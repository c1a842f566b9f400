"""The service's answers."""

import json
import threading
import urllib.request

import pytest

from motleydex.api import DataFolder, Service, StoredTables, serve


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    for i in range(2):
        (d / f"{i}.jpg").write_bytes(b"x" * (i + 1))
    return str(d)


@pytest.fixture(scope="module")
def stored(spark, images, tmp_path_factory):
    return Service(spark, StoredTables(spark, str(tmp_path_factory.mktemp("db"))), images)


def test_jobs_then_search(stored):
    assert stored.handle("POST", "/pipeline", {}) == (200, {"success": True, "label": {"total": 2, "succeeded": 2, "failed": 0}, "embed": {"embedded": 2}})
    assert stored.handle("POST", "/embed")[1] == {"success": True, "embedded": 0}
    status, out = stored.handle("POST", "/search", {"query": "image bytes", "rerank": False, "limit": 5})
    assert status == 200 and out["total_results"] == 2 and {"id", "caption", "score", "rrf_score", "similarity"} <= set(out["memes"][0])
    status, out = stored.handle("POST", "/batch-search", {"queries": [{"query": "image jpeg bytes", "limit": 1}, {"query": "image jpeg bytes", "language": "hindi"}]})
    assert status == 200 and [len(r["memes"]) for r in out["results"]] == [1, 0]
    stats = stored.handle("GET", "/stats")[1]
    assert stats["total_memes"] == stats["total_labeled"] == stats["embeddings_use_case"] == stats["fts_documents"] == 2
    assert stored.handle("POST", "/reload")[1]["stats"] == stats


@pytest.mark.parametrize("body", [{}, {"query": ""}, {"query": "a", "limit": 99}, None])
def test_bad_searches(stored, body):
    status, out = stored.handle("POST", "/search", body)
    assert status == 400 and out["error"]
    assert stored.handle("POST", "/batch-search", {"queries": []})[0] == 400


def test_files_and_unknown_paths(stored):
    assert stored.handle("GET", "/memes/1.jpg") == (200, b"xx") and stored.handle("GET", "/memes/9.jpg")[0] == 404
    assert stored.handle("GET", "/nothing")[0] == 404 and len(stored.handle("GET", "/memes")[1]["memes"]) == 4


def test_data_folder(spark, data):
    service = Service(spark, DataFolder(spark, data))
    status, out = service.handle("POST", "/search", {"query": "exam result", "limit": 3, "rerank": False})
    assert status == 200 and 0 < len(out["memes"]) <= 3
    assert service.handle("POST", "/label")[0] == 500
    assert service.handle("GET", "/stats")[1]["total_memes"] > 0


def test_over_http(stored):
    server = serve(stored, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/memes") as r:
        assert len(json.load(r)["memes"]) == 4
    server.shutdown()
