"""Vector search, fusion, reranking and scores on small tables with values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motleydex.functions.vectors import cosine, cosines
from motleydex.operators.fusion import rank, rrf, search, union_rankings
from motleydex.operators.people import exact_people, index_people
from motleydex.operators.rerank import FailingReranker, OverlapReranker, cross_encode
from motleydex.operators.vector_search import as_vector, batch_search, nearest, nearest_for_queries, search_aspect
from motleydex.operators.vector_search import search as legacy
from motleydex.sources.schema import BatchQuery, QueryAnalysis, SearchOptions, SearchRequest, batch_queries

ITEM = "id string, image_path string, primary_language string, supported_languages array<string>, caption struct<original:string,translations:struct<english:string>>, emotion array<string>, regions array<string>, intent array<string>, popularity_score int, people array<string>, source string, scene_description string, meaning struct<english:string>"


def item(i, lang="english", langs=(), regions=(), emotion=(), popularity=0, caption=("o", "e"), people=(), source=""):
    return (i, f"{i}.jpg", lang, list(langs), (caption[0], (caption[1],)), list(emotion), list(regions), ["x"], popularity, list(people), source, "", ("m",))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([item("a", "hindi", regions=["delhi"], popularity=80), item("b", "english", ["hindi"], ["pan_india"]), item("c", emotion=["joy"], caption=("o", "")), item("d", None)], ITEM)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0]), ("z", [1.0, 0.1]), ("d", [0.0, 0.0])], "meme_id string, embedding array<float>")


def test_cosine_and_zero(spark, vectors):
    got = {r.meme_id: r.c for r in vectors.select("meme_id", cosine(F.col("embedding"), as_vector([2.0, 0.0])).alias("c")).collect()}
    assert got["a"] == 1 and got["d"] == 0 and got["b"] == pytest.approx(2**-0.5)
    assert cosines(np.array([[1.0, 0], [0, 0]]), np.array([[1.0, 1]]))[1, 0] == 0


def test_topk_before_join_and_threshold(vectors, items):
    top = search_aspect(vectors, items, [1.0, 0.0], 2, 0.0).collect()
    assert [(r.meme_id, r.pos) for r in top] == [("a", 1)]  # z takes a place, then drops out
    assert nearest(vectors, [1.0, 0.0], 10).count() == 5


def test_legacy_filters(vectors, items):
    ids = lambda **o: [r.id for r in legacy(vectors, items, [1.0, 0.0], SearchOptions(**({"min_similarity": 0.0} | o))).collect()]
    assert ids(language="hindi") == ["a", "b"] and ids(region="mumbai") == ["b"] and ids(emotion="joy") == ["c"] and ids(limit=1) == ["a"]
    assert ids(min_similarity=0.71) == ["a"]


def test_batch_matches_single(spark, vectors, items):
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0])], "query_id string, vector array<float>")
    got = nearest_for_queries(vectors, q, 3).orderBy("query_id", "pos").collect()
    assert [r.meme_id for r in got] == ["a", "z", "b", "c", "b", "z"]
    assert batch_search(vectors, items, q, 1, 0.0).count() == 2
    assert nearest_for_queries(vectors, q.limit(0), 3).count() == 0


def test_rrf_constants(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "meme_id string, pos int")
    got = {r.meme_id: r.rrf_score for r in rrf(union_rankings([one, one, one.filter("pos = 1")])).collect()}
    assert got["a"] == pytest.approx(3 / 61, abs=1e-12) and got["b"] == pytest.approx(2 / 62, abs=1e-12)


def test_rank_boosts(spark, items):
    hits = items.select("*", F.lit(0.5).alias("rrf_score"), F.lit(1.0).alias("similarity"), F.lit(1).alias("pos"))
    got = {r.id: r.score for r in rank(hits, SearchOptions(language="hindi", region="pan_india")).collect()}
    assert got == {"a": 50 + 20 + 10, "b": 50 + 15 + 5, "c": 50, "d": 50}


def test_rerank_paths(items):
    hits = items.select("*", F.lit(0.03).alias("rrf_score"), F.lit(1.0).alias("similarity"), F.when(F.col("id") == "a", 1).when(F.col("id") == "b", 16).otherwise(17).alias("pos"))
    failed = {r.id: r.cross_score for r in cross_encode(hits, "q", 15, FailingReranker()).collect()}
    assert failed == {"a": pytest.approx(3.0)}  # 100 x 0.03; the rest have 50 x 0.03 < 2
    scored = cross_encode(hits, "caption", 15, OverlapReranker()).collect()
    assert [r.id for r in scored] == ["a"] and scored[0].cross_score == 10


def test_whole_search_with_empty_parts(spark, vectors, items):
    texts = spark.createDataFrame([("c", "exam result"), ("a", "other")], "meme_id string, search_text string")
    people = spark.createDataFrame([("raj kumar", "b"), ("raja", "c")], "person_name string, meme_id string")
    none = vectors.limit(0)
    vs = {"main": vectors, "people": none, "context": none, "use_case": none}
    out = search(vs, texts, people, items, [1.0, 0.0], SearchRequest("exam", limit=2, rerank=False)).orderBy("rank").collect()
    assert len(out) == 2 and out[0].total_results == 3
    assert {r.id: r.caption for r in out}.get("c", "") == ""  # an empty translation counts as given
    exact = search(vs, texts, people, items, [1.0, 0.0], SearchRequest("what?", limit=5, rerank=False), names=["Raj (actor)"]).orderBy("rank").collect()
    assert exact[0].id in ("a", "b")


def test_people(spark):
    live = spark.createDataFrame([("1", ["Raj (Actor) ", "raj"]), ("2", []), ("3", None)], "id string, people array<string>")
    index = index_people(live)
    assert [tuple(r) for r in index.collect()] == [("raj", "1")]
    assert exact_people(index, []).count() == 0 and exact_people(index, ["(x)"]).count() == 1


@pytest.mark.parametrize("bad", [{"query": ""}, {"query": "a", "limit": 0}, {"query": "a", "limit": 51}, {"query": "a", "rerank": 1}, {"query": "a", "language": 3}])
def test_request_checks(bad):
    with pytest.raises(ValueError):
        SearchRequest(**bad)


def test_batch_and_analysis_checks():
    assert batch_queries([{"query": "a"}]) == [BatchQuery("a")]
    for bad in ([], None, "x"):
        with pytest.raises(ValueError):
            batch_queries(bad)
    with pytest.raises(ValueError):
        QueryAnalysis("hindi", regions=("a", "b", "c"))


def test_more_queries_than_a_block(spark, monkeypatch):
    from motleydex.operators import vector_search

    vectors = spark.createDataFrame([(f"m{i}", [float(i), 1.0]) for i in range(6)], "meme_id string, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", [float(i), 1.0], 1 + i % 2) for i in range(5)], "query_id string, vector array<float>, k int")
    whole = {k: sorted(map(tuple, vector_search.nearest_for_queries(vectors, queries, k).collect())) for k in (2, "k")}
    monkeypatch.setattr(vector_search, "MOST_QUERIES", 2)
    for k, rows in whole.items():
        assert sorted(map(tuple, vector_search.nearest_for_queries(vectors, queries, k).collect())) == rows and rows


def test_batch_search_beyond_a_block_of_queries(spark):
    """25,000 queries, worked through in blocks, against brute force."""
    rng = np.random.default_rng(2)
    v, q = rng.standard_normal((40, 4)), rng.standard_normal((25_000, 4))
    vectors = spark.createDataFrame([(f"m{i:02}", x.tolist()) for i, x in enumerate(v)] + [("a", v[0].tolist())], "meme_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>")
    got = nearest_for_queries(vectors, queries, 3).toPandas().sort_values(["query_id", "pos"])
    assert len(got) == 75_000
    ids = ["a", *(f"m{i:02}" for i in range(40))]
    both = np.concatenate([v[:1], v])
    sims = np.round((both @ q.T) / np.linalg.norm(both, axis=1)[:, None] / np.linalg.norm(q, axis=1), 10)
    best = np.lexsort((np.arange(41)[:, None] + np.zeros_like(sims), -sims), axis=0)[:3]
    assert got.meme_id.tolist() == [ids[i] for i in best.T.ravel()]
