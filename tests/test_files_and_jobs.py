"""Files, embedding jobs, maintenance, panels, evaluation and the stream."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from motleydex.functions.text import natural_key, normalise_person
from motleydex.operators import embed_job, evaluation, maintenance, panels
from motleydex.sources import files
from motleydex.sources.items import compact_items, latest_vectors, list_or_single, live_rows, string_list
from motleydex.sources.schema import ITEM_COLUMNS, ITEMS
from motleydex.sources.tables import scratch_root
from motleydex.streaming.ingest import debounced, fill_vectors

LABELS = [
    {"id": "a", "image_path": "m/1.jpg", "primary_language": "hindi", "emotion": ["joy"], "regions": None, "reviewed": True, "safety": {"nsfw": True}, "caption": {"original": "A"}, "multilingual_embedding_text": "exam result", "labeled_at": "2024-01-01T00:00:00Z"},
    {"id": "b", "image_path": "n/2.jpg", "primary_language": "english", "reviewed": False, "multilingual_embedding_text": "cricket match"},
]


@pytest.fixture()
def labels_path(tmp_path):
    p = tmp_path / "labels.json"
    p.write_text(json.dumps(LABELS))
    return str(p)


def test_label_files(spark, labels_path, tmp_path):
    rows = files.read_labels_file(spark, labels_path)
    assert rows.count() == 2
    for key, value, ids in (("language", "hindi", ["a"]), ("emotion", "joy", ["a"]), ("region", "x", []), ("reviewed", "true", ["a"]), ("reviewed", "false", ["b"]), ("nsfw", "false", ["a"]), ("other", "x", ["a", "b"]), ("language", "", ["a", "b"]), (None, None, ["a", "b"])):
        assert [r.id for r in maintenance.filter_labels(rows, key, value).orderBy("id").collect()] == ids
    out = str(tmp_path / "out.json")
    assert files.write_labels_file(rows.orderBy("id"), out) == 2
    assert [x["id"] for x in json.loads(open(out).read())] == ["a", "b"]
    assert files.write_labels_file(rows.limit(0), out) == 0 and json.loads(open(out).read()) == []
    with pytest.raises(FileNotFoundError):
        files.read_labels_file(spark, labels_path + "x")
    (tmp_path / "o.json").write_text(' {"a": 1}')
    with pytest.raises(ValueError):
        files.read_labels_file(spark, str(tmp_path / "o.json"))


def test_cache_round_trip_and_query(spark, labels_path):
    with pytest.raises(FileNotFoundError):
        files.read_embedding_cache(spark, labels_path)
    e = embed_job.HashEmbedder()
    made = embed_job.label_cache(files.read_labels_file(spark, labels_path), e)
    assert files.write_embedding_cache(made, labels_path, e.model)["count"] == 2
    hits = files.query_labels_file(spark, labels_path, " exam result ", e, 5).collect()
    assert hits[0].id == "a" and hits[0].similarity == pytest.approx(1, abs=1e-6) and hits[0].caption_original == "A"
    with pytest.raises(ValueError):
        files.query_labels_file(spark, labels_path, "  ", e)
    blank = spark.createDataFrame([("x", " ")], "id string, multilingual_embedding_text string")
    with pytest.raises(Exception, match="Missing multilingual_embedding_text for id x"):
        embed_job.label_cache(blank, e).collect()


def test_cache_is_written_and_read_in_parallel(spark, labels_path, monkeypatch):
    ids = ['q"}]},', "two\nlines\r", "\u2028", "]}", "", None, *map(str, range(3000))]
    values = [[1.0, float("nan"), None], [float("inf"), -float("inf"), 1e-30], [0.1, 1 / 3, 16777217.0], []]
    rows = [(i, values[n % 4]) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a, **k: pytest.fail("rows come to the driver"))
    monkeypatch.setattr(type(df), "collect", lambda *a, **k: pytest.fail("rows come to the driver"))
    assert files.write_embedding_cache(df, labels_path, 'm"1') == {"path": files.cache_path(labels_path), "count": len(ids)}
    monkeypatch.undo()
    document = json.load(open(files.cache_path(labels_path), encoding="utf-8"))
    assert list(document) == ["model", "built_at", "entries"] and document["model"] == 'm"1' and {e["id"] for e in document["entries"]} == set(ids)
    assert next(e["embedding"] for e in document["entries"] if e["id"] == "\u2028")[0] == float(np.float32(0.1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = files.read_embedding_cache(spark, labels_path)
        assert got.rdd.getNumPartitions() > 5
        assert sorted((str(r.meme_id), repr(r.embedding)) for r in got.collect()) == sorted((str(r.id), repr(r.embedding)) for r in df.collect())
        assert {(r.model, r.built_at) for r in got.collect()} == {('m"1', document["built_at"])}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert files.write_embedding_cache(df.limit(0), labels_path, "m")["count"] == 0 and files.read_embedding_cache(spark, labels_path).count() == 0
    assert not [f for f in os.listdir(os.path.dirname(labels_path)) if ".parts-" in f]


def test_cache_in_other_layouts(spark, labels_path):
    document = {"model": "m", "built_at": "t", "entries": [{"id": "a", "embedding": [1, 0.5]}, {"id": "b", "embedding": []}]}
    whole = json.dumps(document)
    for text in (whole, json.dumps(document, indent=2), json.dumps(document, separators=(",", ":")), whole.replace("[{", "[\n{").replace("}, ", "},\n").replace("}]", "}\n]"), json.dumps(dict(reversed(document.items())))):
        open(files.cache_path(labels_path), "w").write(text)
        assert [tuple(r) for r in files.read_embedding_cache(spark, labels_path).orderBy("meme_id").collect()] == [("a", [1.0, 0.5], "m", "t"), ("b", [], "m", "t")]
    open(files.cache_path(labels_path), "w").write(whole.replace("[{", "[\n{").replace("}, ", "},\nx").replace("}]", "}\n]"))
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_embedding_cache(spark, labels_path).collect()


def test_images(spark, tmp_path):
    for n in ("10.jpg", "9.PNG", "note.txt", "a2.webp", "A10.jpeg"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.name for r in files.image_files(spark, str(tmp_path), 3).collect()] == ["9.PNG", "10.jpg", "a2.webp"]
    assert files.image_files(spark, str(tmp_path)).count() == 4
    keys = spark.createDataFrame([("x10",), ("X9",), ("x9a",)], "n string").orderBy(natural_key(F.col("n"))).collect()
    assert [r.n for r in keys] == ["X9", "x9a", "x10"]
    assert files.sample_names(spark, seed=1).count() == 4


def test_json_lists(spark):
    df = spark.createDataFrame([('["a"]',), ("null",), ('"one"',), (None,), ("",), ("[",)], "c string").select(string_list("c").alias("l"), list_or_single("c").alias("s"))
    assert [(r.l, r.s) for r in df.collect()] == [(["a"], ["a"]), ([], []), ([], ["one"]), ([], []), ([], []), ([], [])]


def test_names(spark):
    got = spark.createDataFrame([("  Raj (A) Kumar (B) ",), ("(x)",), (None,)], "n string").select(normalise_person(F.col("n")).alias("n")).collect()
    assert [r.n for r in got] == ["raj kumar", "", None]


def test_live_rows_and_latest_vectors(spark):
    from datetime import datetime as D

    rows = spark.createDataFrame([("a", D(2024, 1, 1), "x", 1), ("a", None, "y", 2), ("a", D(2024, 1, 1), "x", 1), (None, None, "z", 3)], "id string, labeled_at timestamp_ntz, v string, _n int")
    assert [tuple(r) for r in live_rows(rows, ["id", "v"]).collect()] == [("a", "x")]
    v = spark.createDataFrame([("a", [1.0, 0.0], None), ("a", [0.0, 1.0], D(2024, 1, 1)), ("b", [float("nan"), 1.0], None), ("c", [1.0], None), ("d", None, None), ("e", [None, 1.0], None), (None, [1.0, 1.0], None)], "meme_id string, embedding array<float>, created_at timestamp_ntz")
    assert [(r.meme_id, r.embedding) for r in latest_vectors(v, 2).collect()] == [("a", [0.0, 1.0])]


def test_compaction(spark, data, tmp_path):
    raw = spark.read.parquet(f"{data}/memes.parquet")
    compact_items(raw, str(tmp_path / "live"), 3)
    stored = spark.read.parquet(str(tmp_path / "live"))
    assert stored.columns == raw.columns and stored.count() == raw.select("id").distinct().count()


def test_missing_aspects_with_null_ids(spark):
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    have = lambda *ids: spark.createDataFrame([(i,) for i in ids], "meme_id string")
    vs = {"main": have("a", None), "people": have("a"), "context": have("a", "b"), "use_case": have("a")}
    assert [(r.id, r.missing) for r in embed_job.missing_aspects(items, vs).collect()] == [("b", ["main", "people", "use_case"])]
    assert embed_job.embed_result(embed_job.missing_aspects(items, vs)).first().embedded == 1


def test_upsert(spark):
    from datetime import datetime as D

    s = "meme_id string, aspect string, embedding array<float>, model string, created_at timestamp_ntz"
    old = spark.createDataFrame([("a", "main", [1.0], "m", D(2024, 1, 1)), ("b", "main", [1.0], "m", None)], s)
    new = spark.createDataFrame([("a", "main", [2.0], "m", D(2024, 1, 2)), ("b", "main", [3.0], "m", None)], s)
    assert {r.meme_id: r.embedding for r in embed_job.upsert_vectors(old, new).collect()} == {"a": [2.0], "b": [3.0]}


def test_inserts_migration_tables(spark, tmp_path):
    t = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    ok, bad = maintenance.insert_items(t("a"), t("a", "b", "c", "c"))
    assert [r.id for r in ok.collect()] == ["b"] and sorted(r.id for r in bad.collect()) == ["a", "c", "c"]
    assert maintenance.migrate_items(t("a").withColumn("source", F.lit("s"))).first().asDict() == {"id": "a", "source": "s", "ocr_text": "", "image_description": "", "people": "[]", "cultural_references": "[]", "scene_description": ""}
    root = str(tmp_path / "db")
    assert len(maintenance.create_tables(spark, root)) == 4 and maintenance.create_tables(spark, root) == []
    maintenance.reset_tables(spark, root)
    assert spark.read.parquet(f"{root}/items.parquet").schema == ITEMS


def word(line, n, left, top, w, h, text, conf=90, block=1):
    return ("i", 0, block, 1, line, n, left, top, w, h, conf, text)


def test_panel_blocks(spark):
    words = spark.createDataFrame(
        [word(1, 1, 10, 10, 20, 10, "A"), word(1, 2, 40, 12, 20, 10, " b "), word(2, 1, 10, 24, 30, 11, "c"), word(3, 1, 10, 90, 30, 12, "far"), word(4, 1, 0, 0, 9, 9, "no", conf=39), word(5, 1, 0, 0, 9, 9, "  ")],
        "image string, panel int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf int, text string",
    )
    boxes = spark.createDataFrame([("i", 200, 130, 0, 5, 7, 100, 120), ("i", 200, 130, 1, 105, 7, 95, 120)], "image string, width int, height int, panel int, panel_x int, panel_y int, panel_w int, panel_h int")
    blocks = panels.panel_blocks(words, boxes, ["image", "panel"])
    got = blocks.orderBy("grp").collect()
    assert [(r.x, r.y, r.w, r.h, r.text, r.lines, r.font_px, r.position) for r in got] == [(15, 17, 50, 25, "A b\nc", 2, 11, "top"), (15, 97, 30, 12, "far", 1, 12, "bottom")]
    nested = panels.analysis(blocks, boxes).first()
    assert [len(p.text_blocks) for p in nested.panels] == [2, 0] and nested.panels[0].bbox == [5, 7, 100, 120]
    anchor = panels.anchors(boxes, blocks, {"0": "hi", "9": "x"}).collect()
    assert len(anchor) == 1 and anchor[0].font_px == 11 and anchor[0].caption == "hi" and anchor[0].region.asDict() == {"x": 11, "y": 71, "w": 88, "h": 50}


def test_gutters(spark):
    gray = np.random.default_rng(1).integers(0, 255, (210, 220), dtype=np.uint8)
    gray[100:106] = 250
    gray[106:, 108:112] = 0
    df = spark.createDataFrame([("i", 220, 210, bytearray(gray.tobytes()))], "image string, width int, height int, pixels binary")
    assert [(r.panel_x, r.panel_y, r.panel_w, r.panel_h) for r in panels.detect_panels(df).orderBy("panel").collect()] == [(0, 0, 220, 100), (0, 106, 108, 104), (112, 106, 108, 104)]
    assert panels.gutter(np.full(50, 100.0), np.zeros(50)) is None


def test_geometry(spark):
    one = spark.range(1).select(panels.segments(F.array(F.lit(70), F.lit(30)), F.lit(100)).alias("s"), panels.clamped(F.lit(2), F.lit(2), F.lit(100), F.lit(5), F.lit(90), F.lit(90)).alias("c"), panels.ink(F.lit(3), F.lit(3)).alias("i")).first()
    assert [(x.start, x.end) for x in one.s] == [(0, 30), (30, 70), (70, 100)] and tuple(one.c) == (0, 0, 90, 13) and one.i == "white"


def test_recall(spark):
    e = embed_job.HashEmbedder()
    rows = spark.createDataFrame([("a", "p", (["exam result", " "], ["x"], None)), ("b", None, (["cricket"], ["y"], ["z"]))], "id string, image_path string, query_examples struct<english:array<string>,hindi:array<string>,hinglish:array<string>>")
    cases = evaluation.golden_cases(rows)
    assert cases.count() == 5
    assert [tuple(r) for r in evaluation.crosslingual_cases(rows).collect()] == [("b", "b", "cricket", "y", "z")]
    vs = embed_job.embedded(spark.createDataFrame([("a", "exam result"), ("b", "cricket")], "meme_id string, text string"), e)
    found = evaluation.hits(cases.filter("lang = 'english'"), vs, e, 1)
    assert evaluation.recall(found, 1).first().recall == 1 and evaluation.failures(found, 1).count() == 0
    assert evaluation.check_hits(np.array([0.1, 1.0]), 2) and not evaluation.check_hits(np.array([2.0]), 1)


def test_stream_fills_once(spark, data, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("items", "vectors", "mark"))
    spark.read.parquet(f"{data}/memes.parquet").select(*ITEM_COLUMNS).limit(20).write.parquet(src)
    for _ in range(2):
        fill_vectors(spark, src, out, mark, embed_job.HashEmbedder()).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 4 * got.select("meme_id").distinct().count() > 0
    spark.read.parquet(src).write.mode("append").parquet(src + "2")
    spark.read.parquet(src + "2").write.mode("append").parquet(src)
    fill_vectors(spark, src, out, mark, embed_job.HashEmbedder()).awaitTermination()
    assert spark.read.parquet(out).count() == got.count()


def test_debounce(spark):
    df = spark.sql("SELECT * FROM VALUES ('u', timestamp'2024-01-01 00:00:00.0', 1), ('u', timestamp'2024-01-01 00:00:00.3', 2), ('u', timestamp'2024-01-01 00:00:01', 3) t(k, ts, n)")
    assert sorted(r.n for r in debounced(df, "k", "ts").collect()) == [2, 3]


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_an_unreadable_table_is_an_error_and_stays(spark, tmp_path):
    """A failed read never counts as an empty table: nothing is overwritten, nothing is embedded again."""
    from motleydex.streaming.ingest import read_vectors

    root = str(tmp_path / "db")
    maintenance.create_tables(spark, root)
    broken = tmp_path / "db" / "items.parquet"
    for f in broken.iterdir():
        f.unlink()
    (broken / "part-0.parquet").write_bytes(b"half written")
    assert maintenance.create_tables(spark, root) == []
    assert (broken / "part-0.parquet").read_bytes() == b"half written"
    with pytest.raises(Exception, match="part-0"):
        read_vectors(spark, str(broken)).count()
    assert read_vectors(spark, str(tmp_path / "absent")).count() == 0


def test_seams_without_gutters():
    rng = np.random.default_rng(1)
    levels = np.repeat(np.repeat(np.array([[60, 170], [200, 90]]), 150, axis=0), 200, axis=1)
    gray = (levels + rng.integers(-4, 5, levels.shape)).astype(np.uint8)
    got = panels.split_panels(gray)
    assert len(got) == 4 and sorted((round(x / 200), round(y / 150)) for x, y, _, _ in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert all(abs(w - 200) <= 3 and abs(h - 150) <= 3 for _, _, w, h in got)
    letters = np.full((300, 400), 120, np.uint8)
    for x in range(20, 380, 24):
        letters[140:150, x : x + 8] = 250  # strokes of text are no seam
    assert panels.split_panels(letters) == [(0, 0, 400, 300)]
    assert panels.split_panels(np.full((50, 50), 128, np.uint8)) == [(0, 0, 50, 50)]


def test_ink_is_counted_in_the_box(spark):
    picture = np.full((10, 20, 3), 128, np.uint8)
    picture[2:4, 3:9] = 10
    picture[5, 3:6] = (255, 250, 240)
    df = spark.createDataFrame([("a", 20, 10, bytearray(picture.tobytes()), 0, 0, 20, 10), ("b", 20, 10, bytearray(picture.tobytes()), -5, 5, 12, 100), ("c", 20, 10, bytearray(picture.tobytes()), 30, 30, 5, 5)], "image string, width int, height int, pixels binary, x int, y int, w int, h int")
    got = {r.image: (r.bright, r.dark, r.ink) for r in panels.ink_counts(df).withColumn("ink", panels.ink(F.col("bright"), F.col("dark"))).collect()}
    assert got == {"a": (3, 12, "black"), "b": (3, 0, "white"), "c": (0, 0, "white")}


def test_flat_parts_are_not_searched_for_edges(monkeypatch):
    searched, edges = [], panels.edges
    monkeypatch.setattr(panels, "edges", lambda g: searched.append(g.shape) or edges(g))
    gray = np.full((240, 160), 90, np.uint8)
    gray[100:] = 170
    assert [b[1::2] for b in panels.split_panels(gray)] in ([(0, n), (n, 240 - n)] for n in range(98, 103))
    assert len(searched) == 2  # not the half that ends at the seam


def test_edges_connect_along_a_winding_path():
    rng = np.random.default_rng(3)
    weak = np.zeros((61, 61), bool)
    weak[::4] = True
    for k, row in enumerate(range(2, 60, 4)):
        weak[row - 1 : row + 2, 60 if k % 2 == 0 else 0] = True
    strong = np.zeros_like(weak)
    strong[0, 0] = True
    assert (panels.connected(weak, strong) == weak).all()
    for share in (0.2, 0.4, 0.6):
        weak = rng.random((40, 50)) < share
        strong = weak & (rng.random((40, 50)) < 0.02)
        on = strong
        while True:
            near = np.pad(on, 1)
            grown = weak & np.logical_or.reduce([near[i : i + 40, j : j + 50] for i in range(3) for j in range(3)])
            if (grown == on).all():
                break
            on = grown
        assert (panels.connected(weak, strong) == on).all()


def test_plain_lines():
    rng = np.random.default_rng(4)
    g = rng.integers(0, 256, (90, 70)).astype(np.uint8)
    g[20:30], g[50, ::2], g[60:70] = 250, 21, rng.integers(100, 126, (10, 70))  # one colour, one in every other pixel, nearly one
    g[75:80], g[75:80, :3] = 90, 120
    want = g.std(axis=1) < panels.FLAT
    assert want[20:30].all() and want[60:80].any() and not want[:20].any() and not want[50]
    for lines, axis in ((g, 1), (g.T, 0), (g.astype(float), 1), (g.T.astype(float), 0)):
        assert (panels.plain_lines(lines, axis) == want).all()


def test_seamed_pictures_are_spread_over_tasks(spark, data, monkeypatch):
    from motleydex.plans import more

    parts = spark.read.parquet(f"{data}/part.parquet").count()
    monkeypatch.setattr(more, "DRAWN_A_TASK", parts // 4)
    assert more._seamed(spark, data).rdd.getNumPartitions() == -(-parts // (parts // 4))


def test_pictures_to_cut_are_spread_over_tasks(spark, data, monkeypatch):
    from motleydex.plans import more

    parts = spark.read.parquet(f"{data}/part.parquet").count()
    monkeypatch.setattr(more, "DRAWN_A_TASK", parts // 4)
    assert more._pictures(spark, data).rdd.getNumPartitions() == -(-parts // (parts // 4))
