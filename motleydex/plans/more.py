"""Further queries: files written and read again, label texts, jobs, requests, panels, evaluation, each with its SQL.

Where an operator works on something that the tables do not hold (pictures, model answers, requests), its input is
made from the tables by a rule that the SQL repeats, or the expected rows stand in the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.vectors import vector_from_json
from ..operators import embed_job, evaluation, fulltext, label_store, labels, maintenance, panels, people, vector_search
from ..operators.analysis import WordAnalyzer
from ..operators.fusion import search
from ..sources import files
from ..sources.items import aspect_vectors, items, vector_versions
from ..sources.schema import ASPECTS, SearchOptions, SearchRequest
from ..sources.tables import scratch_root, table
from ..streaming import ingest
from . import catalog as base

DRAWN_A_TASK, DRAWN_AT_ONCE = 1_000, 200


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_files(spark: SparkSession, root: str, named: dict[str, bytes]) -> None:
    for name, content in named.items():
        path, fs = files._path(spark, f"{root}/{name}")
        stream = fs.create(path, True)
        stream.write(bytearray(content))
        stream.close()


# files


def labels_file(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as one JSON array and read again."""
    path = folder(spark, "labels") + "/labels.json"
    files.write_labels_file(base._exported(spark, d), path)
    return base._label_row(files.read_labels_file(spark, path))


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cache of a label file written and read again: numbers are floats of 32 bits."""
    path = folder(spark, "cache") + "/labels.json"
    rows = base._exported(spark, d).filter(F.trim(F.coalesce("multilingual_embedding_text", F.lit(""))) != "")
    e = embed_job.LetterEmbedder()
    files.write_embedding_cache(embed_job.label_cache(rows, e), path, e.model)
    return files.read_embedding_cache(spark, path).select("meme_id", F.size("embedding").alias("numbers"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), "model")


def image_listing(spark: SparkSession, d: str) -> DataFrame:
    """The pictures of a folder with other files in it, in natural order, the first five."""
    root = folder(spark, "images")
    write_files(spark, root, {n: b"x" for n in ("2.jpg", "10.JPG", "1.png", "a.txt", "b.webp", "c.jpeg", "3.jpg.bak", "A2.Png")})
    return files.image_files(spark, root, 5).select("name", F.length("content").alias("bytes"))


def synthetic_names(spark: SparkSession, d: str) -> DataFrame:
    return files.sample_names(spark, 200, 200, 1)


def random_sample_properties(spark: SparkSession, d: str) -> DataFrame:
    """What holds for every random sample: its size, no name twice, all names known, the same for the same seed; and for one of one."""
    four, again, one = files.sample_names(spark, seed=7), files.sample_names(spark, seed=7), files.sample_names(spark, 1, seed=9)
    known = files.sample_names(spark, 200, 200, 1).select("id")
    facts = four.agg(F.count("*").alias("names"), F.countDistinct("id").alias("different"))
    return facts.crossJoin(four.join(known, "id", "left_semi").agg(F.count("*").alias("known"))).crossJoin(four.join(again, "id", "left_semi").agg(F.count("*").alias("same"))).crossJoin(one.agg(F.count("*").alias("single")))


def panels_file(spark: SparkSession, d: str) -> DataFrame:
    """Panel analyses nested, written as files and read again, block by block."""
    blocks = base._blocks(spark, d).withColumn("panel", F.lit(0)).withColumn("position", panels.position(F.col("y"), F.col("h"), F.lit(150)))
    blocks = blocks.withColumn("image", F.col("image").cast("string"))
    pictures = blocks.select("image", "panel").distinct().select("image", F.lit(400).alias("width"), F.lit(150).alias("height"), "panel", F.lit(0).alias("panel_x"), F.lit(0).alias("panel_y"), F.lit(400).alias("panel_w"), F.lit(150).alias("panel_h"))
    path = folder(spark, "panels")
    files.write_panels(panels.analysis(blocks, pictures), path)
    each = spark.read.schema(files.PANELS).json(path).select("image", F.explode("panels").alias("p")).select("image", F.col("p.id").alias("panel"), F.explode("p.text_blocks").alias("b"))
    at = lambda i: F.element_at("b.bbox", i)
    return each.select("image", "panel", at(1).alias("x"), at(2).alias("y"), at(3).alias("w"), at(4).alias("h"), F.replace("b.text", F.lit("\n"), F.lit("/")).alias("text"), "b.lines", "b.font_px", "b.position")


def captions_file(spark: SparkSession, d: str) -> DataFrame:
    root = folder(spark, "captions")
    write_files(spark, root, {"c.json": b'{"0": "first", "2": "\\u0939"}'})
    return spark.createDataFrame(sorted(files.read_captions(spark, f"{root}/c.json").items()), "panel string, caption string")


def served_files(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the service by request: a file, an absent one, an unknown path, bad requests, a reload."""
    from ..api import Service, StoredTables

    root = folder(spark, "served")
    write_files(spark, root, {"1.jpg": b"abc"})
    service = Service(spark, StoredTables(spark, folder(spark, "store")), root)
    asked = [("GET", "/memes/1.jpg", None), ("GET", "/memes/2.jpg", None), ("GET", "/memes/../1.jpg", None), ("GET", "/nothing", None), ("POST", "/search", {"query": ""}), ("POST", "/search", {"query": "a", "limit": 51}), ("POST", "/batch-search", {"queries": []}), ("POST", "/reload", None), ("GET", "/memes", None)]
    out = []
    for n, (method, path, body) in enumerate(asked):
        status, answer = service.handle(method, path, body)
        out.append((n, method, path, status, answer.decode() if isinstance(answer, bytes) else ",".join(sorted(answer))))
    return spark.createDataFrame(out, "no int, method string, path string, status int, answer string")


def command_line_export(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the command line exports and then filters by language."""
    from ..__main__ import main

    root = folder(spark, "cli")
    main(["export", d, f"{root}/all.json"], spark)
    main(["filter", f"{root}/all.json", f"{root}/some.json", "language", "hindi"], spark)
    return files.read_labels_file(spark, f"{root}/some.json").select("id", "primary_language")


# label texts


VALUES = ["true", "false", "null", '"quoted 1"', "12", "-3.50", "1e3", "0x1f", ".5", "Infinity", "", " ", "12a", "True", "1,5", '"', "+7", "१२"]
LISTS = ["a, b", "a,,b,", "one", " x , 2 , true ", ",", "a;b"]
TEXTS = [
    "id: a\nmultilingual_embedding_text: t",
    "id: a\nemotion[2]: joy,pride\nregions: delhi, goa\nintent: agree\nmultilingual_embedding_text: t",
    "# note\n\nid: b\ncaption:\n  original: x: y\n  translations:\n    hindi: z\nmultilingual_embedding_text: t",
    "id: c\nitems[2]{a,b}:\n    1,x\n    2\nmultilingual_embedding_text: t",
    "id: d\nsafety:\n  nsfw: yes\nmultilingual_embedding_text: t",
    "id: 7\nmultilingual_embedding_text: t",
    "primary_language: hindi\nmultilingual_embedding_text: t",
    "id: e\nemotion[1]: 5\nmultilingual_embedding_text: t",
    "id: f\ntags:\n  english: a, b\nquality:\n  is_meme: true\n  label_confidence: 0.5\nmultilingual_embedding_text: t",
    "id: g",
    "",
]


def value_coercion(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, (v := labels.scalar(t)) is None and "null" or type(v).__name__, "" if v is None else str(v).lower() if isinstance(v, bool) else f"{v:g}" if isinstance(v, (int, float)) else v) for t in VALUES]
    return spark.createDataFrame(rows, "text string, kind string, value string")


def comma_lists(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, "|".join(str(x).lower() for x in labels.as_list(t))) for t in LISTS], "text string, parts string")


def chat_texts(spark: SparkSession, d: str) -> DataFrame:
    answers = ["plain", None, [{"text": "a"}, {"image": 1}, {"text": "b"}], [], [{"text": 3}, "x"], 12]
    return spark.createDataFrame([(n, labels.response_text(a)) for n, a in enumerate(answers)], "no int, text string")


def label_texts(spark: SparkSession, d: str) -> DataFrame:
    """The grammar case by case: what is read, what is refused and why."""
    df = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "no int, response string")
    get = lambda p: F.coalesce(F.get_json_object("label", f"$.{p}"), F.lit(""))
    return labels.read_labels(df).select("no", F.coalesce("error", F.lit("")).alias("error"), get("id").alias("id"), get("emotion").alias("emotion"), get("regions").alias("regions"), get("intent").alias("intent"), get("caption.original").alias("original"), get("tags.english").alias("tags"), get("quality.is_meme").alias("is_meme"))


class CaseLabeler:
    """A stand-in that behaves by the number in an image's content: fine, cut off at first, always cut off, or out of reach."""

    def label(self, content: bytes, mime: str, item_id: str, attempt: int) -> str:
        case = int(content) % 4
        if case == 3:
            raise ConnectionError("no model")
        whole = labels.StubLabeler().label(content, mime, item_id, attempt)
        return whole if case == 0 or case == 1 and attempt > 1 else whole.partition(labels.REQUIRED_MARK)[0]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), F.col("p_partkey").cast("string").cast("binary").alias("content"))
    return labels.label_images(images, CaseLabeler())


def label_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Labelling with failures: cut-off answers are asked for again, up to three times, a failed request is not."""
    return _labelled(spark, d).select("path", F.col("label").isNotNull().alias("labelled"), F.coalesce("error", F.lit("")).alias("error"), "attempts")


def label_outcome(spark: SparkSession, d: str) -> DataFrame:
    return labels.outcome(_labelled(spark, d))


# jobs and tables


def pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labelling a folder and embedding, twice: the second run finds nothing to embed and rejects known ids."""
    root, images = folder(spark, "pipeline"), folder(spark, "pictures")
    write_files(spark, images, {f"{i}.jpg": b"x" * (i + 1) for i in range(3)})
    out = []
    for run in (1, 2):
        got = label_store.pipeline(spark, root, images, labels.StubLabeler(), embed_job.HashEmbedder())
        t = label_store.reload(spark, root)
        out.append((run, got["label"]["succeeded"], got["embed"]["embedded"], t["items"].count(), t["vectors"].count(), t["search_texts"].count()))
    return spark.createDataFrame(out, "run int, labelled int, embedded int, items long, vectors long, texts long")


def created_and_reset(spark: SparkSession, d: str) -> DataFrame:
    """Tables are made once, keep what is stored when they are asked for again, and are empty after a reset."""
    root = folder(spark, "tables")
    made = [len(maintenance.create_tables(spark, root))]
    rows = spark.createDataFrame([("someone", "m1")], "person_name string, meme_id string")
    rows.write.mode("append").parquet(f"{root}/people.parquet")
    made.append(len(maintenance.create_tables(spark, root)))
    before = label_store.reload(spark, root)["people"].count()
    maintenance.reset_tables(spark, root)
    after = label_store.reload(spark, root)["people"].count()
    return spark.createDataFrame([(made[0], made[1], before, after)], "made int, made_again int, rows_before long, rows_after long")


def replaced_texts(spark: SparkSession, d: str) -> DataFrame:
    """The index of search texts after those of reviewed items are replaced, twice."""
    texts = base._texts(spark, d).select("meme_id", "search_text")
    new = items(spark, d, ["id", "reviewed"]).filter("reviewed").select(F.col("id").alias("meme_id"), F.lit("new text").alias("search_text"))
    return fulltext.replace_texts(fulltext.replace_texts(texts, new), new).select("meme_id", F.length("search_text").alias("letters"))


def streamed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors filled by a stream over item files, run twice: the second run finds nothing new."""
    root = folder(spark, "stream")
    table(spark, d, "memes").write.parquet(f"{root}/items")
    for _ in range(2):
        ingest.fill_vectors(spark, f"{root}/items", f"{root}/vectors", f"{root}/checkpoint", embed_job.LetterEmbedder(), 1000).awaitTermination()
    return ingest.read_vectors(spark, f"{root}/vectors").groupBy("meme_id").agg(F.count("*").alias("vectors"), F.countDistinct("aspect").alias("aspects"))


def embed_missing_tasks(spark: SparkSession, d: str) -> DataFrame:
    """As embed_missing, with at most three calls at once, and how many items had something missing."""
    missing = embed_job.missing_aspects(items(spark, d, ["id"]), aspect_vectors(spark, d))
    texts = embed_job.aspect_texts(items(spark, d, ["id", *base.TEXTS, "emotion", "intent", "regions", "multilingual_embedding_text"]), missing)
    made = embed_job.embedded(texts, embed_job.LetterEmbedder(), 3).agg(F.count("*").alias("vectors"))
    return made.crossJoin(embed_job.embed_result(missing))


def vectors_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as JSON text and read as floats."""
    v = table(spark, d, "embeddings_main").filter("meme_id is not null and size(embedding) = 64").select("meme_id", F.to_json("embedding").alias("text")).distinct()
    return v.select("meme_id", vector_from_json(F.col("text")).alias("v")).select("meme_id", F.size("v").alias("numbers"), F.round(F.element_at("v", 2).cast("double"), 5).alias("second"))


# searches


def search_emotion(spark: SparkSession, d: str) -> DataFrame:
    v = vector_versions(spark, d)["main"]
    hits = vector_search.search(v, base.shown(spark, d, base.DISPLAY), base.query_vector(v), SearchOptions(emotion="joy", limit=30, min_similarity=0.05))
    return hits.select("id", base.r6("similarity").alias("similarity"), base.flat("emotion").alias("emotion"))


def people_empty_name(spark: SparkSession, d: str) -> DataFrame:
    """A name that is empty after normalisation matches everyone."""
    return people.exact_people(table(spark, d, "meme_people"), ["(who)"])


def search_analysed(spark: SparkSession, d: str) -> DataFrame:
    """A search whose names an analyser finds in the query."""
    vs = vector_versions(spark, d)
    request = SearchRequest("exam result of kevobedulu", limit=20, rerank=False)
    found = search(vs, base._text_versions(spark, d), table(spark, d, "meme_people"), base.shown(spark, d, base.DISPLAY), base.query_vector(vs["main"]), request, analyzer=WordAnalyzer(["kevobedulu", "tipanusopu"]))
    return found.select("rank", "id", F.round("rrf_score", 9).alias("rrf_score"))


def request_checks(spark: SparkSession, d: str) -> DataFrame:
    cases = [{"query": "a"}, {"query": ""}, {"query": 3}, {"query": "a", "limit": 0}, {"query": "a", "limit": 1}, {"query": "a", "limit": 50}, {"query": "a", "limit": 51}, {"query": "a", "rerank": "no"}, {"query": "a", "language": 5}, {"query": "a", "region": "goa", "emotion": "joy"}]
    out = []
    for n, c in enumerate(cases):
        try:
            r = SearchRequest(**c)
            out.append((n, True, r.limit))
        except ValueError:
            out.append((n, False, None))
    return spark.createDataFrame(out, "no int, accepted boolean, result_limit int")


# evaluation


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    live = items(spark, d, ["id", "meaning", "query_examples", "tags", "emotion", "intent", "regions", "multilingual_embedding_text"])
    vectors = embed_job.embedded(live.select(F.col("id").alias("meme_id"), fx.use_case_text().alias("text")), embed_job.LetterEmbedder()).select("meme_id", "embedding")
    return live.filter(base.numbered() % 50 == 0), vectors


def recall_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Recall within 10 of the items' own use-case texts for their example queries (ids divisible by 50)."""
    some, vectors = _cases(spark, d)
    ranked = evaluation.hits(evaluation.golden_cases(some), vectors, embed_job.LetterEmbedder(), 10)
    return evaluation.recall(ranked, 10).select("lang", "cases", "found", base.r6("recall").alias("recall"))


def recall_failures(spark: SparkSession, d: str) -> DataFrame:
    """The example queries that do not find their own item within 10."""
    some, vectors = _cases(spark, d)
    ranked = evaluation.hits(evaluation.golden_cases(some), vectors, embed_job.LetterEmbedder(), 10)
    return evaluation.failures(ranked, 10).select("id", "lang", "at", "query")


def crosslingual_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall within 8 for the same request in three languages."""
    some, vectors = _cases(spark, d)
    cases = evaluation.crosslingual_cases(some.withColumn("image_path", F.lit(None).cast("string")))
    long = cases.select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.col(x).alias("query")) for x in evaluation.LANGS])).alias("c")).select("id", "c.*")
    return evaluation.recall(evaluation.hits(long, vectors, embed_job.LetterEmbedder(), 8), 8).select("lang", "cases", "found", base.r6("recall").alias("recall"))


def hit_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every query has exactly five hits, and their similarities are cosines."""
    some, vectors = _cases(spark, d)
    queries = evaluation.golden_cases(some).select(F.col("query").alias("text")).distinct()
    asked = embed_job.embedded(queries, embed_job.LetterEmbedder()).select(F.col("text").alias("query_id"), F.col("embedding").alias("vector"))
    hits = vector_search.nearest_for_queries(vectors, asked, 5).groupBy("query_id").agg(F.count("*").alias("hits"), F.min(F.col("similarity").between(-1.01, 1.01)).alias("cosines"))
    return hits.select(F.col("query_id").alias("query"), "hits", "cosines")


# pictures


def _drawn(spark: SparkSession, d: str, draw: Callable[[int, int], np.ndarray]) -> DataFrame:
    """Gray pictures drawn from (p_partkey, p_size), spread over tasks by their number: a part is some bytes in its file, its picture thousands of times that."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, DRAWN_AT_ONCE):
                some = b.slice(at, DRAWN_AT_ONCE)
                keys, pictures = some.column(0).to_pylist(), [draw(*row) for row in zip(*(some.column(k).to_pylist() for k in range(2)))]
                values = ([str(k) for k in keys], [g.shape[1] for g in pictures], [g.shape[0] for g in pictures], [g.tobytes() for g in pictures])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["image", "width", "height", "pixels"])

    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int"))
    return parts.repartition(max(1, -(-parts.count() // DRAWN_A_TASK)), "p_partkey").mapInArrow(run, "image string, width int, height int, pixels binary")


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """Gray pictures of 120 x 200 by part: a pattern with a bright gutter of four rows at 45 + p_size, and every third also with one of five columns at 50."""
    y, x = np.mgrid[0:200, 0:120]
    pattern = ((x * 37 + y * 11 + x * y % 7 * 23) % 190 + 30).astype(np.uint8)

    def draw(key: int, size: int) -> np.ndarray:
        g = pattern.copy()
        if key % 3 == 0:
            g[:, 50:55] = 0
        g[45 + size : 49 + size] = 255
        return g

    return _drawn(spark, d, draw)


def detected_panels(spark: SparkSession, d: str) -> DataFrame:
    return panels.detect_panels(_pictures(spark, d)).select("image", "panel", "panel_x", "panel_y", "panel_w", "panel_h")


def _seamed(spark: SparkSession, d: str) -> DataFrame:
    """Gray pictures of 160 x 240 by part: two flat halves of different gray without a gutter, cut at row 80 + p_size."""

    def draw(key: int, size: int) -> np.ndarray:
        g = np.full((240, 160), 90, np.uint8)
        g[80 + size :] = 170
        return g

    return _drawn(spark, d, draw)


def seamed_panels(spark: SparkSession, d: str) -> DataFrame:
    """How many panels a picture without gutters has, whether they cover it, and whether the cut is within two rows of its seam."""
    found = panels.detect_panels(_seamed(spark, d)).groupBy("image").agg(F.count("*").cast("int").alias("panels"), F.sum(F.col("panel_w") * F.col("panel_h")).cast("int").alias("pixels"), F.max("panel_y").alias("cut"))
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("image"), "p_size")
    return found.join(parts, "image").select("image", "panels", "pixels", (F.abs(F.col("cut") - 80 - F.col("p_size")) <= 2).alias("at_seam"))


def ink_votes(spark: SparkSession, d: str) -> DataFrame:
    """The colour of text by counted pixels: pictures of 20 x 10 with p_size dark and 30 bright pixels on gray."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for key, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = np.full((200, 3), 128, np.uint8)
                g[:size], g[100:130] = 10, 250
                out.append((str(key), 20, 10, g.tobytes(), 0, 0, 20, 10))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["image", "width", "height", "pixels", "x", "y", "w", "h"])

    pictures = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int")).mapInArrow(run, "image string, width int, height int, pixels binary, x int, y int, w int, h int")
    return panels.ink_counts(pictures).select("image", "bright", "dark", panels.ink(F.col("bright"), F.col("dark")).alias("ink"))


def flat_rows(spark: SparkSession, d: str) -> DataFrame:
    """The spread and mean of a picture's rows that a gutter is told by: how many rows are of one colour."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for image, w, h, pixels in zip(*(b.column(k).to_pylist() for k in range(4))):
                g = np.frombuffer(pixels, np.uint8).reshape(h, w).astype(float)
                flat = g.std(axis=1) < panels.FLAT
                out.append((image, int(flat.sum()), float(g.mean(axis=1)[flat].mean()) if flat.any() else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["image", "rows", "mean"])

    return _pictures(spark, d).mapInArrow(run, "image string, rows int, mean double")


PLAIN = (
    labels_file, embedding_cache, image_listing, synthetic_names, random_sample_properties, panels_file, captions_file, served_files, command_line_export, value_coercion, comma_lists, chat_texts, label_texts, label_attempts, label_outcome,
    pipeline_counts, created_and_reset, replaced_texts, streamed_vectors, embed_missing_tasks, vectors_from_text, search_emotion, people_empty_name, search_analysed, request_checks, recall_by_language, recall_failures, crosslingual_recall,
    hit_invariants, detected_panels, seamed_panels, ink_votes, flat_rows,
)
MADE = {"filter_unknown": base._filtered("colour", "red"), "filter_empty": base._filtered("language", "")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in PLAIN} | MADE
