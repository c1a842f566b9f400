"""The queries over the engine's operators: each reads whole tables and names all its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.vectors import cosine
from ..operators import embed_job, evaluation, fulltext, fusion, labels, maintenance, panels, people, rerank, vector_search
from ..operators.labels_query import label_hits
from ..sources import files
from ..sources.items import Items, aspect_vectors, items, usable, vector_versions, versions
from ..sources.schema import SearchOptions, SearchRequest
from ..sources.tables import table
from ..streaming import ingest

QUERY_TEXT = "exam result"
QUERY_AT = 3
DISPLAY = ["id", "image_path", "primary_language", "supported_languages", "caption", "emotion", "regions", "intent", "popularity_score", "people", "source", "scene_description", "meaning"]
TEXTS = ["caption", "ocr_text", "image_description", "scene_description", "meaning", "source", "people", "cultural_references", "tags", "query_examples"]
NAMES = ["Arvind Tipanusopu (ALT)", "Kevobedulu"]


def query_vector(vectors: DataFrame, at: int = QUERY_AT) -> list[float]:
    """A fixed query: the vector of the id at a place of the order; one row goes to the driver."""
    if "created_at" in vectors.columns:
        # the first ids, then their versions: the vectors of all others stay where they are
        ids = vectors.select("meme_id").distinct().orderBy("meme_id").limit(at + 1).collect()
        rows = vectors.filter(F.col("meme_id") == (ids[-1][0] if ids else None)).orderBy(F.desc_nulls_last("created_at"), "embedding").limit(1).collect()
    else:
        rows = vectors.orderBy("meme_id").limit(at + 1).collect()
    return [float(x) for x in rows[-1].embedding] if rows else [0.0]


def shown(spark: SparkSession, d: str, columns: list[str]) -> Items:
    return Items(table(spark, d, "memes"), columns)


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def flat(c: str) -> Column:
    return F.array_join(c, ",", "")


def vec_topk_main(spark: SparkSession, d: str) -> DataFrame:
    v = vector_versions(spark, d)["main"]
    return vector_search.nearest(v, query_vector(v), 50).select("meme_id", r6("similarity").alias("similarity"))


def vec_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = vector_versions(spark, d)["main"]
    return vector_search.search_aspect(v, shown(spark, d, ["id"]), query_vector(v), 200, 0.1).select("pos", "meme_id", r6("similarity").alias("similarity"))


def vec_search_legacy(spark: SparkSession, d: str) -> DataFrame:
    v = vector_versions(spark, d)["main"]
    hits = vector_search.search(v, shown(spark, d, DISPLAY), query_vector(v), SearchOptions(language="hinglish", limit=20, min_similarity=0.1))
    return hits.select("id", "image_path", r6("similarity").alias("similarity"), flat("supported_languages").alias("languages"))


def numbered(c: str = "id") -> Column:
    """The number in an id."""
    return F.conv(F.substring(c, 6, 8), 16, 10).cast("long")


def batch_vec_search(spark: SparkSession, d: str) -> DataFrame:
    v = aspect_vectors(spark, d)["main"]
    queries = v.filter(numbered("meme_id") % 50 == 0).select(F.col("meme_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit("hindi").alias("language"), F.lit("delhi").alias("region"))
    out = vector_search.batch_search(v, shown(spark, d, ["id", "image_path", "primary_language", "supported_languages", "regions", "caption", "popularity_score"]), queries)
    return out.select("query_id", "rank", "id", r6("similarity").alias("similarity"), r6("score").alias("score"))


def labels_json_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vector_versions(spark, d)["main"]
    return label_hits(v, items(spark, d, ["id", "image_path", "caption"]), query_vector(v), 40).select("id", r6("similarity").alias("similarity"), "image_path", "caption_original")


def zero_norm_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = aspect_vectors(spark, d)["main"]
    every = table(spark, d, "embeddings_main").filter(usable("embedding", 64))
    return every.select("meme_id", r6(cosine(F.col("embedding"), vector_search.as_vector(query_vector(v)))).alias("similarity")).distinct()


def _rankings(spark: SparkSession, d: str, least: float, k: int = 80) -> list[DataFrame]:
    vs = vector_versions(spark, d)
    q = query_vector(vs["main"])
    ids = shown(spark, d, ["id"])
    return [vector_search.search_aspect(vs[a], ids, q, k, least) for a in ("main", "people", "context", "use_case")]


def multi_aspect_rankings(spark: SparkSession, d: str) -> DataFrame:
    return fusion.union_rankings(_rankings(spark, d, 0.1))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf(fusion.union_rankings(_rankings(spark, d, 0.1)))
    return fused.orderBy(*fusion.fused_order()).limit(120).select("meme_id", F.round("rrf_score", 9).alias("rrf_score"), "first_list", "first_pos")


def rrf_double_weight_people(spark: SparkSession, d: str) -> DataFrame:
    exact = people.exact_people(table(spark, d, "meme_people"), NAMES)
    fused = fusion.rrf(fusion.union_rankings([exact, exact, *_rankings(spark, d, 0.1)]))
    return fused.select("meme_id", F.round("rrf_score", 9).alias("rrf_score"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.build_search_texts(items(spark, d, ["id", *TEXTS]))


def _text_versions(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.build_search_texts(versions(spark, d, ["id", *TEXTS]))


def _search(spark: SparkSession, d: str, request: SearchRequest, reranker: rerank.Reranker | None = None, names: list[str] | None = None) -> DataFrame:
    vs = vector_versions(spark, d)
    return fusion.search(vs, _text_versions(spark, d), table(spark, d, "meme_people"), shown(spark, d, DISPLAY), query_vector(vs["main"]), request, reranker, names)


def fused_search_filters(spark: SparkSession, d: str) -> DataFrame:
    vs = vector_versions(spark, d)
    options = SearchOptions("hinglish", "delhi", None, 30, 0.1)
    hits = fusion.fused_search(vs, _text_versions(spark, d), table(spark, d, "meme_people"), shown(spark, d, DISPLAY), query_vector(vs["main"]), QUERY_TEXT, NAMES, options)
    return hits.select("pos", "id", F.round("rrf_score", 9).alias("rrf_score"))


def rank_boosts(spark: SparkSession, d: str) -> DataFrame:
    hits = items(spark, d, ["id", "primary_language", "regions", "popularity_score"]).select("*", F.lit(None).cast("double").alias("rrf_score"), F.lit(0.5).alias("similarity"), F.lit(0).alias("pos"))
    score = F.lit(50.0) + fusion.boosts(SearchOptions("hindi", "pan_india"))
    return hits.select("id", r6(score).alias("score"))


def _answer(df: DataFrame) -> DataFrame:
    return df.select("rank", "id", "image_path", "caption", flat("emotion").alias("emotion"), flat("regions").alias("regions"), "source", F.round("rrf_score", 9).alias("rrf_score"), F.round("cross_score", 6).alias("cross_score"), r6("score").alias("score"), "total_results")


def search_end_to_end_no_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _answer(_search(spark, d, SearchRequest(QUERY_TEXT, language="hindi", limit=20, rerank=False)))


def search_rerank_failed(spark: SparkSession, d: str) -> DataFrame:
    return _answer(_search(spark, d, SearchRequest(QUERY_TEXT, limit=20), rerank.FailingReranker(), NAMES))


def search_end_to_end_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _answer(_search(spark, d, SearchRequest(QUERY_TEXT, region="delhi", limit=20)))


def people_normalise(spark: SparkSession, d: str) -> DataFrame:
    return people.index_people(items(spark, d, ["id", "people"]))


def people_exact(spark: SparkSession, d: str) -> DataFrame:
    return people.exact_people(table(spark, d, "meme_people"), NAMES)


def people_index_merge(spark: SparkSession, d: str) -> DataFrame:
    return people.add_people(table(spark, d, "meme_people"), people.index_people(items(spark, d, ["id", "people"])))


def fts_doc_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).select("meme_id", fx.terms(F.col("search_text")).alias("t"))
    return t.select("meme_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("distinct_terms"))


def fts_postings(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.postings(_texts(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _bm25(query: str, limit: int = 100) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fulltext.bm25(_text_versions(spark, d), query, limit).select("pos", "meme_id", r6("score").alias("score"))

    return run


def _texts_of(name: str, column: Callable[[], Column], columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return items(spark, d, ["id", *columns]).select("id", column().alias(name))

    return run


def missing_aspects(spark: SparkSession, d: str) -> DataFrame:
    out = embed_job.missing_aspects(items(spark, d, ["id"]), aspect_vectors(spark, d))
    return out.select("id", F.array_join("missing", ",").alias("missing"))


def fts_backfill_todo(spark: SparkSession, d: str) -> DataFrame:
    live = items(spark, d, ["id", "reviewed"])
    return embed_job.texts_to_search(live, live.filter("reviewed").select(F.col("id").alias("meme_id"))).select("id")


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "embeddings_main").filter("meme_id is not null").withColumn("aspect", F.lit("main"))
    return embed_job.upsert_vectors(old.filter("created_at is not null"), old.filter("created_at is null")).select("meme_id", "aspect", F.size("embedding").alias("numbers"), "created_at")


def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    columns = ["id", *TEXTS, "emotion", "intent", "regions", "multilingual_embedding_text"]
    made = embed_job.embed_missing(items(spark, d, columns), aspect_vectors(spark, d), embed_job.HashEmbedder())
    return made.select("meme_id", "aspect", F.size("embedding").alias("numbers"))


def stats_single_row(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.stats(aspect_vectors(spark, d), items(spark, d, ["id"]), table(spark, d, "meme_people"), _texts(spark, d))


def _exported(spark: SparkSession, d: str, prefix: str | None = None) -> DataFrame:
    return maintenance.export_labels(items(spark, d, list(maintenance.EXPORTED), raw=True), prefix)


def _label_row(df: DataFrame) -> DataFrame:
    return df.select("id", "image_path", "primary_language", flat("supported_languages").alias("languages"), F.col("caption.original").alias("original"), flat("emotion").alias("emotion"), flat("regions").alias("regions"), F.col("safety.nsfw").alias("nsfw"), r6("quality.label_confidence").alias("confidence"), "reviewed")


def export_labels(spark: SparkSession, d: str) -> DataFrame:
    return _label_row(_exported(spark, d))


def export_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _label_row(_exported(spark, d, "MEMES/1_/"))


def _filtered(key: str, value: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return maintenance.filter_labels(_exported(spark, d), key, value).select("id", "primary_language", "reviewed")

    return run


def insert_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memes").select("id", "labeled_at")
    stored = rows.filter("labeled_at is null").select("id").distinct()
    accepted, rejected = maintenance.insert_items(stored, rows)
    return accepted.select("id", F.lit("accepted").alias("outcome")).unionByName(rejected.select("id", F.lit("rejected").alias("outcome"))).groupBy("outcome", "id").agg(F.count("*").alias("rows"))


def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return files.sample_names(spark, seed=7)


def natural_sort_names(spark: SparkSession, d: str) -> DataFrame:
    names = items(spark, d, ["id", "image_path"]).select("id", F.element_at(F.split("image_path", "/"), -1).alias("name")).filter(F.col("name").rlike(files.IMAGES))
    return names.select("id", "name", fx.natural_key(F.col("name")).alias("sort_key"))


def ocr_words(spark: SparkSession, d: str) -> DataFrame:
    """Word boxes derived from lineitem: a picture per order."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"),
        (F.col("l_suppkey") % 2).cast("int").alias("block_num"),
        F.lit(1).alias("par_num"),
        F.floor(F.col("l_linenumber") / 2).cast("int").alias("line_num"),
        F.col("l_linenumber").cast("int").alias("word_num"),
        (F.col("l_partkey") % 400).cast("int").alias("left"),
        (F.floor(F.col("l_linenumber") / 2) * 30 + F.col("l_partkey") % 5 * 8).cast("int").alias("top"),
        (F.lit(20) + F.col("l_quantity")).cast("int").alias("width"),
        (F.lit(10) + F.col("l_suppkey") % 12).cast("int").alias("height"),
        (F.col("l_partkey") * 7 % 101).cast("int").alias("conf"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
    )


def ocr_line_islands(spark: SparkSession, d: str) -> DataFrame:
    lines = panels.line_groups(panels.text_lines(ocr_words(spark, d), ["image"]), ["image"])
    return lines.select("image", "block_num", "line_num", "x", "y", "x2", "y2", "h", "text", "grp")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return panels.text_blocks(panels.line_groups(panels.text_lines(ocr_words(spark, d), ["image"]), ["image"]), ["image"])


def ocr_block_summary(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("image", "block_num", "grp", "x", "y", "w", "h", F.replace("text", F.lit("\n"), F.lit("/")).alias("text"), "lines", "font_px")


def block_position(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("image", "block_num", "grp", panels.position(F.col("y"), F.col("h"), F.lit(150)).alias("position"))


def caption_region(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 300).cast("int").alias("px"), (F.col("p_size") * 3).cast("int").alias("py"), (F.lit(60) + F.col("p_size") * 7).cast("int").alias("pw"), (F.lit(45) + F.col("p_partkey") % 500).cast("int").alias("ph"))
    region = panels.caption_region(F.col("px"), F.col("py"), F.col("pw"), F.col("ph"))
    return p.select("p_partkey", region.alias("r")).select("p_partkey", F.col("r.x").alias("x"), F.col("r.y").alias("y"), F.col("r.w").alias("w"), F.col("r.h").alias("h"))


def strip_coverage(spark: SparkSession, d: str) -> DataFrame:
    region = panels.caption_region(F.lit(0), F.lit(0), F.lit(400), F.lit(200))
    boxes = _blocks(spark, d).groupBy("image").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("boxes"))
    covered = boxes.select("image", panels.strip_coverage(region, F.col("boxes")).alias("c"))
    return covered.select("image", r6("c").alias("coverage"), (F.col("c") < panels.COVERED).alias("clear"))


def panel_anchors(spark: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(spark, d).withColumn("panel", F.lit(0))
    pictures = blocks.select("image", "panel").distinct().select("image", "panel", F.lit(0).alias("panel_x"), F.lit(0).alias("panel_y"), F.lit(400).alias("panel_w"), F.lit(200).alias("panel_h"))
    return panels.anchors(pictures, blocks, {"0": "hello"}).select("image", "font_px", F.col("color_box.x").alias("x"), F.col("color_box.w").alias("w"), "clear", "shared_px", "caption")


def golden_cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.golden_cases(items(spark, d, ["id", "query_examples"]))


def crosslingual_cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.crosslingual_cases(items(spark, d, ["id", "image_path", "query_examples"]))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the items' own use-case texts for their example queries of ids divisible by 50, with a stand-in embedder."""
    live = items(spark, d, ["id", "meaning", "query_examples", "tags", "emotion", "intent", "regions", "multilingual_embedding_text"])
    e = embed_job.LetterEmbedder()
    vectors = embed_job.embedded(live.select(F.col("id").alias("meme_id"), fx.use_case_text().alias("text")), e).select("meme_id", "embedding")
    cases = evaluation.golden_cases(live.filter(numbered() % 50 == 0))
    return evaluation.recall(evaluation.hits(cases, vectors, e, 10), 10)


def toon_parse(spark: SparkSession, d: str) -> DataFrame:
    live = items(spark, d, ["id", "primary_language", "emotion", "caption"])
    text = F.concat(F.lit("id: "), "id", F.lit("\nprimary_language: "), F.coalesce("primary_language", F.lit("unknown")), F.lit("\nemotion[3]: "), flat("emotion"), F.lit("\ncaption:\n  original: "), F.regexp_replace(F.coalesce("caption.original", F.lit("none")), "[\r\n]+", " "), F.lit("\nmultilingual_embedding_text: text"))
    return labels.read_labels(live.select("id", text.alias("response"))).select("id", "error", F.get_json_object("label", "$.caption.original").alias("original"), F.get_json_object("label", "$.quality.is_meme").alias("is_meme"))


def description_text(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d, DISPLAY).select("id", fx.description().alias("description"))


def migrate_columns(spark: SparkSession, d: str) -> DataFrame:
    old = items(spark, d, ["id", "image_path", "source"], raw=True)
    return maintenance.migrate_items(old).select("id", "ocr_text", "people", "source", "scene_description")


def pk_multi_get(spark: SparkSession, d: str) -> DataFrame:
    """Full rows of given ids, with the fallbacks for missing values: those divisible by 50."""
    ids = table(spark, d, "memes").select("id").filter(numbered() % 50 == 0)
    return result_rows(shown(spark, d, DISPLAY).among(ids))


def result_rows(df: DataFrame) -> DataFrame:
    """The columns of a result, empty values for null ones."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select("id", "image_path", "primary_language", *[flat(c).alias(c) for c in ("supported_languages", "emotion", "regions", "people")], F.to_json("intent").alias("intent"), F.coalesce("popularity_score", F.lit(0)).alias("popularity_score"), text("source"), text("scene_description"))


def result_defaults(spark: SparkSession, d: str) -> DataFrame:
    return result_rows(items(spark, d, DISPLAY))


def shown_captions(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d, ["id", "caption"]).select("id", fx.shown_caption().alias("caption"))


def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.vector_stats(aspect_vectors(spark, d), 64)


def media_and_time(spark: SparkSession, d: str) -> DataFrame:
    live = items(spark, d, ["id", "image_path", "labeled_at"])
    return live.select("id", fx.mime(F.col("image_path")).alias("mime"), fx.iso_time(F.col("labeled_at")).alias("labeled_at"))


def clamp_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 90).cast("int").alias("x"), (F.col("p_size") % 60).cast("int").alias("y"), F.col("p_size").cast("int").alias("w"), (F.col("p_partkey") % 70).cast("int").alias("h"))
    return p.select("p_partkey", panels.clamped(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(100), F.lit(80)).alias("c")).select("p_partkey", "c.*")


def panel_segments(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", panels.segments(F.array((F.col("p_size") * 3).cast("int"), F.lit(40)), F.lit(200)).alias("s"))
    return p.select("p_partkey", F.posexplode("s").alias("no", "v")).select("p_partkey", "no", F.col("v.start").alias("start"), F.col("v.end").alias("end"))


def debounce_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.debounced(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "1 hour").select("event_id", "user_id")


PLAIN = (
    vec_topk_main, vec_topk_threshold, vec_search_legacy, batch_vec_search, labels_json_topk, zero_norm_cosine, multi_aspect_rankings, rrf_fusion, rrf_double_weight_people, fused_search_filters, rank_boosts,
    search_end_to_end_no_rerank, search_rerank_failed, search_end_to_end_rerank, people_normalise, people_exact, people_index_merge, fts_doc_stats, fts_postings, missing_aspects, fts_backfill_todo, vector_upsert, embed_missing,
    stats_single_row, export_labels, export_prefix, insert_duplicates, random_sample, natural_sort_names, ocr_line_islands, ocr_block_summary, block_position, caption_region, strip_coverage, panel_anchors, golden_cases, crosslingual_cases,
    recall_at_k, toon_parse, description_text, migrate_columns, pk_multi_get, result_defaults, shown_captions, vector_stats, media_and_time, clamp_boxes, panel_segments, debounce_events,
)
MADE = {
    "bm25_single": _bm25("exam"),
    "bm25_and": _bm25("exam result"),
    "bm25_or_not": _bm25("wedding OR salary NOT phone"),
    "bm25_phrase": _bm25('"cricket match"'),
    "bm25_prefix": _bm25("home*"),
    "bm25_syntax_error": _bm25("what?"),
    "search_text_build": _texts_of("search_text", fx.search_text, TEXTS),
    "search_text_backfill": _texts_of("search_text", lambda: fx.search_text(True), TEXTS),
    "aspect_people_text": _texts_of("text", fx.people_text, ["people", "source", "cultural_references", "ocr_text"]),
    "aspect_context_text": _texts_of("text", fx.context_text, ["scene_description", "image_description", "source", "cultural_references", "ocr_text", "caption", "people"]),
    "aspect_usecase_text": _texts_of("text", fx.use_case_text, ["meaning", "query_examples", "tags", "emotion", "intent", "regions", "multilingual_embedding_text"]),
    "filter_language": _filtered("language", "hindi"),
    "filter_emotion": _filtered("emotion", "joy"),
    "filter_region": _filtered("region", "delhi"),
    "filter_reviewed": _filtered("reviewed", "true"),
    "filter_nsfw": _filtered("nsfw", "false"),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a whole search."""
    return search_end_to_end_no_rerank(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more

    return {f.__name__: f for f in PLAIN} | MADE | more.queries()


def oracle_sql() -> dict[str, str]:
    from . import more_oracle, oracle

    return oracle.SQL | more_oracle.SQL
