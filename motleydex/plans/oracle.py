"""SQL for the queries of the catalogue, in DuckDB's dialect, written from the definitions and not from the plans."""

from __future__ import annotations

from ..functions.text import diacritics

ACCENTED, PLAIN = diacritics()


def lst(c: str) -> str:
    return f"(CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN from_json({c}, '[\"VARCHAR\"]') ELSE []::VARCHAR[] END)"


def at(c: str, path: str) -> str:
    return f"(CASE WHEN json_valid({c}) THEN json_extract_string({c}, '$.{path}') END)"


def sub(c: str, path: str) -> str:
    inner = f"json_extract({c}, '$.{path}')"
    return f"(CASE WHEN json_valid({c}) AND json_type({c}) = 'OBJECT' AND json_type({inner}) = 'ARRAY' THEN from_json({inner}, '[\"VARCHAR\"]') ELSE []::VARCHAR[] END)"


INTENT = f"(CASE WHEN json_valid(intent) AND json_type(intent) = 'VARCHAR' THEN [json_extract_string(intent, '$')] ELSE {lst('intent')} END)"
LIVE = "live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY labeled_at DESC NULLS LAST) AS rn_ FROM memes WHERE id IS NOT NULL) WHERE rn_ = 1)"
ITEM = f"""item AS (SELECT id, image_path, primary_language, {lst("supported_languages")} AS langs, {at("caption", "original")} AS original, {at("caption", "translations.english")} AS cap_en,
 {lst("emotion")} AS emotion, {INTENT} AS intent, {lst("regions")} AS regions, {lst("people")} AS people, {lst("cultural_references")} AS refs, source, scene_description, image_description, ocr_text, popularity_score,
 multilingual_embedding_text AS met, labeled_at, reviewed, {", ".join(f"{at('meaning', x)} AS m_{x}" for x in ("english", "hindi", "hinglish", "tamil", "telugu"))},
 {", ".join(f"{sub('tags', x)} AS t_{x}" for x in ("english", "hindi", "hinglish", "tamil", "telugu"))}, {", ".join(f"{sub('query_examples', x)} AS q_{x}" for x in ("english", "hindi", "hinglish", "tamil", "telugu"))} FROM live)"""
USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def vec(name: str) -> str:
    return f"v_{name} AS (SELECT meme_id, embedding::DOUBLE[] AS e FROM (SELECT *, row_number() OVER (PARTITION BY meme_id ORDER BY created_at DESC NULLS LAST) AS rn_ FROM embeddings_{name} WHERE meme_id IS NOT NULL AND {USABLE}) WHERE rn_ = 1)"


VECTORS = f"{vec('main')}, {vec('people')}, {vec('context')}, q AS (SELECT e AS qe FROM v_main ORDER BY meme_id LIMIT 1 OFFSET 3)"


def cos(a: str, b: str) -> str:
    zero = lambda v: f"list_sum(list_transform({v}, lambda x: abs(x))) = 0"
    return f"(CASE WHEN {zero(a)} OR {zero(b)} THEN 0.0 ELSE list_cosine_similarity({a}, {b}) END)"


def top(name: str, k: int) -> str:
    return f"(SELECT meme_id, {cos('e', 'qe')} AS s FROM v_{name}, q ORDER BY s DESC, meme_id LIMIT {k})"


def ranking(no: int, name: str, k: int, least: float) -> str:
    return f"SELECT {no} AS list_no, meme_id, row_number() OVER (ORDER BY s DESC, meme_id)::INT AS pos FROM {top(name, k)} WHERE s >= {least} AND meme_id IN (SELECT id FROM live)"


def lists(first: int, k: int, least: float) -> str:
    return " UNION ALL ".join(ranking(first + i, n, k, least) for i, n in enumerate(("main", "people", "context", "context")))


NAMES = ["Arvind Tipanusopu (ALT)", "Kevobedulu"]
NORMAL = "trim(regexp_replace(lower({}), '\\s*\\(.*?\\)', '', 'g'))"
def exact_of(names: list[str]) -> str:
    asked = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"""asked AS (SELECT ord, {NORMAL.format("raw")} AS wanted FROM (VALUES {asked}) t(ord, raw)),
 hits AS (SELECT ord, meme_id, row_number() OVER (PARTITION BY ord ORDER BY person_name, meme_id) AS n FROM meme_people, asked WHERE contains(person_name, wanted)),
 exact AS (SELECT meme_id, row_number() OVER (ORDER BY a.ord, a.n, meme_id)::INT AS pos FROM (SELECT meme_id, min({{'ord': ord, 'n': n}}) AS a FROM hits WHERE n <= 50 GROUP BY meme_id))"""


EXACT = exact_of(NAMES)
FUSE = "fused AS (SELECT meme_id, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS rrf, min(list_no * 1000000 + pos) AS first FROM lists GROUP BY meme_id)"


def joined(c: str, sep: str = ", ") -> str:
    return f"array_to_string({c}, '{sep}')"


def filled(parts: list[str], sep: str = " ") -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL AND x <> ''), '{sep}')"


def sentence(prefix: str, x: str) -> str:
    return f"(CASE WHEN length({x}) > 0 THEN '{prefix}' || {x} || '.' ELSE '' END)"


def many(prefix: str, c: str, sep: str = ", ") -> str:
    return f"(CASE WHEN len({c}) > 0 THEN '{prefix}' || {joined(c, sep)} || '.' ELSE '' END)"


def tr(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"


def cat(prefix: str, langs: tuple[str, ...]) -> str:
    return "list_concat(" * (len(langs) - 1) + f"{prefix}_{langs[0]}" + "".join(f", {prefix}_{x})" for x in langs[1:])


def all_of(*lists_: str) -> str:
    out = lists_[0]
    for x in lists_[1:]:
        out = f"list_concat({out}, {x})"
    return out


EN_HG = ("english", "hinglish")
ORDER = ("english", "hinglish", "hindi", "tamil", "telugu")
HEAD = "[original, cap_en, ocr_text, image_description, scene_description, m_english, m_hinglish]"
SEARCH_TEXT = f"array_to_string(list_filter({all_of(HEAD, '[source]', 'people', 'refs', cat('t', EN_HG), cat('q', EN_HG))}, lambda x: x IS NOT NULL AND x <> ''), ' ')"
BACKFILL_TEXT = f"array_to_string(list_filter({all_of(HEAD, cat('t', EN_HG), cat('q', EN_HG), 'people', 'refs', '[source]')}, lambda x: x IS NOT NULL AND x <> ''), ' ')"
PEOPLE_TEXT = filled([many("People: ", "people"), many("Names: ", "people", " "), sentence("Source: ", tr("source")), sentence("Origin: ", tr("source")), many("Cultural references: ", "refs", ". "), sentence("OCR text: ", tr("ocr_text"))])
CONTEXT_TEXT = filled([sentence("Scene: ", tr("scene_description")), sentence("Visual: ", tr("image_description")), sentence("Source/Origin: ", tr("source")), many("Cultural: ", "refs", ". "), sentence("Text in image: ", tr("ocr_text")), sentence("Caption: ", "original"), many("People: ", "people")])
USE_TEXT = filled([sentence(f"Meaning ({x.capitalize()}): ", f"m_{x}") for x in ("english", "hindi", "hinglish", "tamil", "telugu")] + [sentence("When to use: ", joined(cat("q", ORDER))), sentence("Tags: ", joined(cat("t", ORDER))), many("Emotion: ", "emotion"), many("Intent: ", "intent"), many("Region: ", "regions")])
CAPTION = "coalesce(cap_en, original, '')"
TERMS = f"regexp_extract_all(translate(regexp_replace(lower(coalesce(search_text, '')), '[̀-ͯ]', '', 'g'), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
FTS = f"texts AS (SELECT id AS meme_id, {SEARCH_TEXT} AS search_text FROM item), toks AS (SELECT meme_id, {TERMS} AS t FROM texts)"


def bm25(phrases: list[tuple[str, str]], where: str, limit: int = 100, name: str = "bm") -> str:
    """CTEs that end in ``name`` (meme_id, score, pos); a phrase is (name, SQL for its count in t)."""
    tf = ", ".join(f"{sql} AS {n}" for n, sql in phrases)
    n_ = ", ".join(f"sum(({n} > 0)::INT) AS n_{n}" for n, _ in phrases)
    part = " + ".join(f"greatest(ln((N - n_{n} + 0.5) / (n_{n} + 0.5)), 0.000001) * {n} * 2.2::DOUBLE / ({n} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for n, _ in phrases)
    return f"counted AS (SELECT meme_id, len(t) AS dl, {tf} FROM toks), corpus AS (SELECT count(*)::DOUBLE AS N, avg(dl) AS avgdl, {n_} FROM counted), scored AS (SELECT meme_id, round({part}, 9) AS score FROM counted, corpus WHERE {where}), {name} AS (SELECT meme_id, score, row_number() OVER (ORDER BY score DESC, meme_id)::INT AS pos FROM (SELECT * FROM scored ORDER BY score DESC, meme_id LIMIT {limit}))"


def word(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


def _bm(phrases: list[tuple[str, str]], where: str) -> str:
    return f"WITH {LIVE}, {ITEM}, {FTS}, {bm25(phrases, where)} SELECT pos, meme_id, round(score, 6) AS score FROM bm"


EXAM_RESULT = [("a", word("exam")), ("b", word("result"))]
BOOST = "(CASE WHEN primary_language = '{lang}' THEN 20 ELSE 0 END) + (CASE WHEN list_contains(regions, '{region}') THEN 15 ELSE 0 END) + (CASE WHEN list_contains(regions, 'pan_india') THEN 5 ELSE 0 END) + least(coalesce(popularity_score, 0), 50) * 0.2::DOUBLE"


def searched(limit: int, least: float, names: list[str] | None, where: str = "TRUE", phrases: list[tuple[str, str]] = EXAM_RESULT, where_text: str = "a > 0 AND b > 0") -> str:
    """CTEs from the tables to ``found``: the fused hits with their place."""
    k = max(limit * 8, 80)
    exact = "SELECT 1 AS list_no, meme_id, pos FROM exact UNION ALL SELECT 2, meme_id, pos FROM exact UNION ALL " if names else ""
    extra = f"{exact_of(names)}, " if names else ""
    return f"""WITH {LIVE}, {ITEM}, {VECTORS}, {FTS}, {bm25(phrases, where_text, k)}, {extra}lists AS ({exact}{lists(3, k, least)} UNION ALL SELECT 7, meme_id, pos FROM bm),
 {FUSE}, sliced AS (SELECT * FROM fused ORDER BY rrf DESC, first LIMIT {limit * 4}), found AS (SELECT item.*, rrf, row_number() OVER (ORDER BY rrf DESC, first)::INT AS pos FROM sliced JOIN item ON id = meme_id WHERE {where})"""


def answer(cross: str, base: str, boost: str, limit: int, source: str = "found") -> str:
    return f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, pos)::INT AS rank, id, image_path, {CAPTION} AS caption, {joined("emotion", ",")} AS emotion, {joined("regions", ",")} AS regions, coalesce(source, '') AS source, round(rrf, 9) AS rrf_score, {cross} AS cross_score, round(score, 6) AS score, count(*) OVER () AS total_results
 FROM (SELECT *, round({base} + {boost}, 9) AS score FROM {source})) WHERE rank <= {limit}"""


NO_BOOST = "(CASE WHEN list_contains(regions, 'pan_india') THEN 5 ELSE 0 END) + least(coalesce(popularity_score, 0), 50) * 0.2::DOUBLE"
def raw_list(c: str) -> str:
    return f"(CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN from_json({c}, '[\"VARCHAR\"]') END)"


EXPORT = f"SELECT id, image_path, primary_language, array_to_string(CASE WHEN supported_languages IS NULL OR supported_languages = '' THEN [] ELSE {raw_list('supported_languages')} END, ',') AS languages, {at('caption', 'original')} AS original, {joined(raw_list('emotion'), ',')} AS emotion, {joined(raw_list('regions'), ',')} AS regions, (CASE WHEN json_valid(safety) THEN json_extract(safety, '$.nsfw')::BOOLEAN END) AS nsfw, round((CASE WHEN json_valid(quality) THEN json_extract(quality, '$.label_confidence')::DOUBLE END), 6) AS confidence, coalesce(reviewed, FALSE) AS reviewed FROM live WHERE labeled_at IS NOT NULL"


def _filter(cond: str) -> str:
    return f"WITH {LIVE} SELECT id, primary_language, coalesce(reviewed, FALSE) AS reviewed FROM live WHERE labeled_at IS NOT NULL AND {cond}"


OCR = """words AS (SELECT l_orderkey AS image, (l_suppkey % 2)::INT AS block_num, (l_linenumber // 2)::INT AS line_num, l_linenumber::INT AS word_num, (l_partkey % 400)::INT AS l, ((l_linenumber // 2) * 30 + l_partkey % 5 * 8)::INT AS tp, trunc(20 + l_quantity)::INT AS w, (10 + l_suppkey % 12)::INT AS h, (l_partkey * 7 % 101)::INT AS conf, l_returnflag || l_linestatus AS txt FROM lineitem),
 lines AS (SELECT image, block_num, line_num, min(l) AS x, min(tp) AS y, max(l + w) AS x2, max(tp + h) AS y2, (max(tp + h) - min(tp))::INT AS h, string_agg(trim(txt), ' ' ORDER BY word_num, trim(txt)) AS text FROM words WHERE conf >= 40 AND trim(txt) <> '' GROUP BY image, block_num, line_num),
 starts AS (SELECT *, (CASE WHEN y - lag(y2) OVER w > greatest(h, 10) * 1.2::DOUBLE THEN 1 ELSE 0 END) AS s FROM lines WINDOW w AS (PARTITION BY image, block_num ORDER BY y, line_num)),
 islands AS (SELECT *, (sum(s) OVER (PARTITION BY image, block_num ORDER BY y, line_num ROWS UNBOUNDED PRECEDING))::INT AS grp FROM starts),
 blocks AS (SELECT image, block_num, grp, min(x) AS x, min(y) AS y, (max(x2) - min(x))::INT AS w, (max(y2) - min(y))::INT AS h, string_agg(text, '/' ORDER BY y, line_num, text) AS text, count(*)::INT AS lines, trunc(median(h))::INT AS font_px FROM islands GROUP BY image, block_num, grp)"""
REGION = "(SELECT 6 AS rx, 200 - 84 - 6 AS ry, 388 AS rw, 84 AS rh)"
COVER = f"cover AS (SELECT image, sum(greatest(0, least(x + w, rx + rw) - greatest(x, rx)) * greatest(0, least(y + h, ry + rh) - greatest(y, ry)))::DOUBLE / (388 * 84) AS c FROM blocks, {REGION} GROUP BY image)"
BATCH = f"""WITH {LIVE}, {ITEM}, {vec("main")}, qs AS (SELECT meme_id AS query_id, e AS qe FROM v_main WHERE ('0x' || substr(meme_id, 6, 8))::BIGINT % 50 = 0),
 sims AS (SELECT query_id, meme_id, {cos("e", "qe")} AS s FROM v_main, qs), tops AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, meme_id) AS pos FROM sims QUALIFY pos <= 50),
 kept AS (SELECT tops.*, item.* FROM tops JOIN item ON id = meme_id WHERE s >= 0.35 AND (list_contains(langs, 'hindi') OR primary_language = 'hindi') AND (list_contains(regions, 'delhi') OR list_contains(regions, 'pan_india'))),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM kept QUALIFY n <= 10), scored AS (SELECT *, s * 100 + {BOOST.format(lang="hindi", region="delhi")} AS score FROM firsts),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos)::INT AS rank FROM scored QUALIFY rank <= 5) SELECT query_id, rank, id, round(s, 6) AS similarity, round(score, 6) AS score FROM best"""
SAMPLED = " UNION ALL ".join(f"SELECT id, '{x}' AS lang, unnest(q_{x}) AS q, generate_subscripts(q_{x}, 1) - 1 AS n FROM item" for x in ("english", "hindi", "hinglish"))


def first_of(x: str) -> str:
    return f"list_filter(list_transform(q_{x}, lambda q: {tr('q')}), lambda q: q <> '')[1]"


DESCRIPTION = filled([f"(CASE WHEN length({x}) > 0 THEN '{p}' || {x} ELSE '' END)" if one else f"(CASE WHEN len({x}) > 0 THEN '{p}' || {joined(x)} ELSE '' END)" for p, x, one in (("Scene: ", "scene_description", 1), ("Source: ", "source", 1), ("People: ", "people", 0), ("Meaning: ", "m_english", 1), ("Caption: ", CAPTION, 1), ("Emotion: ", "emotion", 0))], ". ")
# the stand-in reranker: ten times the share of the query's words that the description has
OVERLAP = f"(SELECT 10.0::DOUBLE * (list_contains(w, 'exam')::INT + list_contains(w, 'result')::INT) / 2 FROM (SELECT {TERMS.replace('search_text', DESCRIPTION)} AS w))"
NUMBER = "^\\s*([+-]?(Infinity|([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)?\\s*$"


def not_text(v: str) -> str:
    """Whether the label format reads a trimmed value as something other than a string."""
    return f"({v} IN ('true', 'false', 'null') OR (NOT (length({v}) > 0 AND starts_with({v}, '\"') AND ends_with({v}, '\"')) AND regexp_matches({v}, '{NUMBER}')))"


RESULT = f"SELECT id, image_path, primary_language, {joined('langs', ',')} AS supported_languages, {joined('emotion', ',')} AS emotion, {joined('regions', ',')} AS regions, {joined('people', ',')} AS people, to_json(intent)::VARCHAR AS intent, coalesce(popularity_score, 0) AS popularity_score, coalesce(source, '') AS source, coalesce(scene_description, '') AS scene_description FROM item"
SEGMENTS = "WITH q AS (SELECT p_partkey, [0] || list_sort([p_size * 3, 40]) || [200] AS b FROM part) SELECT p_partkey, no::INT AS no, b[no + 1]::INT AS start, b[no + 2]::INT AS \"end\" FROM q, (VALUES (0), (1), (2)) t(no)"


SQL: dict[str, str] = {
    "vec_topk_main": f"WITH {VECTORS} SELECT meme_id, round(s, 6) AS similarity FROM {top('main', 50)}",
    "vec_topk_threshold": f"WITH {LIVE}, {VECTORS} SELECT row_number() OVER (ORDER BY s DESC, meme_id)::INT AS pos, meme_id, round(s, 6) AS similarity FROM {top('main', 200)} WHERE s >= 0.1 AND meme_id IN (SELECT id FROM live)",
    "vec_search_legacy": f"WITH {LIVE}, {ITEM}, {VECTORS} SELECT id, image_path, round(s, 6) AS similarity, {joined('langs', ',')} AS languages FROM (SELECT * FROM {top('main', 100)} JOIN item ON id = meme_id WHERE (list_contains(langs, 'hinglish') OR primary_language = 'hinglish') AND s >= 0.1 ORDER BY s DESC, id LIMIT 20)",
    "batch_vec_search": BATCH,
    "labels_json_topk": f"WITH {LIVE}, {ITEM}, {VECTORS} SELECT meme_id AS id, round(s, 6) AS similarity, image_path, original AS caption_original FROM {top('main', 40)} LEFT JOIN item ON id = meme_id",
    "zero_norm_cosine": f"WITH {VECTORS} SELECT DISTINCT meme_id, round({cos('embedding::DOUBLE[]', 'qe')}, 6) AS similarity FROM embeddings_main, q WHERE {USABLE}",
    "multi_aspect_rankings": f"WITH {LIVE}, {VECTORS} {lists(1, 80, 0.1)}",
    "rrf_fusion": f"WITH {LIVE}, {VECTORS}, lists AS ({lists(1, 80, 0.1)}), {FUSE} SELECT meme_id, round(rrf, 9) AS rrf_score, (first // 1000000)::INT AS first_list, (first % 1000000)::INT AS first_pos FROM (SELECT * FROM fused ORDER BY rrf DESC, first LIMIT 120)",
    "rrf_double_weight_people": f"WITH {LIVE}, {VECTORS}, {EXACT}, lists AS (SELECT 1 AS list_no, meme_id, pos FROM exact UNION ALL SELECT 2, meme_id, pos FROM exact UNION ALL {lists(3, 80, 0.1)}), {FUSE} SELECT meme_id, round(rrf, 9) AS rrf_score FROM fused",
    "fused_search_filters": searched(30, 0.1, NAMES, "(list_contains(langs, 'hinglish') OR primary_language = 'hinglish') AND (list_contains(regions, 'delhi') OR list_contains(regions, 'pan_india'))") + " SELECT pos, id, round(rrf, 9) AS rrf_score FROM found",
    "rank_boosts": f"WITH {LIVE}, {ITEM} SELECT id, round(50 + {BOOST.format(lang='hindi', region='pan_india')}, 6) AS score FROM item",
    "search_end_to_end_no_rerank": searched(60, 0.3, None, "list_contains(langs, 'hindi') OR primary_language = 'hindi'") + " " + answer("NULL::DOUBLE", "rrf * 100", "(CASE WHEN primary_language = 'hindi' THEN 20 ELSE 0 END) + " + NO_BOOST, 20),
    "search_rerank_failed": searched(60, 0.3, NAMES) + ", crossed AS (SELECT * REPLACE (row_number() OVER (ORDER BY round(cross_, 9) DESC, pos)::INT AS pos) FROM (SELECT *, rrf * (CASE WHEN pos <= 15 THEN 100 ELSE 50 END) AS cross_ FROM found) WHERE cross_ >= 2) " + answer("round(cross_, 6)", "cross_ * 10", NO_BOOST, 20, "crossed"),
    "search_end_to_end_rerank": searched(60, 0.3, None, "list_contains(regions, 'delhi') OR list_contains(regions, 'pan_india')") + f", crossed AS (SELECT * REPLACE (row_number() OVER (ORDER BY round(cross_, 9) DESC, pos)::INT AS pos) FROM (SELECT *, (CASE WHEN pos <= 15 THEN {OVERLAP} ELSE rrf * 50 END) AS cross_ FROM found) WHERE cross_ >= 2) " + answer("round(cross_, 6)", "cross_ * 10", "(CASE WHEN list_contains(regions, 'delhi') THEN 15 ELSE 0 END) + " + NO_BOOST, 20, "crossed"),
    "toon_parse": f"""WITH {LIVE}, {ITEM}, t AS (SELECT id, trim(coalesce(primary_language, 'unknown')) AS lang, list_transform(string_split({joined('emotion', ',')}, ','), lambda x: {not_text('trim(x)')}) AS bad, {tr("regexp_replace(coalesce(original, 'none'), '[\\r\\n]+', ' ', 'g')")} AS o FROM item),
 e AS (SELECT *, CASE WHEN lang = '' OR {not_text('lang')} THEN 'primary_language: expected a string' WHEN o = '' OR {not_text('o')} THEN 'caption.original: expected a string'
 WHEN list_contains(bad, TRUE) THEN 'emotion.' || (list_position(bad, TRUE) - 1) || ': expected a string' END AS error FROM t)
 SELECT id, error, CASE WHEN error IS NULL THEN (CASE WHEN starts_with(o, '"') AND ends_with(o, '"') THEN substr(o, 2, greatest(length(o) - 2, 0)) ELSE o END) END AS original, CASE WHEN error IS NULL THEN 'true' END AS is_meme FROM e""",
    "people_normalise": f"WITH {LIVE}, {ITEM} SELECT DISTINCT {NORMAL.format('p')} AS person_name, id AS meme_id FROM (SELECT id, unnest(people) AS p FROM item)",
    "people_exact": f"WITH {EXACT} SELECT meme_id, pos FROM exact",
    "people_index_merge": f"WITH {LIVE}, {ITEM} SELECT person_name, meme_id FROM meme_people UNION SELECT {NORMAL.format('p')}, id FROM (SELECT id, unnest(people) AS p FROM item)",
    "fts_doc_stats": f"WITH {LIVE}, {ITEM}, {FTS} SELECT meme_id, len(t)::INT AS terms, len(list_distinct(t))::INT AS distinct_terms FROM toks",
    "fts_postings": f"WITH {LIVE}, {ITEM}, {FTS} SELECT term, count(DISTINCT meme_id) AS df, count(*) AS cf FROM (SELECT meme_id, unnest(t) AS term FROM toks) GROUP BY term",
    "bm25_single": _bm([("a", word("exam"))], "a > 0"),
    "bm25_and": _bm(EXAM_RESULT, "a > 0 AND b > 0"),
    "bm25_or_not": _bm([("a", word("wedding")), ("b", word("salary")), ("c", word("phone"))], "a > 0 OR (b > 0 AND NOT c > 0)"),
    "bm25_phrase": _bm([("a", "len(list_filter(range(1, greatest(len(t), 1)), lambda i: t[i] = 'cricket' AND t[i + 1] = 'match'))")], "a > 0"),
    "bm25_prefix": _bm([("a", "len(list_filter(t, lambda x: starts_with(x, 'home')))")], "a > 0"),
    "bm25_syntax_error": "SELECT 0::INT AS pos, ''::VARCHAR AS meme_id, 0.0::DOUBLE AS score WHERE FALSE",
    "search_text_build": f"WITH {LIVE}, {ITEM} SELECT id, {SEARCH_TEXT} AS search_text FROM item",
    "search_text_backfill": f"WITH {LIVE}, {ITEM} SELECT id, {BACKFILL_TEXT} AS search_text FROM item",
    "aspect_people_text": f"WITH {LIVE}, {ITEM} SELECT id, coalesce(nullif({PEOPLE_TEXT}, ''), 'No specific people or source identified.') AS text FROM item",
    "aspect_context_text": f"WITH {LIVE}, {ITEM} SELECT id, coalesce(nullif({CONTEXT_TEXT}, ''), 'No contextual information available.') AS text FROM item",
    "aspect_usecase_text": f"WITH {LIVE}, {ITEM} SELECT id, coalesce(nullif({USE_TEXT}, ''), met) AS text FROM item",
    "missing_aspects": f"WITH {LIVE}, {VECTORS} SELECT id, array_to_string(m, ',') AS missing FROM (SELECT id, list_filter([CASE WHEN id NOT IN (SELECT meme_id FROM v_main) THEN 'main' END, CASE WHEN id NOT IN (SELECT meme_id FROM v_people) THEN 'people' END, CASE WHEN id NOT IN (SELECT meme_id FROM v_context) THEN 'context' END, CASE WHEN id NOT IN (SELECT meme_id FROM v_context) THEN 'use_case' END], lambda x: x IS NOT NULL) AS m FROM live) WHERE len(m) > 0",
    "fts_backfill_todo": f"WITH {LIVE} SELECT id FROM live WHERE NOT EXISTS (SELECT 1 FROM live r WHERE r.reviewed AND r.id = live.id)",
    "vector_upsert": "SELECT meme_id, 'main' AS aspect, len(embedding)::INT AS numbers, created_at FROM (SELECT *, row_number() OVER (PARTITION BY meme_id ORDER BY created_at DESC NULLS LAST) AS rn_ FROM embeddings_main WHERE meme_id IS NOT NULL) WHERE rn_ = 1",
    "embed_missing": f"WITH {LIVE}, {VECTORS} SELECT id AS meme_id, aspect, 64::INT AS numbers FROM live, (VALUES ('main'), ('people'), ('context'), ('use_case')) t(aspect) WHERE CASE aspect WHEN 'main' THEN id NOT IN (SELECT meme_id FROM v_main) WHEN 'people' THEN id NOT IN (SELECT meme_id FROM v_people) ELSE id NOT IN (SELECT meme_id FROM v_context) END",
    "stats_single_row": f"WITH {LIVE}, {VECTORS}, c AS (SELECT (SELECT count(*) FROM v_main) AS m, (SELECT count(*) FROM v_people) AS p, (SELECT count(*) FROM v_context) AS x, (SELECT count(*) FROM live) AS n) SELECT m AS total_embeddings, p AS embeddings_people, x AS embeddings_context, x AS embeddings_use_case, m * 3072 * 4 / (1024 * 1024)::DOUBLE AS memory_mb, TRUE AS ready, n AS total_memes, (SELECT count(DISTINCT meme_id) FROM meme_people) AS memes_with_people_index, n AS fts_documents, m AS total_labeled FROM c",
    "export_labels": f"WITH {LIVE} {EXPORT}",
    "export_prefix": f"WITH {LIVE} {EXPORT} AND image_path ILIKE 'MEMES/1_/%'",
    "filter_language": _filter("primary_language = 'hindi'"),
    "filter_emotion": _filter(f"list_contains({lst('emotion')}, 'joy')"),
    "filter_region": _filter(f"list_contains({lst('regions')}, 'delhi')"),
    "filter_reviewed": _filter("coalesce(reviewed, FALSE)"),
    "filter_nsfw": _filter("(CASE WHEN json_valid(safety) THEN json_extract(safety, '$.nsfw')::BOOLEAN END)"),
    "insert_duplicates": "WITH r AS (SELECT id, labeled_at, count(*) OVER (PARTITION BY id) AS n FROM memes), s AS (SELECT DISTINCT id FROM memes WHERE labeled_at IS NULL) SELECT (CASE WHEN n > 1 OR id IN (SELECT id FROM s) THEN 'rejected' ELSE 'accepted' END) AS outcome, id, count(*) AS rows FROM r GROUP BY 1, 2",
    "natural_sort_names": f"WITH {LIVE}, n AS (SELECT id, regexp_extract(image_path, '[^/]*$') AS name FROM live) SELECT id, name, array_to_string(list_transform(regexp_extract_all(lower(name), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(coalesce(nullif(ltrim(x, '0'), ''), '0'), 20, '0') ELSE x END), '') AS sort_key FROM n WHERE regexp_matches(name, '\\.(jpg|jpeg|png|webp)$', 'i')",
    "ocr_line_islands": f"WITH {OCR} SELECT image, block_num, line_num, x, y, x2, y2, h, text, grp FROM islands",
    "ocr_block_summary": f"WITH {OCR} SELECT * FROM blocks",
    "block_position": f"WITH {OCR} SELECT image, block_num, grp, CASE WHEN y + h / 2.0 < 50 THEN 'top' WHEN y + h / 2.0 > 100 THEN 'bottom' ELSE 'middle' END AS position FROM blocks",
    "caption_region": "WITH p AS (SELECT p_partkey, (p_partkey % 300)::INT AS px, (p_size * 3)::INT AS py, (60 + p_size * 7)::INT AS pw, (45 + p_partkey % 500)::INT AS ph FROM part), r AS (SELECT *, least(greatest(30, trunc(ph * 0.42::DOUBLE)::INT), ph - 12)::INT AS rh FROM p) SELECT p_partkey, (px + 6)::INT AS x, (py + ph - rh - 6)::INT AS y, (pw - 12)::INT AS w, rh AS h FROM r",
    "strip_coverage": f"WITH {OCR}, {COVER} SELECT image, round(c, 6) AS coverage, c < 0.12 AS clear FROM cover",
    "panel_anchors": f"WITH {OCR}, {COVER}, big AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY w * h DESC, block_num, grp) AS n FROM blocks) SELECT image, font_px, x, w, c < 0.12 AS clear, CASE WHEN font_px <> 0 THEN font_px END AS shared_px, 'hello' AS caption FROM big JOIN cover USING (image) WHERE n = 1",
    "golden_cases": f"WITH {LIVE}, {ITEM}, s AS ({SAMPLED}) SELECT id, lang, n::INT AS at, {tr('q')} AS query FROM s WHERE {tr('q')} <> ''",
    "crosslingual_cases": f"WITH {LIVE}, {ITEM} SELECT * FROM (SELECT id, coalesce(image_path, id) AS theme, {first_of('english')} AS english, {first_of('hindi')} AS hindi, {first_of('hinglish')} AS hinglish FROM item) WHERE english IS NOT NULL AND hindi IS NOT NULL AND hinglish IS NOT NULL",
    "description_text": f"WITH {LIVE}, {ITEM} SELECT id, {DESCRIPTION} AS description FROM item",
    "pk_multi_get": f"WITH {LIVE}, {ITEM} {RESULT} WHERE ('0x' || substr(id, 6, 8))::BIGINT % 50 = 0",
    "result_defaults": f"WITH {LIVE}, {ITEM} {RESULT}",
    "shown_captions": f"WITH {LIVE}, {ITEM} SELECT id, {CAPTION} AS caption FROM item",
    "vector_stats": f"WITH {VECTORS} SELECT (SELECT count(*) FROM v_main) AS total_embeddings, (SELECT count(*) FROM v_people) AS embeddings_people, (SELECT count(*) FROM v_context) AS embeddings_context, (SELECT count(*) FROM v_context) AS embeddings_use_case, (SELECT count(*) FROM v_main) * 64 * 4 / (1024 * 1024)::DOUBLE AS memory_mb, TRUE AS ready",
    "media_and_time": f"WITH {LIVE} SELECT id, CASE WHEN lower(image_path) LIKE '%.png' THEN 'image/png' WHEN lower(image_path) LIKE '%.webp' THEN 'image/webp' ELSE 'image/jpeg' END AS mime, strftime(labeled_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS labeled_at FROM live",
    "clamp_boxes": "SELECT p_partkey, greatest(x - 6, 0)::INT AS x0, greatest(y - 6, 0)::INT AS y0, least(x + w + 6, 100)::INT AS x1, least(y + h + 6, 80)::INT AS y1 FROM (SELECT p_partkey, p_partkey % 90 AS x, p_size % 60 AS y, p_size AS w, p_partkey % 70 AS h FROM part)",
    "panel_segments": SEGMENTS,
    "debounce_events": "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt > ts + INTERVAL 1 HOUR",
    "migrate_columns": f"WITH {LIVE} SELECT id, '' AS ocr_text, '[]' AS people, source, '' AS scene_description FROM live",
}
