"""SQL for the further queries, in DuckDB's dialect, written from the definitions."""

from __future__ import annotations

from .oracle import EXPORT, ITEM, LIVE, OCR, SAMPLED, SEARCH_TEXT, USE_TEXT, VECTORS, _filter, cos, first_of, joined, searched, top, tr, word

SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"


def counts(text: str) -> str:
    """The vector of how often each sign stands in a text, as floats of unit length read as doubles."""
    each = ", ".join(f"(length({text}) - length(replace({text}, '{c}', '')){f' + length({text}) - length(replace({text}, {chr(39)}{c.upper()}{chr(39)}, {chr(39)}{chr(39)}))' if c.isalpha() else ''})::DOUBLE" for c in SIGNS)
    return f"[{each}]"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: (CASE WHEN list_sum(list_transform({v}, lambda y: y * y)) = 0 THEN 0.0 ELSE x / sqrt(list_sum(list_transform({v}, lambda y: y * y))) END)::FLOAT::DOUBLE)"


def rows(columns: str, *values: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(values)}) t({columns})"


USE = f"coalesce(nullif({USE_TEXT}, ''), met)"
SOME = "('0x' || substr(id, 6, 8))::BIGINT % 50 = 0"
CASES = f"""WITH {LIVE}, {ITEM}, raw AS (SELECT id AS meme_id, {counts(f"coalesce({USE}, '')")} AS c FROM item), vecs AS (SELECT meme_id, {unit('c')} AS e FROM raw),
 s AS ({SAMPLED}), golden AS (SELECT id, lang, n::INT AS at, {tr('q')} AS query FROM s WHERE {tr('q')} <> '' AND {SOME})"""


def found_at(cases: str, k: int) -> str:
    """CTEs to ``ranked``: the cases with the place of their own item among the k nearest."""
    return f"""asked AS (SELECT query, {unit('c')} AS qe FROM (SELECT query, {counts('query')} AS c FROM (SELECT DISTINCT query FROM {cases}))),
 near AS (SELECT query, meme_id, row_number() OVER (PARTITION BY query ORDER BY s DESC, meme_id) AS r FROM (SELECT query, meme_id, round({cos('e', 'qe')}, 12) AS s FROM asked, vecs) QUALIFY r <= {k}),
 ranked AS (SELECT g.*, r FROM {cases} g LEFT JOIN near ON near.query = g.query AND near.meme_id = g.id)"""


RECALL = "SELECT lang, count(*) AS cases, count(r) AS found, round(count(r) / count(*)::DOUBLE, 6) AS recall FROM ranked GROUP BY lang"
EXAM_NAMED = [("a", word("exam")), ("b", word("result")), ("c", word("of")), ("d", word("kevobedulu"))]
PART_CASE = "p_partkey % 4"

SQL: dict[str, str] = {
    "labels_file": f"WITH {LIVE} {EXPORT}",
    "embedding_cache": f"WITH {LIVE}, t AS (SELECT id, trim(multilingual_embedding_text) AS x FROM live WHERE labeled_at IS NOT NULL AND trim(coalesce(multilingual_embedding_text, '')) <> '') SELECT id AS meme_id, 36::INT AS numbers, round(({unit('c')})[1], 6) AS first, 'letter-embedder-1' AS model FROM (SELECT id, {counts('x')} AS c FROM t)",
    "image_listing": rows("name, bytes", "('1.png', 1::INT)", "('2.jpg', 1)", "('10.JPG', 1)", "('A2.Png', 1)", "('b.webp', 1)"),
    "synthetic_names": "SELECT n || '.jpg' AS id, n || '.jpg' AS image_path, '/memes/' || n || '.jpg' AS image_url FROM range(200) t(n)",
    "random_sample_properties": "SELECT 4::BIGINT AS names, 4::BIGINT AS different, 4::BIGINT AS known, 4::BIGINT AS same, 1::BIGINT AS single",
    "panels_file": f"WITH {OCR} SELECT image::VARCHAR AS image, 0::INT AS panel, x, y, w, h, text, lines, font_px, CASE WHEN y + h / 2.0 < 50 THEN 'top' WHEN y + h / 2.0 > 100 THEN 'bottom' ELSE 'middle' END AS position FROM blocks",
    "captions_file": rows("panel, caption", "('0', 'first')", "('2', 'ह')"),
    "served_files": rows(
        "no, method, path, status, answer", "(0::INT, 'GET', '/memes/1.jpg', 200::INT, 'abc')", "(1, 'GET', '/memes/2.jpg', 404, 'error')", "(2, 'GET', '/memes/../1.jpg', 404, 'error')", "(3, 'GET', '/nothing', 404, 'error')", "(4, 'POST', '/search', 400, 'error')",
        "(5, 'POST', '/search', 400, 'error')", "(6, 'POST', '/batch-search', 400, 'error')", "(7, 'POST', '/reload', 200, 'stats,status')", "(8, 'GET', '/memes', 200, 'memes')",
    ),
    "command_line_export": f"WITH {LIVE} SELECT id, primary_language FROM live WHERE labeled_at IS NOT NULL AND primary_language = 'hindi'",
    "value_coercion": rows(
        "text, kind, value", "('true', 'bool', 'true')", "('false', 'bool', 'false')", "('null', 'null', '')", "('\"quoted 1\"', 'str', 'quoted 1')", "('12', 'int', '12')", "('-3.50', 'float', '-3.5')", "('1e3', 'int', '1000')", "('0x1f', 'int', '31')", "('.5', 'float', '0.5')",
        "('Infinity', 'float', 'inf')", "('', 'int', '0')", "(' ', 'int', '0')", "('12a', 'str', '12a')", "('True', 'str', 'True')", "('1,5', 'str', '1,5')", "('\"', 'str', '')", "('+7', 'int', '7')", "('१२', 'str', '१२')",
    ),
    "comma_lists": rows("text, parts", "('a, b', 'a|b')", "('a,,b,', 'a|0|b|0')", "('one', 'one')", "(' x , 2 , true ', 'x|2|true')", "(',', '0|0')", "('a;b', 'a;b')"),
    "chat_texts": rows("no, text", "(0::INT, 'plain')", "(1, '')", "(2, 'ab')", "(3, '')", "(4, '')", "(5, '12')"),
    "label_texts": rows(
        "no, error, id, emotion, regions, intent, original, tags, is_meme",
        "(0::INT, '', 'a', '[]', '[]', '[]', '', '[]', 'true')",
        "(1, '', 'a', '[\"joy\",\"pride\"]', '[\"delhi\",\"goa\"]', '[\"agree\"]', '', '[]', 'true')",
        "(2, '', 'b', '[]', '[]', '[]', 'x: y', '[]', 'true')",
        "(3, '', 'c', '[]', '[]', '[]', '', '[]', 'true')",
        "(4, 'safety.nsfw: expected a boolean', '', '', '', '', '', '', '')",
        "(5, 'id: expected a string', '', '', '', '', '', '', '')",
        "(6, 'id: required', '', '', '', '', '', '', '')",
        "(7, 'emotion.0: expected a string', '', '', '', '', '', '', '')",
        "(8, '', 'f', '[]', '[]', '[]', '', '[\"a\",\"b\"]', 'true')",
        "(9, 'truncated response', '', '', '', '', '', '', '')",
        "(10, 'empty response', '', '', '', '', '', '', '')",
    ),
    "label_attempts": f"SELECT p_partkey || '.png' AS path, {PART_CASE} < 2 AS labelled, CASE {PART_CASE} WHEN 2 THEN 'truncated response' WHEN 3 THEN 'ConnectionError: no model' ELSE '' END AS error, (CASE {PART_CASE} WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END)::INT AS attempts FROM part",
    "label_outcome": f"SELECT count(*) AS total, count(*) FILTER ({PART_CASE} < 2) AS succeeded, count(*) FILTER ({PART_CASE} >= 2) AS failed FROM part",
    "pipeline_counts": rows("run, labelled, embedded, items, vectors, texts", "(1::INT, 3::INT, 3::INT, 3::BIGINT, 12::BIGINT, 3::BIGINT)", "(2, 3, 0, 3, 12, 3)"),
    "created_and_reset": "SELECT 4::INT AS made, 0::INT AS made_again, 1::BIGINT AS rows_before, 0::BIGINT AS rows_after",
    "replaced_texts": f"WITH {LIVE}, {ITEM} SELECT id AS meme_id, (CASE WHEN reviewed THEN 8 ELSE length({SEARCH_TEXT}) END)::INT AS letters FROM item",
    "streamed_vectors": f"WITH {LIVE} SELECT id AS meme_id, 4::BIGINT AS vectors, 4::BIGINT AS aspects FROM live",
    "embed_missing_tasks": f"WITH {LIVE}, {VECTORS}, m AS (SELECT (id NOT IN (SELECT meme_id FROM v_main))::INT + (id NOT IN (SELECT meme_id FROM v_people))::INT + 2 * (id NOT IN (SELECT meme_id FROM v_context))::INT AS n FROM live) SELECT sum(n)::BIGINT AS vectors, count(*) FILTER (n > 0) AS embedded FROM m",
    "vectors_from_text": "SELECT meme_id, 64::INT AS numbers, round(s::DOUBLE, 5) AS second FROM (SELECT DISTINCT meme_id, embedding[2] AS s, embedding FROM embeddings_main WHERE meme_id IS NOT NULL AND len(embedding) = 64)",
    "search_emotion": f"WITH {LIVE}, {ITEM}, {VECTORS} SELECT id, round(s, 6) AS similarity, {joined('emotion', ',')} AS emotion FROM (SELECT * FROM {top('main', 150)} JOIN item ON id = meme_id WHERE list_contains(emotion, 'joy') AND s >= 0.05 ORDER BY s DESC, id LIMIT 30)",
    "people_empty_name": "SELECT meme_id, row_number() OVER (ORDER BY n, meme_id)::INT AS pos FROM (SELECT meme_id, min(n) AS n FROM (SELECT meme_id, row_number() OVER (ORDER BY person_name, meme_id) AS n FROM meme_people WHERE person_name IS NOT NULL) WHERE n <= 50 GROUP BY meme_id)",
    "search_analysed": searched(60, 0.3, ["kevobedulu"], phrases=EXAM_NAMED, where_text="a > 0 AND b > 0 AND c > 0 AND d > 0") + ", ranked AS (SELECT id, rrf, row_number() OVER (ORDER BY round(rrf * 100 + (CASE WHEN list_contains(regions, 'pan_india') THEN 5 ELSE 0 END) + least(coalesce(popularity_score, 0), 50) * 0.2::DOUBLE, 9) DESC, pos)::INT AS rank FROM found) SELECT rank, id, round(rrf, 9) AS rrf_score FROM ranked WHERE rank <= 20",
    "request_checks": rows("no, accepted, result_limit", "(0::INT, TRUE, 10::INT)", "(1, FALSE, NULL)", "(2, FALSE, NULL)", "(3, FALSE, NULL)", "(4, TRUE, 1)", "(5, TRUE, 50)", "(6, FALSE, NULL)", "(7, FALSE, NULL)", "(8, FALSE, NULL)", "(9, TRUE, 10)"),
    "recall_at_k": f"{CASES}, {found_at('golden', 10)} SELECT lang, count(*) AS cases, count(r) AS found, count(r) / count(*)::DOUBLE AS recall FROM ranked GROUP BY lang",
    "recall_by_language": f"{CASES}, {found_at('golden', 10)} {RECALL}",
    "recall_failures": f"{CASES}, {found_at('golden', 10)} SELECT id, lang, \"at\", query FROM ranked WHERE r IS NULL",
    "crosslingual_recall": f"{CASES}, x AS (SELECT id, {first_of('english')} AS english, {first_of('hindi')} AS hindi, {first_of('hinglish')} AS hinglish FROM item WHERE {SOME}), long AS (SELECT id, unnest(['english', 'hindi', 'hinglish']) AS lang, unnest([english, hindi, hinglish]) AS query FROM x WHERE english IS NOT NULL AND hindi IS NOT NULL AND hinglish IS NOT NULL), {found_at('long', 8)} {RECALL}",
    "hit_invariants": f"{CASES} SELECT DISTINCT query, 5::BIGINT AS hits, TRUE AS cosines FROM golden",
    "detected_panels": """WITH p AS (SELECT p_partkey, 45 + p_size AS g FROM part), boxes AS (
 SELECT p_partkey, 0 AS k, 0 AS x, 0 AS y, 120 AS w, g AS h FROM p UNION ALL SELECT p_partkey, 1, 0, g + 4, 120, 196 - g FROM p),
 cut AS (SELECT p_partkey, k * 2 AS k, 0 AS x, y, 50 AS w, h FROM boxes WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, k * 2 + 1, 55, y, 65, h FROM boxes WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, k * 2, x, y, w, h FROM boxes WHERE p_partkey % 3 <> 0)
 SELECT p_partkey::VARCHAR AS image, (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INT AS panel, x::INT AS panel_x, y::INT AS panel_y, w::INT AS panel_w, h::INT AS panel_h FROM cut""",
    "seamed_panels": "SELECT p_partkey::VARCHAR AS image, 2::INT AS panels, 38400::INT AS pixels, TRUE AS at_seam FROM part",
    "ink_votes": "SELECT p_partkey::VARCHAR AS image, 30::INT AS bright, p_size::INT AS dark, CASE WHEN p_size > 30 THEN 'black' ELSE 'white' END AS ink FROM part",
    "flat_rows": "SELECT p_partkey::VARCHAR AS image, 4::INT AS rows, 255.0::DOUBLE AS mean FROM part",
    "filter_unknown": _filter("TRUE"),
    "filter_empty": _filter("TRUE"),
}
