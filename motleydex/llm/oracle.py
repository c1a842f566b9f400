"""SQL, in DuckDB's dialect, for the queries of this subpackage that SQL can express: all pairs, without any index."""

from __future__ import annotations

from .unify import INVISIBLE, JOINED, LOOKALIKE, SPACES

LIVE = "live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY labeled_at DESC NULLS LAST) AS rn_ FROM memes WHERE id IS NOT NULL) WHERE rn_ = 1)"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
LANGS = ("english", "hindi", "hinglish", "tamil", "telugu")


def at(c: str, path: str) -> str:
    return f"(CASE WHEN json_valid({c}) THEN json_extract_string({c}, '$.{path}') END)"


def plain(text: str) -> str:
    """A text in its form for comparing words."""
    visible = f"regexp_replace(regexp_replace({text}, '[{INVISIBLE}]', '', 'g'), '(\\p{{Latin}})[\u200c\u200d]', '\\1', 'g')"
    spaced = f"translate({visible}, '{SPACES}', '{' ' * len(SPACES)}')"
    narrow = f"translate({spaced}, '{WIDE}', '{NARROW}')"
    return f"lower(translate(nfc_normalize({narrow}), '{''.join(LOOKALIKE)}', '{''.join(LOOKALIKE.values())}'))"


def odd(s: str) -> str:
    """Whether a string has an unusual character."""
    signs = f"[{WIDE[0]}-{WIDE[-1]}ﬀ-ﬆ{JOINED}{INVISIBLE}{SPACES}]"
    return f"({s} IS NOT NULL AND (regexp_matches({s}, '{signs}') OR length(nfc_normalize({s})) < length({s}) OR regexp_matches({s}, '\\p{{Latin}}[\\p{{Greek}}\\p{{Cyrillic}}]|[\\p{{Greek}}\\p{{Cyrillic}}]\\p{{Latin}}') OR regexp_matches({s}, '(^|\\p{{Latin}}|\\s)[\u200c\u200d]')))"


P1 = f"""WITH {LIVE}, texts AS (SELECT id, {plain(f"coalesce({at('caption', 'original')}, '') || ' ' || coalesce(ocr_text, '') || ' ' || coalesce(image_description, '')")} AS t FROM live),
 pieces AS (SELECT id, regexp_replace(regexp_replace(unnest(regexp_split_to_array(t, '[\\s|]+')), '^[\\p{{P}}$+<=>^`|~]+', ''), '[\\p{{P}}$+<=>^`|~]+$', '') AS w FROM texts),
 words AS (SELECT DISTINCT id, w FROM pieces WHERE w <> ''), sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id),
 shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM words a JOIN words b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id)
 SELECT id_a, id_b FROM shared s JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE s.n > 0.67::DOUBLE * (x.n + y.n - s.n)"""

P4 = "WITH " + ", ".join(
    f"v_{a} AS (SELECT '{a}' AS aspect, meme_id, e FROM (SELECT meme_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY meme_id ORDER BY created_at DESC NULLS LAST) AS rn_ FROM embeddings_{a} WHERE meme_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE rn_ = 1)"
    for a in ("main", "context", "people")
) + """, v AS (SELECT * FROM v_main UNION ALL SELECT * FROM v_context UNION ALL SELECT * FROM v_people),
 sims AS (SELECT a.aspect, a.meme_id AS id, b.meme_id AS nb, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.aspect = b.aspect AND a.meme_id <> b.meme_id),
 near AS (SELECT *, row_number() OVER (PARTITION BY aspect, id ORDER BY round(s, 5) DESC, nb) AS r FROM sims WHERE s >= 0.85)
 SELECT DISTINCT aspect, least(id, nb) AS id_a, greatest(id, nb) AS id_b FROM near WHERE r <= 5"""

P5 = f"""WITH {LIVE}, f AS (SELECT id, ({" OR ".join(odd(at("caption", p)) for p in ("original", *(f"translations.{x}" for x in LANGS)))}) AS caption, {odd("ocr_text")} AS ocr_text, ({" OR ".join(odd(at("meaning", x)) for x in LANGS)}) AS meaning FROM live)
 SELECT id, 'caption' AS fld FROM f WHERE caption UNION ALL SELECT id, 'ocr_text' FROM f WHERE ocr_text UNION ALL SELECT id, 'meaning' FROM f WHERE meaning"""



def letters(text: str) -> str:
    """A value without case, separators and punctuation."""
    return f"regexp_replace({plain(text)}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')"


def grams(s: str) -> str:
    """The n-grams of a value: letters, pairs and letters one apart."""
    t = f"('^' || {s} || '$')"
    return f"list_concat(list_concat(list_transform(range(1, length({t})), lambda i: {t}[i:i + 1]), list_transform(range(1, length({t}) - 1), lambda i: 's' || {t}[i] || {t}[i + 2])), list_transform(range(1, length({s}) + 1), lambda i: 'u' || {s}[i]))"


def listed(c: str) -> str:
    return f"(CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN from_json({c}, '[\"VARCHAR\"]') WHEN json_valid({c}) AND json_type({c}) = 'VARCHAR' THEN [json_extract_string({c}, '$')] ELSE [] END)"


P6 = f"""WITH {LIVE}, vals AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(f"SELECT id, '{c}' AS fld, unnest({listed(c)}) AS raw FROM live" for c in ("emotion", "intent", "regions"))}) WHERE regexp_matches(raw, '\\S')),
 todo AS (SELECT v.* FROM vals v WHERE NOT EXISTS (SELECT 1 FROM label_vocab l WHERE l.kind = v.fld AND l.entry = v.raw)), v AS (SELECT fld, raw, {letters("raw")} AS p FROM (SELECT DISTINCT fld, raw FROM todo)),
 nm AS (SELECT DISTINCT kind, entry, {letters("n")} AS name FROM (SELECT kind, entry, entry AS n FROM label_vocab UNION ALL SELECT kind, entry, unnest(aliases) FROM label_vocab)), names AS (SELECT * FROM nm WHERE name <> ''),
 size AS (SELECT kind, count(*) AS n FROM names GROUP BY kind), ng AS (SELECT kind, entry, name, g, count(*) AS c FROM (SELECT *, unnest({grams("name")}) AS g FROM names) GROUP BY ALL),
 weight AS (SELECT kind, g, ln(1 + max(n) / count(*)::DOUBLE) AS w FROM ng JOIN size USING (kind) GROUP BY kind, g),
 nv AS (SELECT kind, entry, name, g, c * w AS x, sqrt(sum((c * w) * (c * w)) OVER (PARTITION BY kind, entry, name)) AS norm FROM ng JOIN weight USING (kind, g)),
 vg AS (SELECT fld, raw, p, g, count(*) AS c FROM (SELECT *, unnest({grams("p")}) AS g FROM v WHERE p <> '') GROUP BY ALL),
 vv AS (SELECT fld, raw, p, vg.g, c * coalesce(w, ln(1 + n)) AS x, sqrt(sum((c * coalesce(w, ln(1 + n))) * (c * coalesce(w, ln(1 + n)))) OVER (PARTITION BY fld, raw)) AS norm FROM vg JOIN size ON size.kind = fld LEFT JOIN weight ON weight.kind = fld AND weight.g = vg.g),
 score AS (SELECT fld, raw, p, entry, name, sum(vv.x * nv.x / vv.norm / nv.norm) AS s FROM vv JOIN nv ON nv.kind = fld AND nv.g = vv.g GROUP BY ALL),
 near AS (SELECT fld, raw, p, entry, min({{'s': -s, 'name': name}}) AS k FROM score GROUP BY ALL),
 best AS (SELECT *, row_number() OVER w AS r, lead(k.s) OVER w AS nxt FROM near WINDOW w AS (PARTITION BY fld, raw ORDER BY k, entry)),
 exact AS (SELECT fld, raw, min(entry) AS entry FROM v JOIN names ON kind = fld AND name = p GROUP BY fld, raw HAVING count(DISTINCT entry) = 1)
 SELECT id, t.fld, t.raw, coalesce(e.entry, CASE WHEN -b.k.s >= 0.25 AND (b.nxt IS NULL OR b.nxt - b.k.s >= 0.03) AND damerau_levenshtein(b.p, b.k.name) <= (CASE WHEN greatest(length(b.p), length(b.k.name)) <= 4 THEN 1 WHEN greatest(length(b.p), length(b.k.name)) <= 11 THEN 2 ELSE 3 END) THEN b.entry END, '') AS entry FROM todo t LEFT JOIN exact e USING (fld, raw) LEFT JOIN best b ON b.fld = t.fld AND b.raw = t.raw AND b.r = 1"""

SQL: dict[str, str] = {"p1_found": P1, "p4_found": P4, "p5_found": P5, "p6_found": P6}
