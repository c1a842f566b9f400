"""Problem 3: the language of records and of their parts, with a confidence.

A multinomial naive Bayes classifier over hashed character n-grams (1 to 4, on the
unified lower-case text with single blanks around words, digits and signs left out).
It is fitted on a bounded sample of labelled rows, ``train_rows`` by default 3,000
(those with the smallest hashes of id): their translations, whose language is the
key, and the parts of their captions under the record's label. Labels are partly
wrong, so texts whose label the first fit contradicts are left out of a second fit.
The matrix of log-probabilities (buckets x languages, 0.7 MB, fixed) is broadcast
and batches of parts are scored at once in numpy.

Everything else covers all rows: one pass scores every part of every record where
it is read; only ids, times and languages are shuffled to choose live rows.

Defined cases: null, empty and unreadable captions, and those without a letter, give
no rows; parts without a letter are no parts; equal scores go to the language that
stands first in the table of codes; a null list of languages names none.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import age, map_batches, newest, original, parse
from .unify import skeleton

BITS = 14
EVIDENCE = 12
LONGEST = 4
PARTS = re.compile("[|\n\r\x0b\x0c\x85\u2028\u2029]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
MARKS = re.compile("[^\\w\u0300-\u036f\u0900-\u0dff\\s]|[\\d_]")
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def parts(text: str) -> list[str]:
    """What stands between | signs and line breaks and has a letter."""
    return [p.strip() for p in PARTS.split(text) if NOT_LETTERS.sub("", p)]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of texts, one after another, and where each text's begin."""
    clean = [" " + " ".join(MARKS.sub(" ", skeleton(t)).split()) + " " for t in texts]
    size = np.array([len(t) for t in clean], np.int64)
    codes = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32).astype(np.uint32)
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(len(codes))
    owner = np.repeat(np.arange(len(clean)), size)
    out, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint32)
        for n in range(LONGEST):
            ok = at + n < ends
            nxt = np.zeros(len(codes), np.uint32)
            nxt[ok] = codes[at[ok] + n]
            h = (h ^ (nxt + np.uint32(n + 1))) * MULTIPLIERS[n]
            h ^= h >> np.uint32(15)
            out.append((h[ok] * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
            owners.append(owner[ok])
        out.append(((codes >> np.uint32(7)) * np.uint32(0x297A2D39) + np.uint32(77)) >> np.uint32(32 - BITS))  # the block of characters
        owners.append(owner)
    owner, f = np.concatenate(owners), np.concatenate(out).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return f[order], np.searchsorted(owner[order], np.arange(len(clean)))


def fit(texts: list[str], labels: np.ndarray, languages: int, smoothing: float = 0.15) -> np.ndarray:
    """The log-probabilities (buckets x languages) of labelled texts; equal smoothing mass and prior for every language."""
    counts = np.zeros((1 << BITS, languages))
    for lang in range(languages):
        own = [t for t, k in zip(texts, labels) if k == lang]
        if own:
            counts[:, lang] = np.bincount(features(own)[0], minlength=1 << BITS)
    total = counts.sum(axis=0)
    p = (counts / np.maximum(total, 1) + smoothing / (1 << BITS)) / (1 + smoothing)
    p[:, total == 0] = 1e-9  # a language without a text is never chosen
    return np.log(p).astype(np.float32)


def score(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language number and the confidence of each text; its n-grams overlap, so they count as at most EVIDENCE independent ones."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0)
    best, sure = [], []
    for lo in range(0, len(texts), 2000):
        f, start = features(texts[lo : lo + 2000])
        s = np.add.reduceat(logp[f], start, axis=0, dtype=np.float64) / LONGEST
        top = s.argmax(axis=1)
        s *= EVIDENCE / np.maximum(EVIDENCE, np.diff(np.r_[start, len(f)]) / LONGEST)[:, None]
        e = np.exp(s - s.max(axis=1, keepdims=True))
        best.append(top)
        sure.append(1 / e.sum(axis=1))
    return np.concatenate(best), np.concatenate(sure)


def names(codes: list[tuple[str, str]]) -> dict[str, int]:
    """The numbers of languages by name and code, in lower case."""
    return {c.lower(): k for k, (_, c) in enumerate(codes)} | {n.lower(): k for k, (n, _) in enumerate(codes)}


def training_texts(rows: list[tuple[str | None, str | None]], known: dict[str, int]) -> tuple[list[str], list[int]]:
    """The labelled texts of rows (caption, label): translations and the parts of originals."""
    texts: list[str] = []
    labels: list[int] = []
    for caption, label in rows:
        value = parse(caption)
        tr = value.get("translations") if isinstance(value, dict) else None
        for lang, text in (tr if isinstance(tr, dict) else {}).items():
            if isinstance(text, str) and lang in known and NOT_LETTERS.sub("", text):
                texts.append(text)
                labels.append(known[lang])
        k = known.get((label or "").strip().lower())
        if k is not None:
            own = parts(original(caption))
            texts += own
            labels += [k] * len(own)
    return texts, labels


def train(rows: list[tuple[str | None, str | None]], codes: list[tuple[str, str]]) -> np.ndarray:
    """The matrix of log-probabilities from a sample of rows (caption, label)."""
    texts, labels = training_texts(rows, names(codes))
    y = np.array(labels, np.int64)
    logp = fit(texts, y, len(codes))
    if not texts:
        return logp
    ok = score(texts, logp)[0] == y
    return fit([t for t, k in zip(texts, ok) if k], y[ok], len(codes))


def sample(memes: DataFrame, train_rows: int) -> list[tuple[str | None, str | None]]:
    """A bounded sample of rows (caption, label): those with the smallest hashes.

    A bound on the hash, from the number of rows, keeps each task from sending more than its share.
    """
    share = min(1.0, 1.5 * train_rows / max(1, memes.count()))
    some = memes.filter(F.xxhash64("id") <= min(2**63 - 1, int(-(2**63) + share * (2**64 - 1))))
    return [tuple(r) for r in some.orderBy(F.xxhash64("id"), "id").limit(train_rows).select("caption", "primary_language").collect()]


def named(listed: str | None, known: dict[str, int]) -> set[int]:
    """The languages that a JSON list names."""
    value = parse(listed)
    value = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    return {known[x.strip().lower()] for x in value if isinstance(x, str) and x.strip().lower() in known}


def record_languages(memes: DataFrame, lang_codes: DataFrame, train_rows: int = 3000) -> DataFrame:
    """(id, label, listed, parts): of each live record its label's and list's languages and (lang, confidence) of each part."""
    codes = [(r[0], r[1]) for r in lang_codes.select("lang", "code").collect()]  # the fixed table of 11 languages
    known, langs = names(codes), [n for n, _ in codes]
    logp = memes.sparkSession.sparkContext.broadcast(train(sample(memes, train_rows), codes))

    def make():
        matrix = logp.value

        def step(c):
            split = [parts(original(t)) for t in c["caption"]]
            lang, sure = score([p for ps in split for p in ps], matrix)
            it = iter(zip(lang.tolist(), sure.tolist()))
            found = [[{"lang": langs[k], "confidence": s} for _, (k, s) in zip(ps, it)] for ps in split]
            label = [known.get((x or "").strip().lower()) for x in c["primary_language"]]
            return {
                "id": c["id"],
                "stamp": c["stamp"],
                "label": [None if k is None else langs[k] for k in label],
                "listed": [[langs[k] for k in sorted(named(x, known))] for x in c["supported_languages"]],
                "parts": found,
            }

        return step

    rows = map_batches(memes.filter("id is not null").select("id", age().alias("stamp"), "caption", "primary_language", "supported_languages"), make, "id string, stamp timestamp_ntz, label string, listed array<string>, parts array<struct<lang:string, confidence:double>>")
    return newest(rows, ["id"], "stamp", ["label", "listed", "parts"])


def corrections(memes: DataFrame, lang_codes: DataFrame, train_rows: int = 3000) -> DataFrame:
    """(id, fld, seg, lang, confidence): labels to correct, languages to add to lists, and the parts of mixed captions."""
    r = record_languages(memes, lang_codes, train_rows).filter(F.size("parts") > 0)
    r = r.withColumn("langs", F.array_distinct(F.transform("parts", lambda p: p["lang"])))
    one = F.size("langs") == 1
    sure = lambda lang: F.array_max(F.transform(F.filter("parts", lambda p: p["lang"] == lang), lambda p: p["confidence"]))
    row = lambda fld, seg, lang, conf: F.struct(F.lit(fld).alias("fld"), seg.cast("int").alias("seg"), lang.alias("lang"), conf.alias("confidence"))
    first = F.get("langs", F.lit(0))
    none = F.expr("cast(array() as array<struct<fld:string, seg:int, lang:string, confidence:double>>)")
    primary = F.when(one & ~F.col("label").eqNullSafe(first), F.array(row("primary_language", F.lit(0), first, sure(first)))).otherwise(none)
    listed = F.transform(F.array_except("langs", "listed"), lambda x: row("supported_languages", F.lit(0), x, sure(x)))
    mixed = F.when(~one, F.transform("parts", lambda p, i: row("caption", i + 1, p["lang"], p["confidence"]))).otherwise(none)
    return r.select("id", F.explode(F.concat(primary, listed, mixed)).alias("r")).select("id", "r.*")
