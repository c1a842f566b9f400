"""Problem 5: one consistent form for text that looks the same.

A letter belongs to a script; a letter that has look-alikes (LOOKALIKES, both ways) can also be spelled in
their scripts: its resolved set. Intersecting the letters' own scripts over a word
tells whether the word is of one script. If it is not, intersecting the resolved
sets gives the scripts in which the whole word can be spelled; of these the one is selected in which most of its
letters are already (Latin if as many are), and the word is respelled in it, whichever it is: a Latin letter in a Cyrillic word becomes
Cyrillic. A word that no script can spell (a brand with a foreign letter) is reported and stays. A word wholly of one
script that could be spelled in another (a whole-script confusable) is reported
but left as it is. The remaining forms (full width, ligatures, mathematical and other styled letters, separate accents
and vowel signs, invisible characters, spaces) are then normalised.

Defined cases: null stays null, the empty string stays empty; the operator is
idempotent; text of any length is handled in one linear pass per word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship
from .common import age, map_batches, newest, parse, strings

# Latin letters and their look-alikes in each script (after Unicode's confusables). Only letters in everyday use are spelled into.
LATIN = {
    "CYRILLIC": ("ABCEHIJKMOPSTXYaceijopsxyh", "АВСЕНІЈКМОРЅТХУасеіјорѕхуһ"),
    "GREEK": ("ABEZHIKMNOPTYXaiopvuy", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιορνυγ"),
    "ARMENIAN": ("SUOLonuhqg", "ՏՍՕԼօոսհզց"),
    "CHEROKEE": ("DRTAJEWMHGZSLCPKBVY", "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᏴᏙᎩ"),
}
# Letters that look like a Latin one but are rare in their own script; no word is spelled into them.
RARE = {"ԁ": "d", "ԛ": "q", "ѵ": "v", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ϲ": "C", "ϲ": "c", "ϳ": "j", "ɑ": "a", "ɡ": "g", "ı": "i"}
# a letter: the scripts in which it can be spelled, and how
LOOKALIKES: dict[str, dict[str, str]] = {}
for _script, (_plain, _other) in LATIN.items():
    for _a, _b in zip(_plain, _other, strict=True):
        LOOKALIKES.setdefault(_a, {"LATIN": _a})[_script] = _b
        LOOKALIKES[_b] = LOOKALIKES[_a]
for _b, _a in RARE.items():
    LOOKALIKES[_b] = LOOKALIKES.get(_a, {"LATIN": _a})
ALPHABETS = {"LATIN", *LATIN}
LOOKALIKE = {b: x["LATIN"] for b, x in LOOKALIKES.items() if x["LATIN"] != b}
# Letter pairs joined into one character, besides the block of Latin ligatures.
JOINED = "ĲĳǄǅǆǇǈǉǊǋǌǱǲǳ"
# Invisible characters, besides the two joiners.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff\uffa0\ufff9\ufffa\ufffb"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
KINDS = ("wide", "joined", "separate", "invisible", "space", "mixed", "whole", "styled")

OTHER = "ıɑɡͰ-֏Ꭰ-᏿ᲀ-᲏ἀ-῿ⷠ-ⷿꙀ-ꚟꭰ-ꮿ"
STYLES = "℀-⅏Ⅰ-ↈ\U0001d400-\U0001d7ff"
TAGS = "\U000e0001\U000e0020-\U000e007f"
WIDE = re.compile("[！-～￠-￦]")
LIGATURE = re.compile(f"[ﬀ-ﬆ{JOINED}]")
HIDDEN = re.compile(f"[{INVISIBLE}]")
SPACE = re.compile(f"[{SPACES}]")
JOINER = re.compile("[‌‍︀-️]")
TAG = re.compile(f"(\U0001f3f4?)([{TAGS}]+)")  # behind a black flag they make the flags of regions
FOREIGN = re.compile(f"[{OTHER}]")
STYLED = re.compile(f"[{STYLES}]")
SMALL = re.compile("[ʙɢʜɪʟɴʀʏᴀ-ᴢꜰ]")
WORD = re.compile(r"[^\W\d_]+")
SUSPECT = re.compile(f"[！-～￠-￦ﬀ-ﬆ{JOINED}{INVISIBLE}{SPACES}‌‍︀-️{OTHER}{STYLES}{TAGS}ʙɢʜɪʟɴʀʏᴀ-ᴢꜰ]")


@lru_cache(65536)
def script(ch: str) -> str:
    """The script of a letter; the empty string for what all scripts share."""
    if not ch.isalpha():
        return ""
    first = unicodedata.name(ch, "").partition(" ")[0]
    return {"FULLWIDTH": "LATIN", "MICRO": "", "MODIFIER": "", "FEMININE": "", "MASCULINE": "", "CJK": "HAN"}.get(first, first)


@lru_cache(65536)
def resolved(ch: str) -> frozenset[str]:
    """The scripts in which a letter can be spelled: its own and those of its look-alikes."""
    base = unicodedata.normalize("NFD", ch)[0]
    return frozenset({script(base), *LOOKALIKES.get(base, ())})


@lru_cache(4096)
def styled(ch: str) -> str:
    """The plain form of a mathematical, script, black-letter or double-struck letter or a Roman numeral; other signs as they are."""
    name = unicodedata.name(ch, "")
    if any(x in name for x in ("MATHEMATICAL", "SCRIPT ", "BLACK-LETTER", "DOUBLE-STRUCK", "ROMAN NUMERAL")):
        plain = unicodedata.normalize("NFKC", ch)
        return plain if plain.isalnum() else ch
    return ch


def small_capitals(word: str) -> str:
    """A word written in small capitals in plain letters; other words, among them phonetic ones, as they are."""
    out = []
    for ch in word:
        name = unicodedata.name(ch, "")
        last = name.removeprefix("LATIN LETTER SMALL CAPITAL ")
        if name != last and len(last) == 1:
            out.append(last.lower())
        elif ch.isascii():
            out.append(ch)
        else:
            return word
    return "".join(out) if len(SMALL.findall(word)) > 1 else word


def token_scripts(word: str) -> tuple[frozenset[str], frozenset[str]]:
    """A word's own scripts in common (empty: mixed) and its resolved scripts in common, over its letters."""
    own: frozenset[str] | None = None
    can: frozenset[str] | None = None
    for ch in word:
        if s := script(ch):
            one = frozenset({s})
            own = one if own is None else own & one
            can = resolved(ch) if can is None else can & resolved(ch)
    return own or frozenset(), can or frozenset()


def is_mixed(word: str) -> bool:
    """Whether letters of another alphabet stand in a word beside those of Latin or one that looks like it."""
    kinds = {s for ch in word if (s := script(ch))}
    return len(kinds) > 1 and len(kinds & ALPHABETS) > 1 and bool(FOREIGN.search(word))


def joiner_needed(text: str, i: int) -> bool:
    """Whether the joiner or variation selector at i is one that a script or an emoji needs."""
    before = text[i - 1] if i else ""
    after = text[i + 1] if i + 1 < len(text) else ""
    if not before:
        return False
    ch = text[i]
    kind = unicodedata.category(before)
    if "\ufe00" <= ch <= "\ufe0f":
        return kind in ("So", "Sm", "Po", "Nd", "Sk") or ord(before) >= 0x1F000 or before == "ℹ"
    if unicodedata.combining(before) == 9:  # a virama: the joiner chooses the form of the letters around it
        return True
    if kind in ("So", "Sk") or ord(before) >= 0x1F000 or "\ufe00" <= before <= "\ufe0f":
        return bool(after) and (unicodedata.category(after) == "So" or ord(after) >= 0x1F000) and ch == "\u200d"
    if 0x600 <= ord(before) <= 0x8FF or 0x1800 <= ord(before) <= 0x18AF:  # Arabic and Mongolian
        return True
    if after and 0x900 <= ord(before) <= 0xDFF and unicodedata.combining(after) == 9:
        return True
    return False


def separate(text: str) -> bool:
    """Whether an accent or vowel sign stands apart where one composed character is the standard form."""
    if unicodedata.is_normalized("NFC", text):
        return False
    return any(len(unicodedata.normalize("NFC", w)) < len(w) for w in text.split())


def findings(text: str | None) -> set[str]:
    """The kinds of unusual characters in a text, of KINDS."""
    if not text or text.isascii():
        return set()
    found: set[str] = set()
    if separate(text):
        found.add("separate")
    if not SUSPECT.search(text):
        return found
    if WIDE.search(text):
        found.add("wide")
    if LIGATURE.search(text):
        found.add("joined")
    if STYLED.search(text) and any(styled(m.group()) != m.group() for m in STYLED.finditer(text)) or SMALL.search(text) and any(small_capitals(m.group()) != m.group() for m in WORD.finditer(text)):
        found.add("styled")
    if HIDDEN.search(text) or any(not m.group(1) for m in TAG.finditer(text)) or any(not joiner_needed(text, m.start()) for m in JOINER.finditer(text)):
        found.add("invisible")
    if SPACE.search(text):
        found.add("space")
    if FOREIGN.search(text):
        plain = HIDDEN.sub("", JOINER.sub("", text))
        for m in WORD.finditer(unicodedata.normalize("NFC", plain)):
            w = m.group()
            if FOREIGN.search(w):
                if is_mixed(w):
                    found.add("mixed")
                elif "LATIN" in token_scripts(w)[1]:
                    found.add("whole")
    return found


def respell(word: str) -> str:
    """A word of several scripts in the one script in which all of it can be spelled; other words as they are.

    Letters of scripts without look-alikes (a character of another language between) take no part.
    """
    letters = [c for c in word if script(c) in ALPHABETS]
    if len({script(c) for c in letters}) < 2:
        return word
    own, can = token_scripts("".join(letters))
    if own or not can:
        return word
    count = Counter(script(c) for c in letters)
    to = max(sorted(can), key=lambda s: (count[s], s == "LATIN"))

    def spelled(ch: str) -> str:
        d = unicodedata.normalize("NFD", ch)
        return unicodedata.normalize("NFC", LOOKALIKES[d[0]].get(to, d[0]) + d[1:]) if script(ch) in ALPHABETS and script(ch) != to else ch

    return "".join(map(spelled, word))


def unify(text: str | None) -> str | None:
    """A text in its one form; joiners that a script or an emoji needs stay."""
    if not text or text.isascii():
        return text
    if SUSPECT.search(text):
        if JOINER.search(text):
            text = "".join(c for i, c in enumerate(text) if not (JOINER.match(c) and not joiner_needed(text, i)))
        text = TAG.sub(lambda m: m.group() if m.group(1) else "", text)
        text = SPACE.sub(" ", HIDDEN.sub("", text))
        text = WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
        text = LIGATURE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
        text = STYLED.sub(lambda m: styled(m.group()), text)
        text = unicodedata.normalize("NFC", text)
        if SMALL.search(text):
            text = WORD.sub(lambda m: small_capitals(m.group()), text)
        return WORD.sub(lambda m: respell(m.group()) if FOREIGN.search(m.group()) else m.group(), text)
    return unicodedata.normalize("NFC", text)


def skeleton(text: str) -> str:
    """A form for comparing: unified, compatibility forms folded, look-alikes replaced, lower case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", unify(text) or "")
    if FOREIGN.search(text):
        text = "".join(LOOKALIKE.get(c, c) for c in text)
    return text.lower()


def unify_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_unified`` and ``<column>_findings`` for each text column; nulls stay null, columns of these names are replaced.

    One pass over Arrow batches; each different text of a batch is unified once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    ship(df.sparkSession)
    df = df.drop(*[f"{c}_{x}" for c in columns for x in ("unified", "findings")])
    kind = StructType([*df.schema.fields, *[f for c in columns for f in (StructField(f"{c}_unified", StringType()), StructField(f"{c}_findings", ArrayType(StringType())))]])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            added = []
            for c in columns:
                texts = b.column(c).to_pylist()
                done = {t: (unify(t), sorted(findings(t))) for t in set(texts)}
                added += [[done[t][0] for t in texts], [done[t][1] for t in texts]]
            arrays = [pa.array(x, type=f.type) for x, f in zip(added, list(arrow)[len(b.schema) :])]
            yield pa.RecordBatch.from_arrays([*(x.cast(f.type) for x, f in zip(b.columns, arrow)), *arrays], schema=arrow)

    return df.mapInArrow(run, kind)


FIELDS = ("caption", "ocr_text", "meaning")
COUNTED = {"wide", "joined", "separate", "invisible", "space", "mixed"}


def has_odd(field: str, text: str | None) -> bool:
    """Whether any string of a record's field has a counted finding."""
    if not text or (text.isascii() and "\\u" not in text):
        return False
    value = text if field == "ocr_text" else parse(text)
    return any(findings(s) & COUNTED for s in strings(value))


def odd_fields(memes: DataFrame) -> DataFrame:
    """(id, fld): the fields of live records with unusual characters.

    Each row is judged where it is read; only (id, time, three bits) is
    shuffled to choose the live row, so the texts never move.
    """

    def make():
        def step(c):
            bits = [sum(has_odd(f, t) << k for k, (f, t) in enumerate(zip(FIELDS, row))) for row in zip(*(c[f] for f in FIELDS))]
            return {"id": c["id"], "stamp": c["stamp"], "bits": bits}

        return step

    rows = map_batches(memes.select("id", age().alias("stamp"), *FIELDS), make, "id string, stamp timestamp_ntz, bits int")
    live = newest(rows.filter("id is not null"), ["id"], "stamp", ["bits"]).filter("bits > 0")
    flds = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << k) > 0, F.lit(f)) for k, f in enumerate(FIELDS)]), lambda x: x.isNotNull())
    return live.select("id", F.explode(flds).alias("fld"))
