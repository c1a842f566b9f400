"""Texts made from items: name normalisation, search texts, aspect texts, descriptions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import LANGUAGES

ORDER = ("english", "hinglish", "hindi", "tamil", "telugu")


def normalise_person(name: Column) -> Column:
    """Lower case, parentheses with the blanks before them removed, trimmed; blanks of any script count."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)\s*\(.*?\)", ""), r"(?U)^\s+|\s+$", "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def filled(parts: list[Column], separator: str = " ") -> Column:
    """The parts that are not empty, joined."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), separator)


def sentence(prefix: str, text: Column) -> Column:
    """prefix, text and a full stop; the empty string if there is no text."""
    return F.when(F.length(text) > 0, F.concat(F.lit(prefix), text, F.lit("."))).otherwise("")


def joined(values: Column, separator: str = ", ") -> Column:
    return F.array_join(values, separator, "")


def by_language(column: str, languages: tuple[str, ...] = ORDER) -> Column:
    """The lists of the languages, one after another."""
    empty = F.expr("cast(array() as array<string>)")
    return F.concat(*[F.coalesce(F.col(f"{column}.{x}"), empty) for x in languages])


def search_text(backfill: bool = False) -> Column:
    """The text of the full-text index; the backfill order puts lists of tags before the source."""
    en, hg = ("english", "hinglish")
    lists = [F.concat(F.col("people"), F.col("cultural_references")), by_language("tags", (en, hg)), by_language("query_examples", (en, hg))]
    head = ["caption.original", "caption.translations.english", "ocr_text", "image_description", "scene_description"]
    meaning = [f"meaning.{en}", f"meaning.{hg}"]
    one = lambda cols: [F.col(c) for c in cols]
    if backfill:
        order = [F.array(*one(head + meaning)), lists[1], lists[2], lists[0], F.array(F.col("source"))]
    else:
        order = [F.array(*one(head + meaning), F.col("source")), *lists]
    return F.array_join(F.filter(F.concat(*order), lambda x: x.isNotNull() & (x != "")), " ")


def people_text() -> Column:
    people, source, refs = F.col("people"), trimmed(F.col("source")), F.col("cultural_references")
    text = filled([
        F.when(F.size(people) > 0, F.concat(F.lit("People: "), joined(people), F.lit("."))),
        F.when(F.size(people) > 0, F.concat(F.lit("Names: "), joined(people, " "), F.lit("."))),
        sentence("Source: ", source),
        sentence("Origin: ", source),
        F.when(F.size(refs) > 0, F.concat(F.lit("Cultural references: "), joined(refs, ". "), F.lit("."))),
        sentence("OCR text: ", trimmed(F.col("ocr_text"))),
    ])
    return F.when(text == "", "No specific people or source identified.").otherwise(text)


def context_text() -> Column:
    refs, people = F.col("cultural_references"), F.col("people")
    text = filled([
        sentence("Scene: ", trimmed(F.col("scene_description"))),
        sentence("Visual: ", trimmed(F.col("image_description"))),
        sentence("Source/Origin: ", trimmed(F.col("source"))),
        F.when(F.size(refs) > 0, F.concat(F.lit("Cultural: "), joined(refs, ". "), F.lit("."))),
        sentence("Text in image: ", trimmed(F.col("ocr_text"))),
        sentence("Caption: ", F.col("caption.original")),
        F.when(F.size(people) > 0, F.concat(F.lit("People: "), joined(people), F.lit("."))),
    ])
    return F.when(text == "", "No contextual information available.").otherwise(text)


def use_case_text() -> Column:
    parts = [sentence(f"Meaning ({x.capitalize()}): ", F.col(f"meaning.{x}")) for x in LANGUAGES]
    parts += [sentence("When to use: ", joined(by_language("query_examples"))), sentence("Tags: ", joined(by_language("tags")))]
    for label, column in (("Emotion: ", "emotion"), ("Intent: ", "intent"), ("Region: ", "regions")):
        parts.append(F.when(F.size(column) > 0, F.concat(F.lit(label), joined(F.col(column)), F.lit("."))))
    text = filled(parts)
    return F.when(text == "", F.col("multilingual_embedding_text")).otherwise(text)


def shown_caption() -> Column:
    """The English translation, else the original, else empty; an empty translation counts as given."""
    return F.coalesce("caption.translations.english", "caption.original", F.lit(""))


def description() -> Column:
    """What a reranker reads of an item."""
    part = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c)).otherwise("")
    many = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), joined(F.col(c)))).otherwise("")
    return filled([part("Scene: ", F.col("scene_description")), part("Source: ", F.col("source")), many("People: ", "people"), part("Meaning: ", F.col("meaning.english")), part("Caption: ", shown_caption()), many("Emotion: ", "emotion")], ". ")


@lru_cache(1)
def diacritics() -> tuple[str, str]:
    """Accented Latin letters and their plain ones, by Unicode decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(code), base[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def terms(text: Column) -> Column:
    """The terms of a text as the full-text index sees them: runs of letters and digits, lower case, Latin accents
    dropped. Vowel signs of Indic scripts separate terms, as in the index that is matched."""
    accented, plain = diacritics()
    flat = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[̀-ͯ]", ""), accented, plain)
    return F.regexp_extract_all(flat, F.lit(TOKEN), F.lit(0))


def natural_key(name: Column) -> Column:
    """Sorts names by their numbers' values and without case: digit runs are padded to 20 places."""
    padded = F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x))
    return F.array_join(padded, "")


def iso_time(c: Column) -> Column:
    """A time stamp as ISO text in UTC with milliseconds."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def mime(path: Column) -> Column:
    """The media type of an image by its name."""
    low = F.lower(path)
    return F.when(low.endswith(".png"), "image/png").when(low.endswith(".webp"), "image/webp").otherwise("image/jpeg")


def data_url(path: Column, content: Column) -> Column:
    """An image as a data URL."""
    return F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), "\\s", ""))
