"""Label texts: reading the indented format, making lists, checking against the schema, labelling images."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import LANGUAGES

REQUIRED_MARK = "multilingual_embedding_text:"
MOST_TRIES = 3
NUMBER = re.compile(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", re.ASCII)
TABLE = re.compile(r"(\w+)\[(\d+)\]\{([^}]+)\}:")
INLINE = re.compile(r"(\w+)\[(\d+)\]:(.*)", re.S)
WORDS = {"true": True, "false": False, "null": None}


def number(text: str) -> float | int | None:
    """A text as a number by the rules of the format (the empty text is 0), or None."""
    t = text.strip()
    if not t:
        return 0
    if not NUMBER.fullmatch(t):
        return None
    if t[:2].lower() in ("0x", "0o", "0b"):
        return int(t, 0)
    value = float(t.replace("Infinity", "inf"))
    return int(value) if value.is_integer() and abs(value) < 2**53 else value


def scalar(text: str) -> object:
    """A value: true, false, null, a quoted string, a number or a plain string."""
    if text in WORDS:
        return WORDS[text]
    if text.startswith('"') and text.endswith('"'):
        return text[1:-1]
    n = number(text)
    return text if n is None else n


def cells(text: str) -> list[object]:
    return [scalar(c.strip()) for c in text.strip().split(",")]


class LabelText:
    """Reads an indented text into nested dictionaries.

    A line belongs to the nearest key above it that is indented less. ``name[n]{a,b}:`` heads rows
    two columns further in, ``name[n]: a,b`` is a list (n is not checked), ``key:`` alone opens an
    object, ``key: value`` splits at the first colon. Blank lines and those that begin with # say nothing.
    """

    def __init__(self, text: str):
        self.lines = text.strip().split("\n")
        self.at = 0

    @staticmethod
    def indent(line: str) -> int:
        bare = line.lstrip()
        return len(line) - len(bare) if bare else -1

    def rows(self, fields: list[str], indent: int) -> list[dict[str, object]]:
        out = []
        while self.at < len(self.lines) and self.indent(self.lines[self.at]) == indent:
            values = cells(self.lines[self.at])
            out.append({f: values[i] if i < len(values) else None for i, f in enumerate(fields)})
            self.at += 1
        return out

    def block(self, above: int) -> dict[str, object]:
        """The entries of lines indented more than ``above``."""
        out: dict[str, object] = {}
        while self.at < len(self.lines):
            line = self.lines[self.at]
            here, content = self.indent(line), line.lstrip()
            if here < 0 or content.startswith("#"):
                self.at += 1
                continue
            if here <= above:
                break
            self.at += 1
            if m := TABLE.fullmatch(content):
                out[m[1]] = self.rows([f.strip() for f in m[3].split(",")], here + 2)
            elif m := INLINE.fullmatch(content):
                out[m[1]] = cells(m[3])
            elif ":" in content:
                key, _, value = content.partition(":")
                out[key.strip()] = scalar(value.strip()) if value.strip() else self.block(here)
        return out

    def read(self) -> dict[str, object]:
        return self.block(-1)


LISTS = ("supported_languages", "emotion", "humor_type", "tone", "regions", "people", "cultural_references")
SECTIONS = ("tags", "query_examples", "negative_examples", "do_not_show_when")


def as_list(value: object) -> list[object]:
    """A list as it is, a string with commas cut at them, anything else as a list of one."""
    if isinstance(value, list):
        return value
    if isinstance(value, str) and "," in value:
        return [v for v in map(scalar, (p.strip() for p in value.split(","))) if v != ""]
    return [value]


def truthy(value: object) -> bool:
    """Whether the format takes a value as given; empty lists and objects count as given."""
    return isinstance(value, (list, dict)) or bool(value)


def with_lists(label: dict) -> dict:
    """Makes lists of what should be lists."""
    for key in LISTS:
        if truthy(label.get(key)):
            label[key] = as_list(label[key])
    if isinstance(label.get("intent"), str) and label["intent"]:
        label["intent"] = [label["intent"]]
    for key in SECTIONS:
        section = label.get(key)
        if isinstance(section, dict):
            for lang in LANGUAGES:
                if truthy(section.get(lang)):
                    section[lang] = as_list(section[lang])
    return label


class Invalid(ValueError):
    """A label that the schema rejects; the text says where and why."""


MISSING = object()


def field(default: object, check) -> dict:
    return {"default": default, "check": check}


def text(path: str, v: object) -> str:
    if not isinstance(v, str):
        raise Invalid(f"{path}: expected a string")
    return v


def flag(path: str, v: object) -> bool:
    if not isinstance(v, bool):
        raise Invalid(f"{path}: expected a boolean")
    return v


def amount(path: str, v: object) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v:
        raise Invalid(f"{path}: expected a number")
    return v


def texts(path: str, v: object) -> list[str]:
    if not isinstance(v, list):
        raise Invalid(f"{path}: expected a list")
    return [text(f"{path}.{i}", x) for i, x in enumerate(v)]


def one_or_many(path: str, v: object) -> list[str]:
    return [v] if isinstance(v, str) else texts(path, v)


def record(fields: dict[str, dict]):
    """A check of an object: known keys only, defaults for missing ones."""

    def check(path: str, v: object) -> dict:
        if not isinstance(v, dict):
            raise Invalid(f"{path or 'label'}: expected an object")
        out = {}
        for key, f in fields.items():
            value = v.get(key, MISSING)
            at = f"{path}.{key}" if path else key
            if value is MISSING:
                if f["default"] is MISSING:
                    raise Invalid(f"{at}: required")
                out[key] = json.loads(json.dumps(f["default"]))
            else:
                out[key] = f["check"](at, value)
        return out

    return check


def five(default: object, check) -> dict:
    return field(dict.fromkeys(LANGUAGES, default), record({x: field(default, check) for x in LANGUAGES}))


SAFETY_KEYS = ("nsfw", "abusive", "hate", "political", "religious")
STRING, STRINGS = field("", text), field([], texts)
check_label = record(
    {
        "id": field(MISSING, text),
        "primary_language": field("unknown", text),
        "supported_languages": STRINGS,
        "caption": field({"original": "", "translations": dict.fromkeys(LANGUAGES, "")}, record({"original": STRING, "translations": five("", text)})),
        "ocr_text": STRING,
        "image_description": STRING,
        "meaning": five("", text),
        "emotion": STRINGS,
        "intent": field([], one_or_many),
        "humor_type": STRINGS,
        "tone": STRINGS,
        "regions": STRINGS,
        "tags": five([], texts),
        "query_examples": five([], texts),
        "negative_examples": field({"english": [], "hinglish": []}, record({"english": STRINGS, "hinglish": STRINGS})),
        "people": STRINGS,
        "source": STRING,
        "cultural_references": STRINGS,
        "scene_description": STRING,
        "safety": field(dict.fromkeys(SAFETY_KEYS, False), record({k: field(False, flag) for k in SAFETY_KEYS})),
        "quality": field({"is_meme": True, "label_confidence": 0}, record({"is_meme": field(False, flag), "label_confidence": field(0, amount)})),
        "multilingual_embedding_text": STRING,
    }
)


def lenient(label: dict) -> dict:
    """For lenient reading: a list that was declared empty and read as [0] becomes empty, numbers in lists become strings."""
    for key in LISTS:
        if label.get(key) == [0]:
            label[key] = []
        elif isinstance(label.get(key), list):
            label[key] = [str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in label[key]]
    return label


def read_label(raw: str | None, strict: bool = True) -> tuple[dict | None, str | None]:
    """(label, error) of a label text; exactly one is None."""
    if not raw or not raw.strip():
        return None, "empty response"
    if REQUIRED_MARK not in raw:
        return None, "truncated response"
    try:
        label = with_lists(LabelText(raw).read())
        return check_label("", label if strict else lenient(label)), None
    except Invalid as e:
        return None, str(e)


def read_labels(df: DataFrame, column: str = "response", strict: bool = True) -> DataFrame:
    """Adds ``label`` (JSON text) and ``error`` to rows with a label text; one of them is null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_label(t, strict) for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else json.dumps(x, ensure_ascii=False) for x, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], [*b.schema.names, "label", "error"])

    return df.mapInArrow(run, f"{kinds}, label string, error string")


class Labeler(Protocol):
    """Gives the label text of an image, or raises. A failed request is not tried again, an unusable text is."""

    def label(self, content: bytes, mime: str, item_id: str, attempt: int) -> str: ...


class StubLabeler:
    """A deterministic stand-in that labels an image by its size."""

    def label(self, content: bytes, mime: str, item_id: str, attempt: int) -> str:
        return f"id: {item_id}\nprimary_language: english\nemotion[1]: joy\ncaption:\n  original: image of {len(content)} bytes\nmultilingual_embedding_text: {mime} of {len(content)} bytes\n"


def response_text(content: object) -> str:
    """A chat answer's text: a string, or the texts of its parts."""
    if content is None:
        return ""
    if isinstance(content, list):
        return "".join(p["text"] for p in content if isinstance(p, dict) and isinstance(p.get("text"), str))
    return str(content)


def label_images(images: DataFrame, labeler: Labeler, tries: int = MOST_TRIES) -> DataFrame:
    """(path, item_id, label, error, attempts) of images (path, content): unusable texts are asked for again, failures recorded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"path": [], "item_id": [], "label": [], "error": [], "attempts": []}
            for path, content, item_id in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("item_id").to_pylist()):
                mime = "image/png" if path.lower().endswith(".png") else "image/webp" if path.lower().endswith(".webp") else "image/jpeg"
                label, error, n = None, "not tried", 0
                while label is None and n < tries:
                    n += 1
                    try:
                        answer = response_text(labeler.label(content, mime, item_id, n))
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        break
                    label, error = read_label(answer)
                for k, v in (("path", path), ("item_id", item_id), ("label", None if label is None else json.dumps(label, ensure_ascii=False)), ("error", error), ("attempts", n)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("item_id", pa.string()), ("label", pa.string()), ("error", pa.string()), ("attempts", pa.int32())]))

    named = images.withColumn("item_id", F.concat(F.lit("meme_"), F.substring(F.sha2("path", 256), 1, 12)))
    return named.select("path", "content", "item_id").mapInArrow(run, "path string, item_id string, label string, error string, attempts int")


def outcome(labelled: DataFrame) -> DataFrame:
    """(total, succeeded, failed) of label_images."""
    return labelled.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
