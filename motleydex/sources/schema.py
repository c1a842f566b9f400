"""The data model: tables, nested values and requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LANGUAGES = ("english", "hindi", "hinglish", "tamil", "telugu")
ASPECTS = ("main", "people", "context", "use_case")


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, B, LIST = T.StringType(), T.BooleanType(), T.ArrayType(T.StringType())
FIVE_TEXTS = _struct(dict.fromkeys(LANGUAGES, S))
FIVE_LISTS = _struct(dict.fromkeys(LANGUAGES, LIST))
CAPTION = _struct({"original": S, "translations": FIVE_TEXTS})
SAFETY = _struct(dict.fromkeys(("nsfw", "abusive", "hate", "political", "religious"), B))
QUALITY = _struct({"is_meme": B, "label_confidence": T.DoubleType()})

#: Columns of a stored item that hold JSON, and what they parse to.
NESTED = {
    "supported_languages": LIST,
    "caption": CAPTION,
    "meaning": FIVE_TEXTS,
    "tags": FIVE_LISTS,
    "query_examples": FIVE_LISTS,
    "emotion": LIST,
    "intent": LIST,
    "regions": LIST,
    "safety": SAFETY,
    "quality": QUALITY,
    "people": LIST,
    "cultural_references": LIST,
}
ITEM_COLUMNS = (
    "id", "image_path", "primary_language", "supported_languages", "caption", "meaning", "tags", "query_examples", "emotion", "intent", "regions", "safety", "quality",
    "multilingual_embedding_text", "ocr_text", "image_description", "people", "source", "cultural_references", "scene_description", "popularity_score", "labeled_at", "reviewed",
)
ITEMS = _struct({c: T.IntegerType() if c == "popularity_score" else T.TimestampNTZType() if c == "labeled_at" else B if c == "reviewed" else S for c in ITEM_COLUMNS})
VECTORS = _struct({"aspect": S, "meme_id": S, "embedding": T.ArrayType(T.FloatType()), "model": S, "created_at": T.TimestampNTZType()})
PEOPLE = _struct({"person_name": S, "meme_id": S})
SEARCH_TEXTS = _struct({"meme_id": S, "search_text": S})
#: A row of a label file.
LABEL_ROW = _struct(
    {"id": S, "image_path": S, "primary_language": S, "supported_languages": LIST, "caption": CAPTION, "meaning": FIVE_TEXTS, "tags": FIVE_LISTS, "query_examples": FIVE_LISTS, "emotion": LIST, "intent": LIST, "regions": LIST, "safety": SAFETY, "quality": QUALITY, "multilingual_embedding_text": S, "labeled_at": T.TimestampType(), "reviewed": B}
)
EMBEDDING_CACHE = _struct({"model": S, "built_at": S, "entries": T.ArrayType(_struct({"id": S, "embedding": T.ArrayType(T.FloatType())}))})
PANELS = _struct(
    {"image": S, "width": T.IntegerType(), "height": T.IntegerType(), "panels": T.ArrayType(_struct({"id": T.IntegerType(), "bbox": T.ArrayType(T.IntegerType()), "text_blocks": T.ArrayType(_struct({"bbox": T.ArrayType(T.IntegerType()), "text": S, "lines": T.IntegerType(), "font_px": T.IntegerType(), "position": S}))}))}
)


@dataclass(frozen=True)
class SearchOptions:
    """Parameters of a retrieval; an empty option does not filter."""

    language: str | None = None
    region: str | None = None
    emotion: str | None = None
    limit: int = 10
    min_similarity: float = 0.35


@dataclass(frozen=True)
class SearchRequest:
    """A checked request: a query of at least one character and a limit from 1 to 50."""

    query: str
    language: str | None = None
    region: str | None = None
    emotion: str | None = None
    limit: int = 10
    rerank: bool = True

    def __post_init__(self) -> None:
        if not isinstance(self.query, str) or len(self.query) < 1:
            raise ValueError("query must be a string of at least one character")
        if isinstance(self.limit, bool) or not isinstance(self.limit, (int, float)) or not 1 <= self.limit <= 50:
            raise ValueError("limit must be a number from 1 to 50")
        for name in ("language", "region", "emotion"):
            value = getattr(self, name)
            if value is not None and not isinstance(value, str):
                raise ValueError(f"{name} must be a string")
        if not isinstance(self.rerank, bool):
            raise ValueError("rerank must be a boolean")


@dataclass(frozen=True)
class BatchQuery:
    """One query of a batch."""

    query: str
    language: str | None = None
    region: str | None = None
    limit: int = 5


def batch_queries(queries: object) -> list[BatchQuery]:
    """Checks that a batch is a non-empty list."""
    if not isinstance(queries, list) or not queries:
        raise ValueError("queries must be a non-empty list")
    return [q if isinstance(q, BatchQuery) else BatchQuery(**q) for q in queries]


#: The closed vocabularies of query analysis.
ANALYSIS_LIMITS = {"emotions": 3, "intents": 3, "regions": 2}


@dataclass(frozen=True)
class QueryAnalysis:
    """What a query analyser returns."""

    language: str
    emotions: tuple[str, ...] = ()
    intents: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    detected_people: tuple[str, ...] = ()
    source_reference: str = ""
    expanded_text: str = ""

    def __post_init__(self) -> None:
        for name, most in ANALYSIS_LIMITS.items():
            if len(getattr(self, name)) > most:
                raise ValueError(f"at most {most} {name}")
