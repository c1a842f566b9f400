"""Analysing a request's text before the search: names in it, language, region, emotion."""

from __future__ import annotations

import re
from typing import Protocol

from ..sources.schema import QueryAnalysis


class QueryAnalyzer(Protocol):
    """Gives the analysis of a query text, or raises."""

    def analyze(self, query: str) -> QueryAnalysis: ...


class WordAnalyzer:
    """A deterministic stand-in: names, regions and emotions from given lists that stand in the text as whole words."""

    def __init__(self, names: list[str], regions: tuple[str, ...] = (), emotions: tuple[str, ...] = (), language: str = "english"):
        self.names, self.regions, self.emotions, self.language = names, regions, emotions, language

    def analyze(self, query: str) -> QueryAnalysis:
        text = query.lower()
        has = lambda x: re.search(rf"(?<!\w){re.escape(x.lower())}(?!\w)", text) is not None
        return QueryAnalysis(self.language, regions=tuple(filter(has, self.regions))[:2], emotions=tuple(filter(has, self.emotions))[:3], detected_people=tuple(filter(has, self.names))[:5])


def analysed_names(query: str, analyzer: QueryAnalyzer | None) -> list[str]:
    """The people that an analyzer finds in a query; none without an analyzer or where it fails."""
    if analyzer is None:
        return []
    try:
        return list(analyzer.analyze(query).detected_people)
    except Exception:
        return []
