"""Full-text search: BM25 over search texts, with a query language of AND, OR, NOT, phrases, prefixes, NEAR groups, column filters
and ``^`` for a text's first term. The columns are search_text and meme_id, of which the latter holds no terms.

score = sum over phrases of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)),
idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; k1 = 1.2, b = 0.75.

A search counts its phrases in each text where the text is read: one pass for
the corpus figures (one row), one for the scores; no posting is shuffled. ``postings``
builds the inverted index as a table for those who want to keep it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms

K1, B, FLOOR = 1.2, 0.75, 1e-6


class QuerySyntaxError(ValueError):
    """A text that the query language does not accept."""


@dataclass(frozen=True)
class Phrase:
    """Terms that stand next to each other; with prefix, the last one may go on."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False  # only where a text begins
    nowhere: bool = False  # only in columns without terms


@dataclass(frozen=True)
class Near:
    """Phrases that all stand within a distance: between the end of the first and the beginning of the last at most so many terms."""

    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Member:
    """One phrase of a Near group; it counts where the group matches."""

    group: Near
    at: int


@dataclass(frozen=True)
class Op:
    """AND, OR or NOT of two queries."""

    name: str
    left: object
    right: object


def query_terms(text: str) -> tuple[str, ...]:
    """A text's terms, as functions.text.terms gives them for columns."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not "̀" <= c <= "ͯ")
    out, cur = [], ""
    for c in flat:
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            cur += c
        elif cur:
            out.append(cur)
            cur = ""
    return tuple(out + [cur] if cur else out)


LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()*+{}:,^-])|([^\s"()*+{}:,^-]+))')
COLUMNS = {"search_text", "meme_id"}
BAREWORD = re.compile(r"(?:[A-Za-z0-9_\x1a]|[^\x00-\x7f])+")


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEXEME.match(text, at)
        if not m:
            raise QuerySyntaxError("a string is not closed")
        quoted, sign, word = m.groups()
        if quoted:
            out.append(("text", quoted[1:-1].replace('""', '"')))
        elif sign:
            out.append((sign, sign))
        elif word in ("AND", "OR", "NOT"):
            out.append((word, word))
        elif BAREWORD.fullmatch(word):
            out.append(("text", word))
        else:
            raise QuerySyntaxError(f"unexpected sign in {word!r}")
        at = m.end()
    return out


class _Reader:
    """Reads a query by binding strength: phrase, implicit AND, NOT, AND, OR."""

    def __init__(self, lexemes: list[tuple[str, str]]):
        self.lexemes, self.at = lexemes, 0

    def peek(self) -> str:
        return self.lexemes[self.at][0] if self.at < len(self.lexemes) else ""

    def chain(self, name: str, part) -> object:
        node = part()
        while self.peek() == name:
            self.at += 1
            node = Op(name, node, part())
        return node

    def either(self) -> object:
        return self.chain("OR", self.both)

    def both(self) -> object:
        return self.chain("AND", self.without)

    def without(self) -> object:
        return self.chain("NOT", self.group)

    def group(self) -> object:
        """A parenthesis, or phrases one after another, which all must match."""
        bracket = self.peek() == "("
        node = self.one()
        bracket = bracket or self.lexemes[self.at - 1][0] == ")" and not isinstance(node, Near)
        while not bracket and self.peek() in ("text", "^", "-", "{"):
            node = Op("AND", node, self.one())
        return node

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise QuerySyntaxError(f"{kind} expected, not {self.peek() or 'the end'}")
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def columns(self) -> set[str] | None:
        """The columns of a filter, if one stands here."""
        start = self.at
        without = self.peek() == "-"
        self.at += without
        if self.peek() == "{":
            self.at += 1
            names = {self.take("text")}
            while self.peek() == "text":
                names.add(self.take("text"))
            self.take("}")
        elif self.peek() == "text" and (without or self.lexemes[self.at + 1 : self.at + 2] == [(":", ":")]):
            names = {self.take("text")}
        else:
            self.at = start
            return None
        self.take(":")
        names = {n.lower() for n in names}
        if names - COLUMNS:
            raise QuerySyntaxError(f"no such column: {min(names - COLUMNS)}")
        return COLUMNS - names if without else names

    def one(self) -> object:
        allowed = self.columns()
        if self.peek() == "(":
            self.at += 1
            node = self.either()
            if self.peek() != ")":
                raise QuerySyntaxError("a parenthesis is not closed")
            self.at += 1
        elif self.lexemes[self.at : self.at + 2] == [("text", "NEAR"), ("(", "(")]:
            self.at += 2
            parts = [self.phrase()]
            while self.peek() == "text":
                parts.append(self.phrase())
            distance = 10
            if self.peek() == ",":
                self.at += 1
                number = self.take("text")
                if not number.isascii() or not number.isdigit():
                    raise QuerySyntaxError(f"expected a number, not {number!r}")
                distance = int(number)
            self.take(")")
            parts = [x for x in parts if x.terms]
            node = Near(tuple(parts), distance) if len(parts) > 1 else parts[0] if parts else Phrase(())
        else:
            first = self.peek() == "^"
            self.at += first
            node = self.phrase()
            node = replace(node, first=first)
        return node if allowed is None or "search_text" in allowed else nowhere(node)

    def phrase(self) -> Phrase:
        if self.peek() != "text":
            raise QuerySyntaxError(f"unexpected {self.peek() or 'end'}")
        words = query_terms(self.lexemes[self.at][1])
        self.at += 1
        while self.peek() == "+":
            self.at += 1
            if self.peek() != "text":
                raise QuerySyntaxError("+ needs a text")
            words += query_terms(self.lexemes[self.at][1])
            self.at += 1
        prefix = self.peek() == "*"
        self.at += prefix
        return Phrase(words, prefix)


def nowhere(node: object) -> object:
    """A query of which no phrase can stand anywhere."""
    if isinstance(node, Phrase):
        return replace(node, nowhere=True)
    if isinstance(node, Near):
        return Near(tuple(map(nowhere, node.phrases)), node.distance)
    return Op(node.name, nowhere(node.left), nowhere(node.right))


def parse_query(text: str) -> object:
    """A query's tree; raises QuerySyntaxError."""
    reader = _Reader(_lex(text))
    node = reader.either()
    if reader.peek():
        raise QuerySyntaxError(f"unexpected {reader.peek()}")
    return node


def phrases(node: object) -> list[Phrase | Member]:
    """The phrases with terms in a tree, in order; those of a Near group as its members."""
    if isinstance(node, Phrase):
        return [node] if node.terms else []
    if isinstance(node, Near):
        return [Member(node, i) for i in range(len(node.phrases))]
    return phrases(node.left) + phrases(node.right)


def standing(tokens: Column, p: Phrase) -> Column:
    """For each term of an array whether a phrase begins there."""
    last = len(p.terms) - 1

    def same(i: int):
        return lambda t: t.startswith(p.terms[i]) if p.prefix and i == last else t == p.terms[i]

    # truth values of each term, shifted onto the first one's place: the terms are made a fixed number of times
    here = F.transform(tokens, same(0))
    for i in range(1, last + 1):
        later = F.transform(F.slice(tokens, F.lit(i + 1), F.greatest(F.size(tokens), F.lit(1))), same(i))
        here = F.zip_with(here, later, lambda a, b: a & F.coalesce(b, F.lit(False)))
    return F.slice(here, 1, 1) if p.first else here


def occurrences(tokens: Column, p: Phrase | Member) -> Column:
    """How often a phrase stands in an array of terms."""
    if isinstance(p, Member):
        group = p.group
        if any(x.nowhere for x in group.phrases):
            return F.lit(0)
        places = [F.filter(F.transform(standing(tokens, x), lambda on, i: F.when(on, i)), lambda i: i.isNotNull()) for x in group.phrases]

        def within(at: Column, end: Column, k: int) -> Column:
            return (at <= end) & (at >= end - len(group.phrases[k].terms) - group.distance)

        def stands(end: Column, k: int) -> Column:
            return F.exists(places[k], lambda at: within(at, end, k))

        def whole(end: Column) -> Column:
            return reduce(lambda a, b: a & b, [stands(end, k) for k in range(len(places))])

        # the last beginnings of stretches in which every phrase stands, then the phrase's places in such stretches
        ends = F.filter(reduce(F.array_union, places), whole)
        return F.size(F.filter(places[p.at], lambda at: F.exists(ends, lambda end: within(at, end, p.at))))
    return F.lit(0) if p.nowhere else F.size(F.filter(standing(tokens, p), lambda x: x))


def _matches(node: object, counts: dict[Phrase | Member, str]) -> Column:
    if isinstance(node, Phrase):
        return F.col(counts[node]) > 0 if node.terms else F.lit(False)
    if isinstance(node, Near):
        return F.col(counts[Member(node, 0)]) > 0
    # a phrase without terms takes no part in AND and OR
    sides = [x for x in (node.left, node.right) if not (isinstance(x, Phrase) and not x.terms)]
    if node.name in ("AND", "OR") and len(sides) == 1:
        return _matches(sides[0], counts)
    left, right = _matches(node.left, counts), _matches(node.right, counts)
    return left & right if node.name == "AND" else left | right if node.name == "OR" else left & ~right


def bm25(texts: DataFrame, query: str, limit: int) -> DataFrame:
    """(meme_id, score, pos): the best ``limit`` texts for a query, from (meme_id, search_text).

    A query that the language does not accept gives no rows, as does one without a term.
    Higher scores are better; ties go to the smaller id. If there is a ``labeled_at``, an id may have several texts
    and the latest counts: all are counted where they are read, and only the counts are moved to choose among them.
    """
    none = texts.select("meme_id", F.lit(0.0).alias("score"), F.lit(0).alias("pos")).limit(0)
    try:
        tree = parse_query(query)
    except QuerySyntaxError:
        return none
    found = list(dict.fromkeys(phrases(tree)))
    if not found:
        return none
    name = {p: f"tf{i}" for i, p in enumerate(found)}
    # how rare a phrase is goes by the texts that hold it at all, also where a group counts only some of its places
    alone = {n: f"any{i}" for i, (p, n) in enumerate(name.items()) if isinstance(p, Member)}
    version = ["labeled_at"] if "labeled_at" in texts.columns else []
    counted = texts.select("meme_id", *version, terms(F.col("search_text")).alias("t")).select("meme_id", *version, F.size("t").alias("dl"), *[occurrences(F.col("t"), p).alias(n) for p, n in name.items()], *[occurrences(F.col("t"), p.group.phrases[p.at]).alias(alone[n]) for p, n in name.items() if n in alone])
    if version:
        numbers = ["dl", *name.values(), *alone.values()]
        counted = counted.groupBy("meme_id").agg(F.max(F.struct("labeled_at", *numbers)).alias("v")).select("meme_id", *[f"v.{n}" for n in numbers])
    corpus = counted.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(alone.get(n, n)) > 0).cast("long")).alias(f"n_{n}") for n in name.values()])
    scored = counted.filter(_matches(tree, name)).join(F.broadcast(corpus))  # one row of corpus figures
    score: Column = F.lit(0.0)
    for n in name.values():
        idf = F.log((F.col("N") - F.col(f"n_{n}") + 0.5) / (F.col(f"n_{n}") + 0.5))
        tf = F.col(n)
        score += F.greatest(idf, F.lit(FLOOR)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    top = scored.select("meme_id", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "meme_id").limit(limit)
    from .vector_search import ranked

    return ranked(top.withColumn("_r", F.round("score", 9)), "_r").drop("_r")


def postings(texts: DataFrame) -> DataFrame:
    """(term, meme_id, tf): the inverted index; counts are combined before the shuffle."""
    return texts.select("meme_id", F.explode(terms(F.col("search_text"))).alias("term")).groupBy("term", "meme_id").agg(F.count("*").alias("tf"))


def replace_texts(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index of search texts with those of ``new`` in place of the old ones: idempotent by id."""
    return index.join(new.select("meme_id"), "meme_id", "left_anti").unionByName(new.select("meme_id", "search_text").dropDuplicates(["meme_id"]))
