"""Problem 9: text statistics of documents, and what kind of text they are.

A hidden Markov model labels every line of a document. Its hidden states are ways in which prose, lists, tables and junk
are written (STATES); a line shows quantised statistics (``lines.FEATURES``: pieces, common words, marks
at its start, cells, separators, signs, ...), each with a table of probabilities in each state. The likeliest
states of a document's lines (Viterbi) give their labels; the shares of the labels are taken over pieces, what stands between blanks.

Nothing in the model is set by hand but which lines are clear: a line whose statistics leave no doubt about its state
(``clear_lines``) is held to it. All other probabilities, of statistics in states, of states after states
and of first states, are estimated by Baum-Welch from the clear lines and those between them, on a sample of at most about
``sample_documents`` documents of at most ``sample_lines`` lines, chosen by a hash of their texts; a few example lines of each state
(EXAMPLES) count once each, so that states absent from the sample are known too. Every document is labelled.

Common words are found in the corpus itself, over all documents: words of a script
that make up at least ``common_share`` of what clear prose lines of that script
hold and are rarer elsewhere. That bounds their number
(at most 1 / common_share per script); they are broadcast as 64-bit hashes.

Defined cases: null, empty and blank texts have zero pieces, null ratios and no
kind; lines end at any of the usual line ends; an empty table gives an empty
result; long texts and long lines are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import persist_table
from .common import map_batches
from .lines import FEATURES, Lines, bins, chunks, measure

KINDS = ("prose", "list", "table", "junk")
# The hidden states, with the kind that each is a way of writing.
STATES = {"sentence": 0, "part of a sentence": 0, "marked item": 1, "bare item": 1, "items in a line": 1, "cells": 2, "key and value": 2, "values": 2, "signs": 3, "mash": 3, "links": 3, "broken": 3, "words": 3}
KIND_OF = np.array(list(STATES.values()))
EXAMPLES = {
    "marked item": ("- blue door", "* tea", "1. rain coat", "b) late", "[x] sugar", "• old boots", "→ milk"),
    "bare item": ("blue door", "tea.", "rain coat", "sugar"),
    "items in a line": ("blue door, tea, rain coat, sugar, milk", "tea / rain coat / milk / old boots / sugar", "milk; tea; sugar; boots; door"),
    "cells": ("| tea | 3 | 0.5 |", "tea\t3\t0.5\tcup", '"tea";"3";"0.5"', "name=tea; n=3; p=0.5", "--- | --- | --- | ---", "tea | 3 | 0.5 | cup", "size  3  0.5  cup"),
    "key and value": ("name: tea", "  size: 3", "price: 0.50", "kind[2]: hot,cold"),
    "values": ("tea,3,0.5,cup", "milk,17,0.25,jug", "[12, 40, 7, 9] 15 tea"),
    "signs": ("### <<< &&&", "----", "~~~ !!! ^^", "0O |I -- ;: ~ '.", "rn |I 0O ii1 ;: vv -- l1 ;: cl"),
    "mash": ("sdkfj wrtkl xcvbn qwrty", "aG8xK2mQ9zRt4LpW7vBn3YcD6fHs1JkE5uTo0iPqA", "fd;gk sl;dfk gh;jk"),
    "links": ("https://tea.example/cup?id=5", "#tea #milk #sugar4u", "www.tea.example/milk"),
    "broken": ("Ã©té â€na Â»po à¤lo Ã±i", "�� te� ��mi �"),
    "words": ("door sugar boots LADDER milk window TABLE spoon kettle", "tea tea tea tea tea tea tea tea tea tea"),
}


@dataclass
class Model:
    """Logarithms of the probabilities: of first states, of states after states, and of each statistic's values in each state."""

    first: np.ndarray
    after: np.ndarray
    shown: dict[str, np.ndarray]

    def scores(self, values: dict[str, np.ndarray]) -> np.ndarray:
        """(lines, states): the log-probability of a line's statistics in each state."""
        n = len(values["pieces"])
        out = np.zeros((n, len(STATES)))
        for f, table in self.shown.items():
            out += table[values[f]]
        return out


@dataclass
class Words:
    """The common words by hash, ascending."""

    hashes: np.ndarray

    def values(self, found: Lines) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """All statistics of lines, with those that depend on common words; and the common words of each line."""
        n = len(found.doc)
        at = np.minimum(np.searchsorted(self.hashes, found.word_hash), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == found.word_hash if len(self.hashes) else np.zeros(len(found.word_hash), bool)
        hits = np.bincount(found.word_line[known], minlength=n)
        words = np.bincount(found.word_line, minlength=n)
        return found.values | {"hits": bins(hits, (1, 2, 3, 4, 6)), "common": bins(hits / np.maximum(1, words), (0.001, 0.15, 0.3, 0.5))}, hits


def plain_lines(v: dict[str, np.ndarray]) -> np.ndarray:
    """Lines without marks, cells and anything odd in them."""
    return (v["marker"] == 0) & (v["signs"] == 0) & (v["mash"] == 0) & (v["links"] == 0) & (v["broken"] == 0) & (v["cells"] == 0) & (v["capitals"] == 0)


def clear_prose(v: dict[str, np.ndarray]) -> np.ndarray:
    """Lines that look like sentences without knowing any words: six pieces or more, varied, few commas and digits."""
    return plain_lines(v) & (v["pieces"] >= 5) & (v["distinct"] >= 1) & (v["item_size"] >= 2) & (v["items"] <= 2) & (v["digits"] <= 1) & (v["tight"] == 0)


def clear_lines(v: dict[str, np.ndarray], doc: np.ndarray) -> np.ndarray:
    """The state of each line that is clear about it, else -1."""
    state = np.full(len(doc), -1, np.int8)
    plain = plain_lines(v)
    number = {s: k for k, s in enumerate(STATES)}
    quiet = (v["marker"] == 0) & (v["cells"] == 0) & (v["signs"] <= 1) & (v["mash"] <= 1) & (v["links"] <= 1) & (v["broken"] <= 1)
    short = v["pieces"] <= 3
    few = v["hits"] <= 1
    odd = (v["signs"] > 2) | (v["mash"] > 1) | (v["links"] > 1) | (v["broken"] > 1)
    docs = int(doc.max(initial=-1)) + 1
    lines = np.bincount(doc, minlength=docs)
    every = lambda x: (np.bincount(doc, weights=x, minlength=docs) == lines)[doc]
    mostly = lambda x: (2 * np.bincount(doc, weights=x, minlength=docs) >= lines)[doc]
    rules = (
        ("sentence", quiet & (v["pieces"] >= 5) & (v["hits"] >= 3) & (v["common"] >= 2) & (v["item_size"] >= 3) & (v["distinct"] >= 1) & (v["tight"] == 0)),
        ("part of a sentence", plain & (v["pieces"] >= 2) & (v["pieces"] <= 5) & (v["hits"] >= 2) & (v["common"] >= 3) & (v["key"] == 0) & mostly((v["common"] >= 3) & (v["pieces"] >= 2))),
        ("marked item", (v["marker"] > 0) & ~odd & (v["pieces"] <= 5) & few & (v["cells"] == 0) & (v["links"] == 0)),
        ("bare item", plain & short & few & (v["key"] == 0) & (v["tight"] == 0) & every(v["pieces"] <= 4) & mostly(v["hits"] == 0) & (lines >= 4)[doc]),
        ("items in a line", ~odd & (v["items"] >= 3) & (v["item_size"] <= 2) & (v["cells"] == 0) & (v["digits"] == 0) & (v["marker"] == 0) & (v["common"] <= 2) & (v["tight"] == 0) & (v["pieces"] >= 4)),
        ("cells", (v["cells"] >= 2) & ~((v["signs"] > 3) & (v["cells"] < 3))),
        ("key and value", (v["key"] > 0) & short & few & (v["marker"] == 0) & ~odd & (v["cells"] == 0) & mostly((v["key"] > 0) & (v["pieces"] <= 4))),
        ("values", (v["tight"] >= 3) & (v["digits"] > 0) & (v["pieces"] <= 4) & (v["cells"] == 0)),
        ("values", (v["first"] == 4) & (v["digits"] >= 3) & (v["items"] >= 2) & (v["cells"] == 0)),
        ("signs", (v["signs"] == 4) & (v["cells"] == 0)),
        ("mash", (v["mash"] >= 3) & (v["cells"] == 0)),
        ("links", (v["links"] == 4) & (v["cells"] == 0)),
        ("broken", (v["broken"] >= 3) & (v["cells"] == 0)),
        ("words", (v["marker"] == 0) & (v["pieces"] >= 5) & (v["hits"] == 0) & (v["items"] == 0) & (v["cells"] == 0) & (v["digits"] == 0) & (v["end"] == 0) & ~odd & (v["signs"] == 0) & (v["key"] == 0)),
        ("words", (v["distinct"] == 0) & (v["pieces"] >= 6) & (v["items"] == 0) & (v["cells"] == 0) & ~odd),
    )
    seen = np.zeros(len(doc), np.int64)
    for name, where in rules:
        seen += where & (state != number[name])
        state[where] = number[name]
    state[seen > 1] = -1  # clear about two states is not clear
    return state


def steps(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have lines, longest first: where their lines begin, and how many there are."""
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(doc)])
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order]


def likeliest(model: Model, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The likeliest states of all lines (Viterbi), all documents abreast."""
    begin, size = steps(doc)
    if not len(begin):
        return np.zeros(0, np.int8)
    came = np.zeros(scores.shape, np.int8)
    best = np.empty((len(begin), scores.shape[1]))
    best[:] = model.first + scores[begin]
    for t in range(1, int(size[0])):
        k = int(np.searchsorted(-size, -t, "left"))  # documents longer than t lines
        ways = best[:k, :, None] + model.after
        came[begin[:k] + t] = ways.argmax(axis=1)
        best[:k] = ways.max(axis=1) + scores[begin[:k] + t]
    state = np.empty(len(doc), np.int8)
    now = best.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = int(np.searchsorted(-size, -t, "left"))
        state[begin[:k] + t] = now[:k]
        now[:k] = came[begin[:k] + t, now[:k]]
    return state


def expected(model: Model, scores: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line the probability of its states (forward and backward), and the expected numbers of first states and of states after states."""
    begin, size = steps(doc)
    shown = np.exp(scores - scores.max(axis=1, keepdims=True))
    after = np.exp(model.after)
    forward, backward = np.empty(scores.shape), np.ones(scores.shape)
    forward[begin] = np.exp(model.first) * shown[begin]
    forward[begin] /= forward[begin].sum(axis=1, keepdims=True)
    for t in range(1, int(size[0])):
        at = begin[: int(np.searchsorted(-size, -t, "left"))] + t
        x = (forward[at - 1] @ after) * shown[at]
        forward[at] = x / x.sum(axis=1, keepdims=True)
    moves = np.zeros(after.shape)
    for t in range(int(size[0]) - 1, 0, -1):
        at = begin[: int(np.searchsorted(-size, -t, "left"))] + t
        x = shown[at] * backward[at]
        y = x @ after.T
        total = (forward[at - 1] * y).sum(axis=1, keepdims=True)
        moves += after * ((forward[at - 1] / total).T @ x)
        backward[at - 1] = y / y.sum(axis=1, keepdims=True)
    held = forward * backward
    held /= held.sum(axis=1, keepdims=True)
    return held, held[begin].sum(axis=0), moves


def fit(values: dict[str, np.ndarray], doc: np.ndarray, examples: dict[str, np.ndarray], example_states: np.ndarray, rounds: int = 8, smoothing: float = 0.3) -> Model:
    """The model of the lines of a sample, in which clear lines are held to their states (Baum-Welch)."""
    n = len(STATES)
    clear = clear_lines(values, doc)
    number = np.arange(n)
    held = np.where(clear[:, None] >= 0, clear[:, None] == number, 0.0)
    after, start = np.full((n, n), 1.0) + 20 * np.eye(n), np.ones(n)
    own = (example_states[:, None] == number).astype(float)
    barred = np.where((clear[:, None] >= 0) & (clear[:, None] != number), -60.0, 0.0)
    for _ in range(rounds):
        shown = {}
        for f, size in FEATURES.items():
            table = np.full((size, n), smoothing)
            for v, w in ((values[f], held), (examples[f], own)):
                for s in range(n):
                    table[:, s] += np.bincount(v, weights=w[:, s], minlength=size)
            shown[f] = np.log(table / table.sum(axis=0))
        model = Model(np.log(start / start.sum()), np.log(after / after.sum(axis=1, keepdims=True)), shown)
        if not len(doc):
            break
        held, start, moves = expected(model, model.scores(values) + barred, doc)
        after, start = moves + 0.5, start + 0.5
    return model


def common_words(documents: DataFrame, text: str = "text", common_share: float = 0.0015) -> Words:
    """The common words of prose, by script, over all documents."""

    def make():
        def step(c):
            parts: list[np.ndarray] = []
            for _, some in chunks(c[text]):
                found = measure(some)
                v = found.values
                prose = clear_prose(v)
                other = (v["pieces"] <= 3) | (v["marker"] > 0) | (v["cells"] > 0)
                kind = np.where(prose, 1, np.where(other, 2, 0))[found.word_line]
                for k in (1, 2):
                    h, at, n = np.unique(found.word_hash[kind == k], return_index=True, return_counts=True)
                    parts.append(np.stack([found.word_script[kind == k][at], h, n * (k == 1), n * (k == 2)]))
            got = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
            return dict(zip(("script", "word", "p", "q"), got.tolist()))

        return step

    counted = map_batches(documents.select(text), make, "script long, word long, p long, q long")
    # the texts are read once: the counts are stored and summed per script from there
    per = persist_table(counted.groupBy("script", "word").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), "word-counts")
    total = per.groupBy("script").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    rate_p, rate_q = (F.col("p") + 1) / (F.col("tp") + 100), (F.col("q") + 1) / (F.col("tq") + 100)
    found = per.join(F.broadcast(total), "script").filter(F.col("p") >= F.col("tp") * common_share).filter(F.col("p") >= 3).filter(F.log(rate_p / rate_q) > 0.4)
    return Words(np.array(sorted({r.word for r in found.select("word").collect()}), np.int64))


def fitted(documents: DataFrame, words: Words, text: str = "text", sample_documents: int = 4000, sample_lines: int = 200) -> Model:
    """The model fitted on a sample of the documents."""
    share = min(1.0, sample_documents / max(1, documents.count()))
    known = documents.sparkSession.sparkContext.broadcast(words)

    def make():
        def step(c):
            out: dict[str, list] = {"key": [], "lines": []}
            for _, some in chunks(c[text]):
                found = measure(some)
                v, _ = known.value.values(found)
                table = np.stack([v[f] for f in FEATURES], axis=1)
                begin, size = steps(found.doc)
                for b, n in zip(begin.tolist(), size.tolist()):
                    if n <= sample_lines:
                        out["key"].append(some[int(found.doc[b])][:64])
                        out["lines"].append(table[b : b + n].tobytes())
            return out

        return step

    chosen = documents.filter(F.pmod(F.xxhash64(F.lit(9), text), F.lit(1 << 20)) < int(share * (1 << 20))).select(text)
    rows = sorted(map_batches(chosen, make, "key string, lines binary").limit(2 * sample_documents).collect())
    tables = [np.frombuffer(r["lines"], np.uint8).reshape(-1, len(FEATURES)) for r in rows]
    doc = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    both = np.concatenate([*tables, np.zeros((0, len(FEATURES)), np.uint8)])
    given = [(k, x) for k, s in enumerate(STATES) for x in EXAMPLES.get(s, ())]
    examples, _ = Words(np.zeros(0, np.int64)).values(measure([x for _, x in given]))
    return fit(dict(zip(FEATURES, both.T)), doc, examples, np.array([k for k, _ in given]))


def labelled(texts: list[str], words: Words, model: Model) -> tuple[Lines, np.ndarray, np.ndarray]:
    """The lines of texts, the kind of each, and its common words."""
    found = measure(texts)
    v, hits = words.values(found)
    return found, KIND_OF[likeliest(model, model.scores(v), found.doc)], hits


def statistics(texts: list[str | None], words: Words, model: Model) -> dict[str, list]:
    """The statistics of texts, column by column."""
    columns: dict[str, list] = {n: [] for n in ("pieces", "words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", *KINDS, "kind")}
    for _, some in chunks(texts):
        found, kind, hits = labelled(some, words, model)
        n, s = len(some), found.stats
        pieces = np.stack([np.bincount(found.doc[kind == k], weights=found.pieces[kind == k], minlength=n) for k in range(4)], axis=1)
        total = pieces.sum(axis=1)

        def ratio(x: np.ndarray, y: np.ndarray) -> list:
            return [float(a) / float(b) if b else None for a, b in zip(x, y)]

        largest = 1 + pieces[:, 1:].argmax(axis=1)
        kinds = np.where(2 * pieces[:, 0] < total, largest, 0)
        columns["pieces"] += total.astype(int).tolist()
        columns["words"] += s["words"].tolist()
        columns["mean_word_length"] += ratio(s["letters"], s["words"])
        columns["symbol_ratio"] += ratio(s["signs"], s["chars"])
        columns["punctuated_lines"] += ratio(s["ended"], s["lines"])
        columns["common_words"] += ratio(np.bincount(found.doc, weights=hits, minlength=n), s["words"])
        for k, name in enumerate(KINDS):
            columns[name] += ratio(pieces[:, k], total)
        columns["kind"] += [KINDS[k] if t else None for k, t in zip(kinds.tolist(), total.tolist())]
    return columns


def text_quality(documents: DataFrame, key: str = "doc_id", text: str = "text", common_share: float = 0.0015, sample_documents: int = 4000) -> DataFrame:
    """The statistics, label shares and kind of every document."""
    words = common_words(documents, text, common_share)
    known = documents.sparkSession.sparkContext.broadcast((words, fitted(documents, words, text, sample_documents)))

    def make():
        words, model = known.value

        def step(c):
            return {key: c[key]} | statistics(c[text], words, model)

        return step

    kind = documents.schema[key].dataType.simpleString()
    return map_batches(documents.select(key, text), make, f"`{key}` {kind}, pieces long, words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, prose double, list double, table double, junk double, kind string")
