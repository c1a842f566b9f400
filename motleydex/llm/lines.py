"""Statistics of the lines of many texts at once, in numpy.

A batch of texts is one array of code points. Tables give the classes of every code
point; running sums of the classes give counts for pieces (what stands between blanks), words
(runs of letters) and lines without a loop over any of them. Words and pieces are told by a
polynomial hash in 64 bits, without regard to case.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

TOP = 0x20000  # code points from here on are letters (ideographs) or, from 0xE0000, signs
SPACE, BREAK, LETTER, DIGIT, UPPER, VOWEL, CONSONANT, BROKEN, INNER, END, COMMA, QUOTE, LOWER = (1 << k for k in range(13))
BASE = 0x9E3779B97F4A7C15
# The statistics of a line by which the model tells states apart, and the number of values of each.
FEATURES = {"pieces": 9, "hits": 6, "common": 5, "signs": 5, "mash": 5, "links": 5, "broken": 5, "marker": 6, "end": 3, "cells": 4, "items": 5, "item_size": 5, "digits": 5, "key": 3, "distinct": 4, "capitals": 4, "piece_length": 6, "tight": 4, "first": 7}


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point below TOP: its classes, its lower case, and its script (a hash of the first word of its name)."""
    kind, low, script = np.zeros(TOP + 2, np.uint16), np.arange(TOP + 2, dtype=np.uint64), np.zeros(TOP + 2, np.int64)
    names: dict[str, int] = {}
    for i in range(TOP):
        ch = chr(i)
        c = unicodedata.category(ch)
        if c[0] in "LM" or i in (0x200C, 0x200D):
            kind[i] = LETTER | (UPPER if c == "Lu" else LOWER if c == "Ll" else 0)
            name = unicodedata.name(ch, "").partition(" ")[0]
            script[i] = names.setdefault(name, int.from_bytes(name.encode()[:6], "big"))
            lower = ch.lower()
            low[i] = ord(lower) if len(lower) == 1 else i
        elif c[0] == "N":
            kind[i] = DIGIT
        elif ch.isspace():
            kind[i] = SPACE
    groups = {
        "aeiouyAEIOUY": VOWEL,
        "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ": CONSONANT,
        ";:|~^<>{}\\": INNER,
        ".!?।॥…": END,
        ",;": COMMA,
        "\"'‘’“”)]": QUOTE,
        "\n\r\x0b\x0c\x85  ": BREAK | SPACE,
        # what text in UTF-8 becomes when it is read in another encoding
        "".join(map(chr, (*range(0xA2, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))) + "�﻿€™ŒœŠšŸŽžƒˆ‘’‚“”„†‡‰‹›": BROKEN,
    }
    for chars, bit in groups.items():
        for ch in chars:
            kind[ord(ch)] |= bit
    kind[TOP] = LETTER
    return kind, low, script


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))


def _room(n: int) -> int:
    return 1 << max(18, (n + 1).bit_length())


def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values begin and end."""
    edge = np.diff(np.r_[False, on, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sums(x: np.ndarray) -> np.ndarray:
    """Running sums with a zero in front: the sum from a to b is s[b] - s[a]."""
    return np.r_[0, np.cumsum(x, dtype=np.int64)]


def bins(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    """How many of the edges each value reaches."""
    out = np.zeros(len(x), np.uint8)
    for e in edges:
        out += x >= e
    return out


@dataclass
class Lines:
    """The lines that are not blank, in order. Arrays of one entry a line unless stated."""

    doc: np.ndarray
    pieces: np.ndarray
    word_line: np.ndarray  # a word: its line
    word_hash: np.ndarray  # a word: its hash
    word_script: np.ndarray  # a word: the script of its first letter
    values: dict[str, np.ndarray]  # statistics that do not depend on common words
    stats: dict[str, np.ndarray]  # a document: letters, signs and so on


def chunks(texts: list[str | None], most: int = 1 << 17) -> Iterator[tuple[int, list[str]]]:
    """Slices of a list of texts of at most ``most`` characters (a longer text alone), each with its place."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield at, held


def measure(texts: list[str]) -> Lines:
    """The statistics of all lines of the texts."""
    kind, low, script = tables()
    cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    at = np.minimum(cp, TOP) + (cp >= 0xE0000)
    f = kind[at]
    is_ = lambda bit: (f & bit) != 0
    n = len(cp)
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    space, letter, digit = is_(SPACE), is_(LETTER), is_(DIGIT)
    before, after = np.r_[np.uint16(SPACE), f[:-1]], np.r_[f[1:], np.uint16(SPACE)]

    ps, pe = runs(~space)
    line_no = sums(is_(BREAK))
    pl = line_no[ps]
    new = np.r_[True, pl[1:] != pl[:-1]] if len(ps) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    count = np.diff(np.r_[first, len(ps)])
    doc = np.searchsorted(begin, ps[first], "right") - 1
    last = first + count - 1

    def per_piece(x: np.ndarray) -> np.ndarray:
        s = np.cumsum(x, dtype=np.int32)
        return s[pe - 1] - s[ps] + x[ps]

    def per_line(x: np.ndarray) -> np.ndarray:
        s = sums(x)
        return s[last + 1] - s[first]

    def rare(x: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(ps, np.flatnonzero(x), "right") - 1, minlength=len(ps))

    size = pe - ps
    letters, digits = per_piece(letter), rare(digit)
    cons = is_(CONSONANT)
    vowels, consonants = per_piece(is_(VOWEL)), per_piece(cons)
    upper = is_(UPPER)
    uppers = rare(upper)
    between = ((before & after) & LETTER) != 0
    inner = rare(between & is_(INNER))
    mixed = rare(digit & ((before & LETTER) != 0) & ((after & (LETTER | DIGIT)) != 0))
    camel = rare(upper & ((before & LOWER) != 0))
    five, same = np.zeros(n, bool), np.zeros(n, bool)
    if n > 5:
        five[:-4] = cons[:-4] & cons[1:-3] & cons[2:-2] & cons[3:-1] & cons[4:]
        same[:-3] = (letter[:-3]) & (cp[:-3] == cp[1:-2]) & (cp[1:-2] == cp[2:-1]) & (cp[2:-1] == cp[3:])
    hard = rare(five | same)
    signs = (letters == 0) & (digits == 0)
    slashes = rare((cp == 58) & (np.r_[cp[1:], 0] == 47) & (np.r_[cp[2:], 0, 0] == 47))
    a, z = cp[ps], cp[pe - 1]
    dots = rare(between & (cp == 46))
    ats = rare((cp == 64) & ((before & (LETTER | DIGIT)) != 0))
    tag = ((a == 35) | (a == 64)) & (size > 1) & (letters > 0)
    link = (slashes > 0) | ((dots >= 1) & (size >= 9)) | ((ats > 0) & (dots > 0)) | tag
    ascii_only = (vowels + consonants == letters) & (letters > 0)
    mash = ascii_only & ((inner > 0) | ((size >= 5) & (mixed > 0)) | ((letters >= 4) & (5 * vowels < letters)) | (hard > 0) | ((letters >= 4) & (camel > 0) & (uppers > 1)) | (size > 40)) & ~link
    broken_chars = rare(is_(BROKEN))
    broken = (2 * broken_chars >= np.minimum(4, size)) & (broken_chars > 0)

    # the mark at the start of a line
    fa, fz, fs, fl, fd = a[first], z[first], size[first], letters[first], digits[first]
    more = count > 1
    closes = np.isin(fz, (46, 41, 58))
    marker = np.zeros(len(first), np.uint8)
    marker[more & (fl == 0) & (fd == 0) & (fs == 1) & (fa != 34) & (fa != 124)] = 1
    marker[(fl > 0) & (fa > 127) & ~np.isin(kind[np.minimum(fa, TOP)] & (LETTER | DIGIT), (LETTER, DIGIT)) & ((kind[np.minimum(fa, TOP)] & (BROKEN | QUOTE)) == 0)] = 1
    marker[more & (fd > 0) & (fl == 0) & (closes & (fs <= 6))] = 2
    marker[more & (fl > 0) & (fl <= 2) & (fd == 0) & (fs <= 4) & np.isin(fz, (46, 41))] = 3
    marker[((fs == 3) & (fa == 91) & (fz == 93)) | (more & (fs == 1) & (fa == 91))] = 4
    marker[more & (fa == 35) & (fd > 0) & (fl == 0)] = 5
    marked = marker > 0
    bare = np.maximum(1, count - marked)

    def share(x: np.ndarray) -> np.ndarray:
        return (per_line(x) - (x[first] & marked)) / bare

    not_linked = per_line(link) == 0
    s0, s1 = ps[first], pe[last]

    def inside(x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(x)
        where = np.searchsorted(s0, at, "right") - 1
        where = where[(where >= 0) & (at < s1[where])] if len(s0) else at[:0]
        return np.bincount(where, minlength=len(first))

    tabs, comma = inside(cp == 9), is_(COMMA)
    quoted = inside(comma & (((before & after) & QUOTE) != 0))
    equal = inside((cp == 61) & ((before & (LETTER | DIGIT)) != 0) & ((after & SPACE) == 0))
    bars = per_line((size == 1) & (a == 124))
    gap = np.r_[0, ps[1:] - pe[:-1]] * ~new
    gaps = per_line(gap >= 2)
    many = lambda x: np.where(x >= 2, x, 0)
    cells = np.maximum.reduce([tabs, many(bars), quoted, many(equal * not_linked), many(gaps)])
    tight = inside(comma & ((before & SPACE) == 0) & ((after & SPACE) == 0))
    slashed = inside((cp == 47) & between)
    loose = per_line(((kind[np.minimum(z, TOP)] & COMMA) != 0) & (size > 1)) + per_line(signs & (size == 1)) - (signs[first] & (size[first] == 1))
    items = loose + tight + np.where(not_linked, slashed, 0)
    colon = (z == 58) & (letters > 0)
    early = np.zeros(len(first), bool)
    for k in (1, 2, 3):
        there = count > k
        early[there] |= colon[first[there] + k]
    key = np.where(colon[first], 1, np.where(early, 2, 0)).astype(np.uint8)
    zl = z[last]
    kz = kind[np.minimum(zl, TOP)]
    quoted_end = ((kz & QUOTE) != 0) & (size[last] > 1) & ((kind[np.minimum(cp[pe[last] - 2], TOP)] & END) != 0)
    end = np.where(((kz & END) != 0) | quoted_end, 1, np.where((kz & (COMMA | INNER)) != 0, 2, 0)).astype(np.uint8)
    # the first sign of what follows the mark
    fa = np.where(marked & more, a[np.minimum(first + 1, len(a) - 1)] if len(a) else 0, fa)
    k1 = kind[np.minimum(fa, TOP)]
    opening = np.select([(k1 & UPPER) != 0, (k1 & LOWER) != 0, (k1 & LETTER) != 0, (k1 & DIGIT) != 0, np.isin(fa, (40, 91)), (k1 & QUOTE) != 0], [0, 1, 2, 3, 4, 5], 6).astype(np.uint8)

    power, inverse = (p[: n + 1] for p in powers(_room(n)))
    with np.errstate(over="ignore"):
        running = np.r_[np.uint64(0), np.cumsum((low[at] + np.uint64(1)) * power[:n], dtype=np.uint64)]

        def hashed(s: np.ndarray, e: np.ndarray) -> np.ndarray:
            h = (running[e] - running[s]) * inverse[s]
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

        ph = hashed(ps, pe)
        ws, we = runs(letter)
        wh = hashed(ws, we)
    key_of = np.sort(line << 40 | (ph & ((1 << 40) - 1)))  # a line's different pieces stand apart
    distinct = np.bincount((key_of >> 40)[np.r_[True, key_of[1:] != key_of[:-1]]], minlength=len(first)) if len(ph) else count
    word_line = np.searchsorted(ps[first], ws, "right") - 1
    length = per_line(size) / count

    parts = (0.001, 0.15, 0.4, 0.75)
    values = {
        "pieces": bins(count, (2, 3, 4, 5, 6, 8, 12, 21)),
        "signs": bins(share(signs & ~broken), parts),
        "mash": bins(share(mash), parts),
        "links": bins(share(link), parts),
        "broken": bins(share(broken), parts),
        "marker": marker,
        "end": end,
        "cells": bins(cells, (1, 2, 3)),
        "items": bins(items, (1, 2, 3, 5)),
        "item_size": bins(bare / (items + 1), (1.51, 2.51, 3.61, 6.01)),
        "digits": bins(share(digits > 0), (0.001, 0.2, 0.5, 0.95)),
        "key": key,
        "distinct": bins(distinct / np.minimum(count, 16), (0.5, 0.8, 0.95)),
        "capitals": bins(per_line((letters >= 2) & (uppers == letters)) / count, (0.001, 0.3, 0.7)),
        "piece_length": bins(length, (2, 3, 4.5, 8, 15)),
        "tight": bins(tight, (1, 2, 3)),
        "first": opening,
    }
    piece_doc = doc[line]
    by_doc = lambda x: np.bincount(piece_doc, weights=x, minlength=len(texts)).astype(np.int64)
    in_words = np.bincount(np.searchsorted(begin, ws, "right") - 1, minlength=len(texts)) if len(ws) else np.zeros(len(texts), np.int64)
    stats = {"chars": by_doc(size), "letters": by_doc(letters), "signs": by_doc(size - letters - digits), "words": in_words, "lines": np.bincount(doc, minlength=len(texts)), "ended": np.bincount(doc, weights=end == 1, minlength=len(texts))}
    return Lines(doc, count, word_line, wh, script[at[ws]], values, stats)
