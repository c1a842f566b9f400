"""Problem 7: encoding a corpus with a public byte-level BPE tokenizer.

The text is cut into pieces by the tokenizer's pattern. A segment tree over the
byte positions of a piece holds, in each node, the smallest pair rank below it and
the leftmost position that has it (one integer: rank, then position). A merge reads
the root, joins the pair there and updates the leaves of the live neighbours, each
in logarithmic time, so a piece of n bytes costs O(n log n) whatever it holds.
Encoded pieces are remembered in a bounded dictionary per worker.

Defined cases: a null or empty text gives an empty list; the strings of special
tokens are ordinary text; text of any length is encoded whole. One narrow pass, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib

import regex
from pyspark.sql import DataFrame

from .common import map_batches

# Fixed value: the pattern that cuts texts into pieces, as the tokenizer defines it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NEVER = 1 << 60
REMEMBERED = 1 << 18


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line each, base64 of the bytes and the rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Encodes texts with ranked byte pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        size = 1
        while size < n:
            size *= 2
        shift = size.bit_length()
        mask = (1 << shift) - 1
        get = ranks.get
        part: list[bytes] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NEVER] * (2 * size)
        for i in range(n - 1):
            r = get(data[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for x in range(size - 1, 0, -1):
            a, b = tree[2 * x], tree[2 * x + 1]
            tree[x] = a if a < b else b

        def put(i: int, value: int) -> None:
            x = size + i
            tree[x] = value
            x >>= 1
            while x:
                a, b = tree[2 * x], tree[2 * x + 1]
                v = a if a < b else b
                if tree[x] == v:
                    break
                tree[x] = v
                x >>= 1

        while tree[1] < NEVER:
            i = tree[1] & mask
            j = after[i]
            part[i] += part[j]
            k = after[i] = after[j]
            put(j, NEVER)
            if k < n:
                before[k] = i
                r = get(part[i] + part[k])
                put(i, NEVER if r is None else r << shift | i)
            else:
                put(i, NEVER)
            h = before[i]
            if h >= 0:
                r = get(part[h] + part[i])
                put(h, NEVER if r is None else r << shift | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for p in self.pieces(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode())
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary file's bytes; one per worker process."""
    key = hashlib.md5(data).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(data))
    return _ENCODERS[key]


def encoded(df: DataFrame, key: str, text: str = "text", vocabulary: str = VOCABULARY, extra: tuple[str, ...] = (), sizes_only: bool = False) -> DataFrame:
    """(key, *extra, ids) of every row, or (key, *extra, tokens) with the number of ids.

    The vocabulary file (0.8 MB, fixed) is read on the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def make():
        enc = encoder(data.value)

        def step(c):
            ids = [enc.encode(t) for t in c[text]]
            return c | ({"tokens": [len(x) for x in ids]} if sizes_only else {"ids": ids})

        return step

    schema = ", ".join([f"`{x}` {kinds[x]}" for x in (key, *extra)] + ["tokens long" if sizes_only else "ids array<int>"])
    return map_batches(df.select(key, *extra, text), make, schema)
