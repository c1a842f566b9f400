"""Problem 4: the most similar vectors of every vector, by a forest of hash prefixes.

A vector has a long hash string in every tree: signs of random projections, then the
digits of one projection. A tree is the array of its vectors sorted by that string. Trees
come in two levels, because the arrays lie on many machines: ``trees`` upper strings order all vectors
and cut them into runs of at most ``run_rows`` neighbours in that order (range partitioning), and
inside a run ``branches`` further strings each give a sorted array of it.

In a run every vector descends in all branches to its longest matching prefix, told by the
lengths of the common prefixes of neighbours in the sorted arrays. Then all branches ascend together, one
bit of prefix length at a time, until the vectors that share a prefix of that length with it in some branch number
``candidates`` in all; each vector stops at a length of its own. Cosines with them are computed as products of
blocks of the sorted array, from vectors held as 16-bit fractions (error of a cosine about 1e-5). Of a prefix
shared by more vectors than ``candidates`` those nearest in the array are taken; the digits at the
end of the string order even vectors that share all signs differently in each branch.

The upper strings are probed in ``cells`` places: a vector also stands where the string leads with its least certain bit
flipped, which costs as much as a tree and finds more. Runs of one task overlap by an eighth.
``forest_plan`` chooses the length of runs, the branches and the trees for a number of vectors, so that a pair with a
cosine of 0.88 is found with a probability of 0.97 at least: it counts the pairs parted by ends of runs as well as those
not met inside a run. Cost is linear in the number of vectors for a fixed forest. Vectors with the same
16-bit form are one class, told by a 128-bit hash; only the member with the smallest id enters the
forest. A class is among the k best of another only if its smallest member is, so the k best classes, each
with its k smallest ids, and the k + 1 smallest ids of the own class hold the k best rows of every
member, ties included; a group of copies costs k rows a member however large it is.

Defined cases: vectors that are null, of another length, zero or not finite, and
rows without id, are left out; of several rows of an id the latest counts (null is
the oldest); ties between neighbours go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import persist_table
from .common import age, newest

SCALE = 32767.0
SIGNS, DIGITS = 42, 20  # the parts of a branch's string
UPPER = 44  # bits of an upper string


def unit(batch: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a list array: the rows that are usable, and their unit vectors."""
    batch = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    n = len(batch)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dim)
    if not len(fits):
        return fits, np.zeros((0, dim))
    some = batch.take(pa.array(fits))
    v = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dim)
    top = np.abs(v).max(axis=1)
    ok = np.isfinite(v).all(axis=1) & (top > 0)
    v = v[ok] / top[ok, None]
    return fits[ok], v / np.linalg.norm(v, axis=1, keepdims=True)


def projections(seed: int | list[int], dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits))


def upper_strings(v: np.ndarray, seed: int, bits: int, cells: int, deciding: int) -> np.ndarray:
    """(rows, cells) strings of ``bits`` sign bits; in each further cell the next least certain of the first ``deciding`` bits is flipped."""
    p = v @ projections(seed, v.shape[1], bits)
    one = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    own = (p > 0) @ one
    weakest = np.argsort(np.abs(p[:, :deciding]), axis=1)
    return np.stack([own, *(own ^ one[weakest[:, c]] for c in range(cells - 1))], axis=1)


def branch_strings(v: np.ndarray, seed: int, branch: int) -> np.ndarray:
    """The strings of one branch as integers: SIGNS sign bits, then DIGITS binary digits of the first projection."""
    r = projections([seed, branch], v.shape[1], SIGNS).astype(np.float32)
    out = np.empty(len(v), np.int64)
    for lo in range(0, len(v), 1 << 13):
        p = v[lo : lo + (1 << 13)] @ r
        packed = np.zeros((len(p), 8), np.uint8)
        packed[:, : -(-SIGNS // 8)] = np.packbits(p > 0, axis=1)
        signs = packed.view(">u8")[:, 0].astype(np.uint64) >> np.uint64(64 - SIGNS)
        digits = ((p[:, 0] / 8 + 0.5).clip(0, 1) * ((1 << DIGITS) - 1)).astype(np.uint64)
        out[lo : lo + (1 << 13)] = (signs << np.uint64(DIGITS) | digits).view(np.int64)
    return out


def common_prefix(s: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the length of the prefix shared with the place before; -1 at the first."""
    apart = np.frexp((s[1:] ^ s[:-1]).astype(np.float64))[1]
    return np.r_[-1, SIGNS + DIGITS - apart].astype(np.int8)


def ascend(orders: np.ndarray, shared: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of candidates (from, to) of each place of each branch's sorted array.

    ``orders[b]`` are the vectors in the order of branch b, ``shared[b]`` what common_prefix() gives for it. From the longest
    prefixes up, a vector stops at the first length at which the groups that it belongs to hold ``candidates`` others.
    """
    branches, n = orders.shape
    start, end = np.zeros((branches, n), np.int32), np.full((branches, n), n, np.int32)
    todo = np.ones(n, bool)
    for length in range(int(shared.max(initial=0)), -1, -1):
        edges = [np.append(np.flatnonzero(shared[b] < length), n).astype(np.int32) for b in range(branches)]
        sizes = [np.diff(e) for e in edges]
        if sum(int(z.max(initial=1)) - 1 for z in sizes) < candidates:
            continue  # no vector can stop here yet
        met = np.full(n, -branches, np.int64)
        for b in range(branches):
            met[orders[b]] += np.repeat(sizes[b], sizes[b])
        stop = todo & (met >= candidates)
        if stop.any():
            for b in range(branches):
                at = np.flatnonzero(stop[orders[b]])
                start[b, at] = np.repeat(edges[b][:-1], sizes[b])[at]
                end[b, at] = np.repeat(edges[b][1:], sizes[b])[at]
            todo &= ~stop
            if not todo.any():
                break
    return start, end


def run_pairs(v: np.ndarray, seed: int, branches: int, candidates: int, least: float, block: int = 96) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In one run: the pairs (i, j, cosine) that met in a branch with a cosine of at least ``least``, i < j, each once."""
    n = len(v)
    orders, shared = np.empty((branches, n), np.int32), np.empty((branches, n), np.int8)
    for b in range(branches):
        s = branch_strings(v, seed, b)
        orders[b] = np.argsort(s)
        shared[b] = common_prefix(s[orders[b]])
    start, end = ascend(orders, shared, candidates)
    here = np.arange(n, dtype=np.int32)
    met = [np.zeros(0, np.int64)]
    s = np.empty_like(v)
    eight = np.arange(8)
    for b in range(branches):
        order = orders[b]
        np.take(v, order, axis=0, out=s)
        # how far right a place looks: its own range, and the places whose ranges begin at it or before
        far = np.minimum(end[b], here + candidates + 1)
        np.maximum.at(far, np.maximum(start[b], here - candidates), here + 1)
        far = np.maximum.accumulate(far)
        for lo in range(0, n, block):
            rows = min(block, n - lo)
            wide = int(far[lo + rows - 1]) - lo
            hit = np.zeros(-(-rows * wide // 8) * 8, bool)
            np.greater_equal((s[lo : lo + rows] @ s[lo : lo + wide].T).ravel(), least, out=hit[: rows * wide])
            hit[: rows * (wide + 1) : wide + 1] = False  # each place meets itself
            words = np.flatnonzero(hit.view(np.uint64))  # eight at a time: hits are rare
            if len(words):
                at = (words[:, None] * 8 + eight)[hit.reshape(-1, 8)[words]]
                x, y = np.divmod(at, wide)
                i, j = order[lo + x[y > x]].astype(np.int64), order[lo + y[y > x]].astype(np.int64)
                met.append(np.minimum(i, j) * n + np.maximum(i, j))
    code = np.unique(np.concatenate(met))
    i, j = code // max(1, n), code % max(1, n)
    return i, j, np.einsum("ij,ij->i", v[i].astype(np.float64), v[j].astype(np.float64))


def best(i: np.ndarray, j: np.ndarray, cos: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best partners of each end of the pairs; cosines that agree in five digits are ties."""
    a, b, c = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cos, cos])
    order = np.lexsort((ids[b], -np.round(c, 5), a)) if len(a) else np.zeros(0, np.int64)
    a, b, c = a[order], b[order], c[order]
    start = np.searchsorted(a, a, side="left")
    keep = np.arange(len(a)) - start < k
    return a[keep], b[keep], c[keep]


def meeting(cosine: float, deciding: int, cells: int, pairs: int = 20_000) -> float:
    """The chance that two vectors stand in a common cell of a tree told apart by ``deciding`` bits, from simulated projections."""
    if not deciding:
        return 1.0
    rng = np.random.default_rng(3)
    x = rng.standard_normal((pairs, deciding))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.standard_normal((pairs, deciding))
    cells = min(cells, deciding + 1)

    def places(p: np.ndarray) -> np.ndarray:
        one = 1 << np.arange(deciding, dtype=np.int64)
        weakest = np.argsort(np.abs(p), axis=1)
        own = (p > 0) @ one
        return np.stack([own, *(own ^ one[weakest[:, c]] for c in range(cells - 1))], axis=1)

    return float((places(x)[:, :, None] == places(y)[:, None, :]).any(axis=(1, 2)).mean())


def forest_plan(rows: int, cells: int = 2, cosine: float = 0.88, recall: float = 0.97, candidates: int = 170) -> tuple[int, int, int, int, int]:
    """(rows of a run, trees, deciding bits, branches, candidates) for a number of vectors of one aspect.

    A run is a quarter of the vectors, from 2,048 up to 393,216 (101 MB of floats in a task). The branches are as many as find a pair
    inside a run with a probability of 0.95: with c candidates a branch, two vectors must share a prefix of log2(run / c) bits in one.
    Trees, three or more, are as many as find it in all with the probability ``recall``, counting pairs parted by the ends of runs.
    Such ends tell bits apart that are not whole in number; their chance is taken between those of the two whole numbers.
    """
    run = min(393_216, max(2048, rows // 4))
    same_bit = 1 - math.acos(cosine) / math.pi
    branch = same_bit ** math.log2(run / candidates)
    branches = max(11, math.ceil(math.log(0.05) / math.log(1 - branch)))
    inside = 1 - (1 - branch) ** branches
    bits = max(0.0, math.log2(max(1, rows) * cells / run))
    deciding = math.ceil(bits)
    found = inside * (meeting(cosine, deciding, cells) * (1 - deciding + bits) + meeting(cosine, math.floor(bits), cells) * (deciding - bits))
    return run, max(3, math.ceil(math.log(1 - recall) / math.log(1 - found))), deciding, branches, candidates * branches


def similar_vectors(vectors: DataFrame, k: int = 5, least: float = 0.85, dim: int = 64, cells: int = 2, seed: int = 11, run_rows: int | None = None, trees: int | None = None, branches: int | None = None, candidates: int | None = None, most_tasks: int = 100_000) -> DataFrame:
    """(aspect, id, neighbour, cosine, rank): up to k most similar vectors of every vector, of at least ``least``.

    ``vectors`` has ``aspect, meme_id, embedding, created_at``; there are few aspects, kinds of vectors. The forest follows from their number
    unless given. A task takes about one run, or several one after another where there are more than ``most_tasks``.
    """
    sizes = {r["aspect"]: r["count"] for r in vectors.groupBy("aspect").count().collect()}  # a row per aspect
    largest = max(sizes.values(), default=0)
    planned = forest_plan(largest, cells)
    run_rows, trees, branches, candidates = run_rows or planned[0], trees or planned[1], branches or planned[3], candidates or planned[4]
    deciding = max(0, math.ceil(math.log2(max(1, largest) * cells / run_rows)))
    cells = min(cells, deciding + 1)
    number = {a: n for n, a in enumerate(sorted(sizes, key=lambda a: (a is not None, a)))}
    # ranges are cut by a sample, so they are planned a fifth shorter than a run
    tasks = min(max(1, -(-sum(sizes.values()) * trees * cells * 5 // (run_rows * 4))), most_tasks)
    overlap = run_rows // 8

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = unit(b.column("embedding"), dim)
            q = np.rint(v * SCALE).astype("<i2")
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("aspect").take(take), b.column("meme_id").take(take), b.column("stamp").take(take), pa.array([r.tobytes() for r in q], pa.binary())], ["aspect", "meme_id", "stamp", "v"])

    packed = vectors.filter("meme_id is not null").select("aspect", "meme_id", age("created_at").alias("stamp"), "embedding").mapInArrow(pack, "aspect string, meme_id string, stamp timestamp_ntz, v binary")
    packed = packed.withColumns({"x": F.xxhash64("v"), "y": F.xxhash64(F.lit(1), "v")})
    # copies: (aspect, meme_id, rep) of all members of classes of several; only hashes are moved to find them
    hashed = newest(packed.drop("v"), ["aspect", "meme_id"], "stamp", ["x", "y"])
    shared = hashed.groupBy("aspect", "x", "y").agg(F.min("meme_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = persist_table(hashed.join(shared, ["aspect", "x", "y"]).select("aspect", "meme_id", "rep"), "copies")
    live = newest(packed, ["aspect", "meme_id"], "stamp", ["x", "y", "v"]).drop("x", "y")  # of equal stamps the same row as above
    alone = live.join(copies.filter("meme_id <> rep"), ["aspect", "meme_id"], "left_anti")

    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.frombuffer(b"".join(b.column("v").to_pylist()), "<i2").reshape(-1, dim).astype(np.float64)
            at = np.array([number[a] for a in b.column("aspect").to_pylist()], np.int64)
            for t in range(trees):
                strings = upper_strings(v, seed + t, UPPER, cells, max(1, deciding))
                for c in range(cells):
                    yield pa.RecordBatch.from_arrays([pa.array((at * trees + t) << UPPER | strings[:, c]), b.column("meme_id"), b.column("v")], ["place", "meme_id", "v"])

    # a place is the array's number (aspect and tree), then the string: one number to cut and to sort by
    forest = alone.mapInArrow(strung, "place long, meme_id string, v binary").repartitionByRange(tasks, "place").sortWithinPartitions("place")
    aspects = list(number)

    def of_run(array: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids = np.array(t.column("meme_id").to_pylist(), dtype=object)
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), "<i2").reshape(-1, dim).astype(np.float32)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        i, j, cos = run_pairs(v, seed + 1000 + array % trees, branches, candidates, least - 1e-4)
        ok = (cos >= least - 2e-6) & (ids[i] != ids[j])  # a vector may stand in both of its cells
        a, b, c = best(i[ok], j[ok], cos[ok], ids, k)
        return pa.RecordBatch.from_arrays([pa.array([aspects[array // trees]] * len(a), pa.string()), pa.array(ids[a], pa.string()), pa.array(ids[b], pa.string()), pa.array(c, pa.float64())], ["aspect", "id", "neighbour", "cosine"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        array, rows, fresh = -1, 0, 0  # the array of what is held, its rows, and those among them that no run has seen
        for b in batches:
            arrays = b.column("place").to_numpy() >> UPPER
            lo = 0
            while lo < len(arrays):
                if arrays[lo] != array:
                    if fresh:
                        yield of_run(array, held)
                    held, array, rows, fresh = [], int(arrays[lo]), 0, 0
                hi = min(int(np.searchsorted(arrays, array, "right")), lo + run_rows - rows)
                held.append(b.slice(lo, hi - lo))
                rows, fresh, lo = rows + hi - lo, fresh + hi - lo, hi
                if rows == run_rows:
                    yield of_run(array, held)
                    last = pa.Table.from_batches(held).slice(rows - overlap).to_batches()
                    held, rows, fresh = last, overlap, 0
        if fresh:
            yield of_run(array, held)

    met = forest.mapInArrow(meet, "aspect string, id string, neighbour string, cosine double")
    # one exchange on (aspect, id) serves the removal of repeats and the ranking
    once = met.repartition("aspect", "id").groupBy("aspect", "id", "neighbour").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("aspect", "id").orderBy(F.desc(F.round("cosine", 5)), "neighbour")
    near = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
    # from classes to members: the first ids of a class stand for it as a neighbour, then each member leaves itself out
    order = Window.partitionBy("aspect", "rep").orderBy("meme_id")
    first = copies.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("aspect", "rep").agg(F.array_sort(F.collect_list("meme_id")).alias("ids"))
    others = near.join(first.select("aspect", F.col("rep").alias("neighbour"), "ids"), ["aspect", "neighbour"], "left")
    others = others.select("aspect", "id", "cosine", F.explode(F.slice(F.coalesce("ids", F.array("neighbour")), 1, k)).alias("neighbour"))
    own = first.select("aspect", F.col("rep").alias("id"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("cosine", 5)).alias("key"), "neighbour", "cosine")))
    lists = others.unionByName(own).groupBy("aspect", "id").agg(F.slice(ranked, 1, k + 1).alias("best"))
    members = lists.join(copies.select("aspect", F.col("rep").alias("id"), "meme_id"), ["aspect", "id"], "left").select("aspect", F.coalesce("meme_id", "id").alias("id"), "best")
    kept = members.select("aspect", "id", F.posexplode(F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("pos", "b"))
    return kept.select("aspect", "id", "b.neighbour", "b.cosine", (F.col("pos") + 1).alias("rank"))


def similar_pairs(vectors: DataFrame, **options) -> DataFrame:
    """(aspect, id_a, id_b): pairs of which one is among the k most similar of the other; each once, smaller id first."""
    near = similar_vectors(vectors, **options)
    return near.select("aspect", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
