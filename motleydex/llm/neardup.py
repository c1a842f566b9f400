"""Problem 1: near-duplicate records by a parity-sketch join.

A record is the set of its words, each hashed to 32 bits (two different words of a pair of
records with a hundred words each get the same hash once in a million pairs). XOR-ing one bit per word
into a sketch gives parities: words in both of two sets cancel, so the Hamming
distance of two sketches never exceeds the size d of the sets' symmetric
difference. A similarity above t bounds d by (1 - t) / (1 + t) * (n_a + n_b).

Candidates come from a pigeonhole join. Within a band of sizes (half an octave) the
words are thrown into m buckets, whose XOR of full hashes is the bucket's part of the
sketch; a bucket without differing words is the same in both records. One partition into more than d buckets
would leave one untouched for certain but is useless here:
with two or three words each, buckets of common words would join everything. So
buckets hold about ``words_per_bucket`` words, and independent partitions follow until
a pair at the very threshold is missed with probability ``miss`` at most in the
middle of a band: a bucket stays untouched with probability (1 - 1/m)^d. Closer pairs are all but
never missed (at 0.75 about one in a thousand). A set takes part in its own band and in the lower ones
in which a smaller partner could stand. Candidates must pass the size bound and the Hamming
bound on a 96-bit sketch carried along, then the exact similarity on the word sets.

A bucket that more than ``most`` classes share (the words of a popular template) is not joined pairwise but refined, without loss:
its members meet only where they also share one of their rarest words. Of n words the n - floor(t * n) rarest, in one order for
all, must have a word in common if two sets are to be more similar than t (a prefix filter). So the work in a hot bucket follows from its rare words.

Records with the same set of words are one class, merged before signatures are
made, so a group of copies costs one row of signatures however large it is. One exchange on the signature serves
counting and both sides of the sort-merge join (skewed keys are split by adaptive execution); buckets are never collected.

Defined cases: null or unreadable fields count as empty; a record without words
has no partners; repeated rows and older versions of an id count once (latest
``labeled_at``, null is the oldest); rows with a null id are left out; an empty
table gives no pairs.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import persist_table
from .common import age, map_batches, newest, original
from .unify import skeleton

THRESHOLD = 0.67


@lru_cache(65536)
def _ends(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "P" or ch in "$+<=>^`|~"


def words(text: str) -> set[str]:
    """The distinct words of a text in their comparable form, without punctuation at the ends."""
    out = set()
    for w in skeleton(text).replace("|", " ").split():
        i, j = 0, len(w)
        while i < j and _ends(w[i]):
            i += 1
        while j > i and _ends(w[j - 1]):
            j -= 1
        if i < j:
            out.add(w[i:j])
    return out


def word_sets(memes: DataFrame) -> DataFrame:
    """(id, words): the sorted word hashes of each live record."""

    def make():
        known: dict[str, int] = {}

        def number(w: str) -> int:
            h = known.get(w)
            if h is None:
                if len(known) >= 1 << 18:
                    known.clear()
                h = known[w] = (xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF) - (1 << 31)
            return h

        def step(c):
            sets = [sorted(map(number, words(" ".join((original(a), o or "", d or ""))))) for a, o, d in zip(c["caption"], c["ocr_text"], c["image_description"])]
            return {"id": c["id"], "stamp": c["stamp"], "words": sets}

        return step

    rows = map_batches(memes.filter("id is not null").select("id", age().alias("stamp"), "caption", "ocr_text", "image_description"), make, "id string, stamp timestamp_ntz, words array<int>")
    return newest(rows, ["id"], "stamp", ["words"]).filter(F.size("words") > 0)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A multiply-shift hash to 64 bits; a different one for each salt."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _xor_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the XOR of their values and their counts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[start], np.bitwise_xor.reduceat(values[order], start), np.diff(np.r_[start, len(k)])


def sketches(h: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 64 and the last 32 bits of the parity sketch of each record; rec ascends and each record has a word."""
    at = _mix(h, 999) % np.uint64(96)
    start = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
    bit = np.uint64(1) << (at & np.uint64(63))
    low = np.bitwise_xor.reduceat(np.where(at < 64, bit, np.uint64(0)), start)
    high = np.bitwise_xor.reduceat(np.where(at >= 64, bit, np.uint64(0)), start)
    return low.view(np.int64), high.astype(np.uint32).view(np.int32)


def bucket_plan(rows: int, threshold: float = THRESHOLD, miss: float = 0.03) -> tuple[float, int]:
    """(words per bucket, signatures) for a number of records.

    A bucket has 5.7 words: unrelated records meet by chance about 18 times each in 100,000 records, and in proportion. From 20 million records, some
    4,000 meetings each, every factor e adds 0.64 words, which keeps that number (unrelated records differ in about 1.6 of their words per word of a
    bucket). Signatures follow from the chance that a pair at the threshold leaves a bucket untouched.
    """
    words_per_bucket = 5.7 + 0.64 * max(0.0, math.log(max(1, rows) / 20_000_000))
    untouched = math.exp(-words_per_bucket * 2 * (1 - threshold) / (1 + threshold))
    return words_per_bucket, math.ceil(math.log(miss) / math.log(1 - untouched))


def bands(n: np.ndarray) -> np.ndarray:
    """The band of each size: half octaves from 1."""
    return np.floor(2 * np.log2(np.maximum(1, n)) + 1e-9).astype(np.int64)


def band_signatures(h: np.ndarray, rec: np.ndarray, band: int, words_per_bucket: float, signatures: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, signature) of every bucket of one size band; rec ascends.

    A bucket with fewer than half the usual words also takes in the next one.
    """
    m = max(2, round(2 ** (band / 2 + 0.25) / words_per_bucket))
    recs, sigs = [], []
    for part in range(max(1, -(-signatures // m))):
        bucket = (_mix(h, 100 * band + part) % np.uint64(m)).astype(np.int64)
        keys, x, count = _xor_by(rec * m + bucket, _mix(h, 7))
        r, b = keys // m, keys % m
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        following = np.arange(1, len(r) + 1)
        following[np.r_[first[1:] - 1, len(r) - 1].astype(np.int64)] = first  # the last bucket of a record is followed by its first
        thin = count < words_per_bucket / 2
        x = np.where(thin, x ^ _mix(x[following], 3), x)
        keep = b < signatures - part * m
        recs.append(r[keep])
        place = (b[keep].astype(np.uint64) * np.uint64(2) + thin[keep].astype(np.uint64)) * np.uint64(4096) + np.uint64(part)
        sigs.append((_mix(_mix(x[keep], 1 + band) ^ place, 11) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(recs), np.concatenate(sigs)


def signed(classes: DataFrame, words_per_bucket: float, signatures: int, threshold: float = THRESHOLD) -> DataFrame:
    """Adds to (cls, words) the sketch and the signatures of the set's size bands, 32 bits each.

    ``rest`` packs the last 32 bits of the sketch and the set's size, 31 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column("words")
            n = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = col.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
            rec = np.repeat(np.arange(len(n)), n)
            low, high = sketches(h, rec)
            top, bottom = bands(n), bands(np.floor(n * threshold))
            recs, sigs = [], []
            for band in range(int(bottom.min()), int(top.max()) + 1):
                here = ((bottom <= band) & (band <= top))[rec]
                if here.any():
                    r, s = band_signatures(h[here], rec[here], band, words_per_bucket, signatures)
                    recs.append(r)
                    sigs.append(s)
            r, s = np.concatenate(recs), np.concatenate(sigs).view(np.int32)
            order = np.argsort(r, kind="stable")
            offsets = np.r_[0, np.cumsum(np.bincount(r, minlength=len(n)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("cls"), col, pa.ListArray.from_arrays(offsets, pa.array(s[order])), pa.array(low), pa.array(high.view(np.uint32).astype(np.int64) << 31 | n)], ["cls", "words", "sigs", "low", "rest"])

    return classes.select("cls", "words").mapInArrow(run, "cls long, words array<int>, sigs array<int>, low long, rest long")


def rarest_words(classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, word): of each class the rarest words of which it must share one with any set more similar than the threshold."""
    each = classes.select("cls", F.size("words").alias("n"), F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    lists = each.join(often, "word").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("ranked"))
    first = F.slice("ranked", 1, (F.col("n") - F.floor(F.col("n") * threshold)).cast("int"))
    return lists.select("cls", F.explode(first).alias("w")).select("cls", "w.word")


def class_pairs(classes: DataFrame, threshold: float = THRESHOLD, most: int = 2000, tasks: int | None = None) -> DataFrame:
    """(cls_a, cls_b): pairs of classes whose word sets have a Jaccard similarity above ``threshold``.

    ``classes`` is a stored table of signed(); ``tasks`` defaults to the session's number of shuffle partitions.
    """
    tasks = tasks or int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select(F.explode("sigs").alias("sig"), "cls", "low", "rest").repartition(tasks, "sig")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("sig")))
    usual, hot = rows.filter(F.col("n") <= most).drop("n"), rows.filter(F.col("n") > most).drop("n")

    def met(side: DataFrame, keys: list[str]) -> DataFrame:
        a, b = (side.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "low", "rest")]) for x in "ab")
        n_a, n_b = (F.col(f"rest_{x}").bitwiseAND(F.lit(2**31 - 1)) for x in "ab")
        bound = (n_a + n_b) * F.lit((1 - threshold) / (1 + threshold))
        apart = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.shiftrightunsigned(F.col("rest_a").bitwiseXOR(F.col("rest_b")), 31))
        near = (F.col("cls_a") < F.col("cls_b")) & (apart <= bound) & (F.least(n_a, n_b) >= F.greatest(n_a, n_b) * threshold)
        return a.join(b, keys).filter(near).select("cls_a", "cls_b")

    rare = rarest_words(classes.select("cls", "words").join(hot.select("cls").distinct(), "cls"), threshold)
    pairs = met(usual, ["sig"]).unionByName(met(hot.join(rare, "cls"), ["sig", "word"])).distinct()
    left = classes.select(F.col("cls").alias("cls_a"), F.col("words").alias("words_a"))
    right = classes.select(F.col("cls").alias("cls_b"), F.col("words").alias("words_b"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    either = F.size("words_a") + F.size("words_b") - both
    return pairs.join(left, "cls_a").join(right, "cls_b").filter(both > either * threshold).select("cls_a", "cls_b")


def near_duplicates(memes: DataFrame, threshold: float = THRESHOLD, miss: float = 0.03, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Membership (id, cls) of every record with words, and the pairs (cls_a, cls_b) of similar classes."""
    sets = persist_table(word_sets(memes).withColumn("cls", F.xxhash64("words")), "word-sets")
    records = memes.count()
    words_per_bucket, signatures = bucket_plan(records, threshold, miss)
    classes = persist_table(signed(sets.groupBy("cls").agg(F.first("words").alias("words")), words_per_bucket, signatures, threshold), "classes")
    # a set has its signatures in about two bands; a task takes some 300,000 of them, whatever the session's number of partitions
    tasks = max(int(memes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * signatures * records // 300_000)
    return sets.select("id", "cls"), class_pairs(classes, threshold, most, tasks)


def duplicate_pairs(memes: DataFrame, threshold: float = THRESHOLD, miss: float = 0.03, most: int = 2000) -> DataFrame:
    """(id_a, id_b): all pairs of similar records, smaller id first, each once; copies expanded."""
    members, pairs = near_duplicates(memes, threshold, miss, most)
    one, two = members.select(F.col("id").alias("x"), F.col("cls").alias("cls_a")), members.select(F.col("id").alias("y"), F.col("cls").alias("cls_b"))
    between = pairs.join(one, "cls_a").join(two, "cls_b").select("x", "y")
    shared = members.groupBy("cls").count().filter("count > 1").select("cls")
    copies = members.join(shared, "cls", "left_semi")
    within = copies.select("cls", F.col("id").alias("x")).join(copies.select("cls", F.col("id").alias("y")), "cls").filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
