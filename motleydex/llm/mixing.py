"""Problem 8: mixing sources to target shares of the total size in tokens.

Every source's documents, in a pseudorandom order, are one stream of tokens, packed into blocks of
``block_tokens`` tokens each (the last one of a source is shorter); a document stands in its blocks with spans, from a token
to a token. The output is cut into shards of ``shard_slots`` slots. How many slots each source fills in a shard is
a multinomial draw with the target shares, given that over all shards the draws add up to the targets: the slots of
all sources are divided between the two halves of the shards by a hypergeometric draw, and so on down to single shards. So every shard finds
its counts, and the number of each source's slots before it, alone, and rounding errors do not add up. Slot i of a source with b blocks
takes block i mod b through a pseudorandom permutation of that pass (a permutation
network over the smallest power of four, walked until it lands below b). Passes beyond
``max_repeats`` stay empty. Blocks are joined by (source, index).

The prefix sums of documents run in two levels (a sum per bucket of the pseudorandom order, then
inside a bucket), so no task sees a whole source however large it is.

Defined cases: null and empty texts have no tokens and are never chosen; documents
whose source is null or no target are not used; a target whose source is absent
leaves its share to the others, one that is too small reaches less; both are reported; targets with a share of zero
or less get nothing; an empty table gives shares of zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import persist_table
from .common import map_batches
from .encode import VOCABULARY, encoded


def permuted(i: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The images of indices i < n under the permutation of each seed: four Feistel rounds, walked until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 0.5) / 2)).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = i.astype(np.uint64)
    todo = np.ones(len(i), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for r in range(4):
                h = (right + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ seed[todo]
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask[todo])
            out[todo] = left << half[todo] | right
            todo &= out >= n.astype(np.uint64)
    return out.astype(np.int64)


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens) of the documents of target sources with at least one token."""
    wanted = F.broadcast(targets.select("source").distinct())  # at most most_targets rows, checked by mixture
    return encoded(documents.join(wanted, "source", "left_semi"), "doc_id", vocabulary=vocabulary, extra=("source",), sizes_only=True).filter("tokens > 0")


def packed(sizes: DataFrame, block_tokens: int, buckets: int) -> DataFrame:
    """(doc_id, source, block, from_token, tokens): the spans of (doc_id, source, tokens) in the blocks of their sources, in the order of a hash of the id."""
    order = F.xxhash64("doc_id", F.lit(8))
    d = sizes.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    per = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    before = per.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("before")
    placed = d.join(before.select("source", "bucket", "before"), ["source", "bucket"]).withColumn("start", start).withColumn("end", F.col("start") + F.col("tokens"))
    spans = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((F.col("end") - 1) / block_tokens))))
    lo, hi = F.greatest("start", F.col("block") * block_tokens), F.least("end", (F.col("block") + 1) * block_tokens)
    return spans.select("doc_id", "source", "block", (lo - F.col("start")).alias("from_token"), (hi - lo).alias("tokens"))


def shard_counts(totals: np.ndarray, shard: int, shards: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in a shard, slots of each source in the shards before it)."""
    counts, before = totals.astype(np.int64), np.zeros(len(totals), np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left_slots = (mid - lo) * shard_slots
        if counts.sum() < 1_000_000_000:
            left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, left_slots, method="marginals")
        else:  # too many for the draw: in proportion
            exact = counts * (left_slots / counts.sum())
            left = np.floor(exact).astype(np.int64)
            left[np.argsort(left - exact, kind="stable")[: left_slots - int(left.sum())]] += 1
        if shard < mid:
            counts, hi = left, mid
        else:
            counts, before, lo = counts - left, before + left, mid
    return counts, before


def source_slots(shares: np.ndarray, have: np.ndarray, blocks: np.ndarray, passes: np.ndarray, total: int) -> np.ndarray:
    """The slots of each source for ``total`` tokens: its share by the mean size of its blocks, within its passes."""
    mean = np.maximum(1, have) / np.maximum(1, blocks)
    return np.minimum(np.rint(total * shares / mean).astype(np.int64), blocks * passes)


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 256, shard_slots: int = 256, seed: int = 5, vocabulary: str = VOCABULARY, bucket_docs: int = 5000, most_targets: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The chosen spans (doc_id, source, from_token, tokens, repeats) and the report by source.

    ``total_tokens`` defaults to the largest total at which every source that is present can
    reach its share within its repeats, but at least half of what the sources hold, so that one
    tiny source cannot shrink the mixture.
    """
    spark = documents.sparkSession
    if targets.limit(most_targets + 1).count() > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    # encoding is the costly step, so its sizes are stored and used for all sums
    sizes = persist_table(sized(documents, targets, vocabulary), "sized")
    docs = packed(sizes, block_tokens, max(1, documents.count() // bucket_docs))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have_tokens"), F.count("*").alias("docs")).withColumn("blocks", F.ceil(F.col("have_tokens") / block_tokens))
    goal = persist_table(targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left").na.fill(0, ["have_tokens", "blocks", "docs"]), "targets")
    rows = sorted((r.source, max(0.0, r.target_share or 0.0), max(0, r.max_repeats or 0), r.blocks, r.have_tokens) for r in goal.filter("source is not null").collect())  # a row per target source
    shares = np.array([r[1] if r[4] else 0.0 for r in rows])  # absent sources leave their share to the others
    shares = shares / shares.sum() if shares.sum() > 0 else shares
    names, passes, blocks, tokens = [r[0] for r in rows], *(np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
    total = total_tokens
    if total is None:
        reachable = min((t * p / s for t, p, s in zip(tokens, passes, shares) if s > 0), default=0)
        total = int(max(tokens.sum() / 2, reachable))
    totals = source_slots(shares, tokens, blocks, passes, total) if len(rows) else np.zeros(0, np.int64)
    shards = -(-int(totals.sum()) // shard_slots)

    def draw():
        def step(c):
            out: dict[str, list] = {"source": [], "block": []}
            for s in c["id"]:
                n, before = shard_counts(totals, s, shards, shard_slots, seed)
                for k in np.flatnonzero(n).tolist():
                    i, b = np.arange(before[k], before[k] + n[k]), int(blocks[k])
                    keys = (i // b).astype(np.uint64) * np.uint64(1000003) + np.uint64(seed * 8191 + k)
                    out["block"] += permuted(i % b, np.full(len(i), b), keys).tolist()
                    out["source"] += [names[k]] * len(i)
            return out

        return step

    filled = map_batches(spark.range(shards), draw, "source string, block long").groupBy("source", "block").agg(F.count("*").alias("repeats"))
    chosen = docs.join(filled, ["source", "block"]).select("doc_id", "source", "from_token", "tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.countDistinct("doc_id").alias("chosen_docs"))
    everything = Window.partitionBy()
    report = goal.join(used, "source", "left").na.fill(0, ["tokens", "most_repeats", "chosen_docs"])
    report = report.withColumn("reached_share", F.when(F.sum("tokens").over(everything) > 0, F.col("tokens") / F.sum("tokens").over(everything)).otherwise(0.0))
    return chosen, report.select("source", "target_share", "reached_share", "tokens", "have_tokens", "docs", "chosen_docs", "most_repeats", "max_repeats")
