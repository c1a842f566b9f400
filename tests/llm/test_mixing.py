"""Problem 8."""

import os

import numpy as np
import pytest

from motleydex.llm.encode import VOCABULARY
from motleydex.llm.mixing import mixture, packed, permuted, shard_counts, source_slots

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for seed in (0, 1, 2**63):
            assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, seed, np.uint64))) == list(range(n))
    a, b = (permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, s, np.uint64)) for s in (1, 2))
    assert (a != b).mean() > 0.9


def test_blocks_are_of_fixed_length_and_spans_cover_documents(spark):
    df = spark.range(500).selectExpr("id doc_id", "if(id % 3 = 0, 'x', 'y') source", "cast(if(id = 9, 1000, id % 40 + 1) as bigint) tokens")
    size = {r.doc_id: r.tokens for r in df.collect()}
    rows = packed(df, 100, 7).collect()
    spans, blocks = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.from_token, r.tokens))
        blocks[r.source, r.block] = blocks.get((r.source, r.block), 0) + r.tokens
    assert set(spans) == set(size) and len(spans[9]) >= 10
    for i, got in spans.items():
        assert sorted(got)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(got), sorted(got)[1:])) and sum(n for _, n in got) == size[i]
    for s in "xy":
        own = [blocks[s, b] for b in range(max(b for t, b in blocks if t == s) + 1)]
        assert set(own[:-1]) == {100} and 0 < own[-1] <= 100


def test_shards_add_up_to_the_totals():
    totals = np.array([700, 300, 21, 0, 3])
    shards = 4
    rows = [shard_counts(totals, s, shards, 256, 5) for s in range(shards)]
    assert np.array_equal(sum(n for n, _ in rows), totals) and all(n.sum() == 256 for n, _ in rows)
    for s, (_, before) in enumerate(rows):
        assert np.array_equal(before, sum((n for n, _ in rows[:s]), np.zeros(5, np.int64)))
    assert len({tuple(n) for n, _ in rows}) > 1  # drawn, not divided
    big = np.array([3 * 10**9, 10**9])
    parts = [shard_counts(big, s, 8, 500_000_000, 1)[0] for s in range(8)]
    assert np.array_equal(sum(parts), big) and all(p.sum() == 500_000_000 for p in parts)


def test_slots_stay_within_passes():
    got = source_slots(np.array([0.5, 0.5, 0.0]), np.array([10_000, 100, 50]), np.array([100, 1, 1]), np.array([1, 3, 1]), 8000)
    assert got.tolist() == [40, 3, 0]


def test_shares_and_repeats(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "case when id % 4 = 0 then 'small' when id = 7 then null when id % 4 = 1 then 'unused' else 'big' end source", "if(id % 50 = 49, null, repeat('word and ', 10)) text")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mixture(docs, targets, block_tokens=64, shard_slots=64)
    got = {r.source: r for r in report.collect()}
    assert got["absent"].reached_share == 0 and got["small"].most_repeats == 2 and got["big"].most_repeats == 1
    assert got["big"].reached_share == pytest.approx(0.5 / 0.9, rel=0.02) and sum(r.reached_share for r in got.values()) == pytest.approx(1)
    rows = chosen.collect()
    assert len({(r.doc_id, r.from_token) for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small"} and all(r.doc_id % 50 != 49 for r in rows)
    again = mixture(docs, targets, block_tokens=64, shard_slots=64)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixture(docs, targets)
    assert chosen.count() == 0 and report.first().reached_share == 0
    assert mixture(docs, targets.limit(0))[1].count() == 0
