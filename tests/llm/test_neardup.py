"""Problem 1 against all pairs."""

import json
import random
from datetime import datetime

import numpy as np
import pytest

from motleydex.llm.neardup import bucket_plan, duplicate_pairs, near_duplicates, rarest_words, sketches, words

SCHEMA = "id string, labeled_at timestamp_ntz, caption string, ocr_text string, image_description string, stamp int, words string, cls int"


def row(i, caption, ocr, desc, at=None):
    return (i, at, json.dumps({"original": caption}) if caption is not None else None, ocr, desc, 1, "x", 2)


def brute(sets, t=0.67):
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) > t * len(sets[a] | sets[b])}


def test_words():
    assert words("“Hello, WОRLD!” a|b #tag don't — ＡＢ") == {"hello", "world", "a", "b", "tag", "don't", "ab"}


def test_hamming_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, 25).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (sketches(s, np.zeros(len(s), int)) for s in (a, b))
        hamming = sum(int(np.bitwise_count(np.bitwise_xor(u, v).view(f"u{u.itemsize}"))[0]) for u, v in zip(x, y))
        assert hamming <= len(set(a.tolist()) ^ set(b.tolist()))


@pytest.mark.parametrize("size", [1, 3, 7, 20, 60, 200])
def test_groups_against_all_pairs(spark, size):
    rng = random.Random(size)
    vocab = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(25):
        base = rng.sample(vocab, size)
        for k in range(4):
            t = list(base)
            for _ in range(round(k * 0.05 * size)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rng.shuffle(t)
            texts[f"{g:02}{k}"] = " ".join(t)
    df = spark.createDataFrame([row(i, None, t, None) for i, t in texts.items()], SCHEMA)
    got = [tuple(r) for r in duplicate_pairs(df).collect()]
    sets = {i: set(t.split()) for i, t in texts.items()}
    assert len(got) == len(set(got)) and set(got) <= brute(sets)
    assert set(got) >= brute(sets, 0.75)
    assert len(got) >= 0.95 * len(brute(sets))


def test_hot_buckets_are_refined_without_loss(spark):
    """A template fills two thirds of 400 records; with buckets of at most 20 classes the same pairs come out as without refinement."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(150)]
    template = [f"t{i}" for i in range(40)]
    texts = {f"{i:03}": " ".join(template + rng.sample(vocab, 20)) for i in range(400)}
    for k in range(0, 400, 8):
        own = texts[f"{k:03}"].split()
        texts[f"{k + 1:03}"] = " ".join(own[:-2] + rng.sample(vocab, 2))
    df = spark.createDataFrame([row(i, None, t, None) for i, t in texts.items()], SCHEMA)
    whole, cut = ({tuple(r) for r in duplicate_pairs(df, most=most).collect()} for most in (10**9, 20))
    assert whole == cut and len(whole) >= 50
    assert whole <= brute({i: set(t.split()) for i, t in texts.items()})


def test_similar_sets_share_one_of_their_rarest_words(spark):
    rng = random.Random(12)
    sets = {k: sorted(set(rng.sample(range(60), rng.randrange(1, 30)))) for k in range(150)}
    df = spark.createDataFrame([(k, v) for k, v in sets.items()], "cls long, words array<int>")
    rare = {}
    for r in rarest_words(df, 0.5).collect():
        rare.setdefault(r.cls, set()).add(r.word)
    pairs = brute({k: set(v) for k, v in sets.items()}, 0.5)
    assert pairs and all(rare[a] & rare[b] for a, b in pairs)


def test_plan_grows_slowly():
    small, large = bucket_plan(100_000), bucket_plan(100_000_000)
    assert bucket_plan(1_000) == small and small[0] < large[0] < 2 * small[0] and small[1] < large[1] < 8 * small[1]


def test_defined_cases(spark):
    new = datetime(2024, 1, 2)
    rows = [
        row("a", "one two three", "four", None, new),
        row("a", "quite other words here", None, None),
        row("b", "ONE, two", "three four!", "", None),
        row("b", "ONE, two", "three four!", "", None),
        row("c", None, None, None),
        row("d", "", "!!!", "..."),
        row(None, "one two three four", None, None),
        row("e", None, "w " * 50_000 + "one two three four", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in duplicate_pairs(df).collect()] == [("a", "b"), ("a", "e"), ("b", "e")] or sorted(tuple(r) for r in duplicate_pairs(df).collect()) == [("a", "b"), ("a", "e"), ("b", "e")]
    assert duplicate_pairs(df.limit(0)).count() == 0


def test_many_copies_are_one_class(spark):
    df = spark.range(600).selectExpr("cast(id as string) id", "cast(null as timestamp_ntz) labeled_at", "cast(null as string) caption", "'some words of one text' ocr_text", "cast(null as string) image_description")
    members, pairs = near_duplicates(df)
    assert members.select("cls").distinct().count() == 1 and pairs.count() == 0
    assert duplicate_pairs(df).count() == 600 * 599 // 2
