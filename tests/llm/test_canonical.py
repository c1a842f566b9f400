"""Problem 6."""

import json
import random
from datetime import datetime

import pytest

from motleydex.llm.canonical import Index, accepted, edits, joined_lookup, live_values, mapped, mapped_fields, plain

VOCAB = [("emotion", 1, "joy", ["happiness"]), ("emotion", 2, "approval", ["thumbs up"]), ("emotion", 3, "disapproval", ["thumbs down"]), ("intent", 4, "react_to_absurdity", []), ("regions", 5, "pan_india", None), ("regions", 6, "bengal", ["bangla"])]


@pytest.mark.parametrize(
    ("kind", "value", "entry"),
    [
        ("emotion", " JOY!", "joy"), ("emotion", "jou", "joy"), ("emotion", "Hapiness", "joy"), ("emotion", "thumsb up", "approval"), ("emotion", "disapprval", "disapproval"), ("emotion", "42", ""), ("emotion", "???", ""), ("emotion", "nostalgia", ""),
        ("intent", "React/To/Absurdiy", "react_to_absurdity"), ("regions", "Pan India", "pan_india"), ("regions", "bngal", "bengal"), ("regions", "moon", ""), ("regions", "ｂｅｎｇａｌ", "bengal"),
    ],
)
def test_lookup(kind, value, entry):
    index = Index([(x, e) for k, _, e, al in VOCAB if k == kind for x in (e, *(al or []))])
    assert index.lookup(value)[0] == entry


def test_edits():
    assert edits("ab", "ba", 2) == 1 and edits("abc", "abc", 1) == 0 and edits("abc", "xyz", 1) == 2 and edits("kitten", "sitting", 3) == 3
    assert plain("A_b-c d.") == "abcd"


def test_ties_and_empty_index():
    assert Index([("abcde", "x"), ("abcdf", "y")]).lookup("abcdg")[0] == "" and Index([]).lookup("a") == ("", 0.0)
    assert Index([("same", "x"), ("same", "y")]).lookup("same")[0] == ""


SCHEMA = "id string, labeled_at timestamp_ntz, emotion string, intent string, regions string, raw string, vals int"


def test_fields(spark):
    rows = [
        ("a", datetime(2024, 1, 2), json.dumps(["joy", "Joyy", "Joyy", " ", "", "zz"]), '"react to absurdity"', "null", "x", 1),
        ("a", datetime(2024, 1, 1), '["thumbs up"]', None, None, "x", 1),
        ("b", None, "[", "", '["pan india ", 3, null]', "x", 1),
        ("b", None, "[", "", '["pan india ", 3, null]', "x", 1),
        (None, None, '["joi"]', None, None, "x", 1),
        ("c", None, json.dumps(["x" * 50_000]), None, None, "x", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    vocab = spark.createDataFrame(VOCAB, "kind string, entry_id int, entry string, aliases array<string>")
    got = sorted((r.id, r.fld, r.raw[:20], r.entry) for r in mapped_fields(df, vocab).collect())
    assert got == [("a", "emotion", "Joyy", "joy"), ("a", "emotion", "zz", ""), ("a", "intent", "react to absurdity", "react_to_absurdity"), ("b", "regions", "pan india ", "pan_india"), ("c", "emotion", "x" * 20, "")]
    assert mapped_fields(df.limit(0), vocab).count() == 0 and mapped_fields(df, vocab.limit(0)).filter("entry <> ''").count() == 0
    for values in (live_values(df), live_values(df).limit(0)):
        small, large = (sorted(map(tuple, mapped(values, vocab, most_names=n).select('id', 'fld', 'raw', 'entry').collect())) for n in (100_000, 3))
        assert small == large
    assert live_values(df).filter("id = 'a' and fld = 'emotion'").count() == 3


def test_margin_and_threshold():
    assert accepted("abcd", [(-0.8, "abcx", "x"), (-0.5, "abqx", "y")]) == ("x", 0.8)
    assert accepted("abcd", [(-0.8, "abcx", "x"), (-0.78, "abcy", "y")]) == ("", 0.0)
    assert accepted("abcd", [(-0.2, "abcx", "x")]) == ("", 0.0) and accepted("abcd", [(-0.8, "axyz", "x")]) == ("", 0.0) and accepted("abcd", []) == ("", 0.0)


def test_the_joined_index_equals_the_broadcast_one(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("aeioklmnrst") for _ in range(rng.randrange(3, 12))) for _ in range(200)]
    typed = []
    for n in names:
        t = list(n)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("aeioklmnrst")
        typed.append("".join(t))
    index = Index([(n, n) for n in names])
    vocab = spark.createDataFrame([("k", n, n) for n in names], "kind string, entry string, name string")
    got = {r.raw: r.entry for r in joined_lookup(spark.createDataFrame([("k", t) for t in {*typed, "!!", "zzz"}], "fld string, raw string"), vocab).collect()}
    assert got == {t: index.lookup(t)[0] for t in got} and len(got) == len({*typed}) + 2 and sum(e != "" for e in got.values()) > 100
