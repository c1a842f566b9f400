"""Problem 2."""

import json
import random

import pytest

from motleydex.llm.components import components
from motleydex.llm.names import Parser, common_parts, latin, lcs_ratio, linked, name_groups, name_pairs, resembling, tokens

SURNAMES = ["tipanusopu", "takejiteku", "kobipoleju", "dobatevile", "kururumupe", "siparomojo", "lakesibote", "mobikemusa"]
FIRSTS = ["arvind", "gurleen", "lakshman", "nandini", "devika"]


def test_latin_letters():
    assert latin("तिपनुसोपु") == "tipanusopu" and latin("டைம்")[:1] == "t" and latin("कोबिपोलेजु") == "kobipoleju" and latin("é") == "e"


def test_tokens_and_ratio():
    assert tokens("Shri Arvind  T. Tipanusopu ji as captain vitu") == ["arvind", "t.", "tipanusopu"]
    assert tokens("m/s kipakijuko studios pvt ltd") == ["kipakijuko", "studios"]
    assert lcs_ratio("abcd", "abxd") == 0.75 and lcs_ratio("", "a") == 0 and lcs_ratio("a", "a") == 1


def frame(spark, names):
    return spark.createDataFrame([(n, f"m{i}", 7) for i, n in enumerate(names)], "person_name string, meme_id string, key int")


@pytest.fixture(scope="module")
def background():
    return [f"{f} {s}" for f in FIRSTS for s in SURNAMES] * 2


def groups(df):
    return {tuple(r) for r in df.collect()}


def test_spellings_of_one_person(spark, background):
    variants = ["arvind vesukoremi", "vesukoremi arvind", "vesukoremi, arvind", "a. vesukoremi", "arvind vesukroemi", "arvindvesukoremi", "arvind वेसुकोरेमि", "mr arvind vesukoremi", "arvind v. vesukoremi", "vesukoremi"]
    other = ["gurleen vesukorami", "gurleen nabitodesa"]
    got = groups(name_pairs(frame(spark, background + variants * 3 + other + [None, "", " "])))
    expected = {(a, b) for a in variants for b in variants if a < b}
    assert expected <= got
    assert not any(x in p for p in got - expected for x in [*variants, "gurleen nabitodesa"])


def test_kinds_of_organisation_in_a_small_table(spark, background):
    clubs = [f"{x} {k}" for x in ("pakijukore", "tolimesaru", "topumisake") for k in ("club", "broadcasting")]
    names = frame(spark, background + clubs * 2).groupBy("person_name").count().withColumnRenamed("count", "n")
    common = common_parts(names)
    assert {t for t, k in common.items() if k == "O"} == {"club", "broadcasting"} and {t for t, k in common.items() if k == "F"} == set(FIRSTS)
    assert Parser(common).parse("pakijukore broadcasting") == ("#", "pakijukore")


def test_common_surnames_stay_in_the_key(spark):
    firsts = [*FIRSTS, "bhaskar", "chitra", "yamini", "rajat"]
    got = groups(name_pairs(frame(spark, [f"{f} {s}" for f in firsts for s in SURNAMES[:6]] + ["a. tipanusopu"])))
    assert got == {("a. tipanusopu", "arvind tipanusopu")}
    parser = Parser({"arvind": "F", "tipanusopu": "O"})
    assert parser.parse("arvind tipanusopu") == parser.parse("a. tipanusopu") == ("a", "tipanusopu")


def test_aliases_from_records(spark, background):
    memes = spark.createDataFrame([(json.dumps(["Arvind Vesukoremi (AVX - वेसुकोरेमि)"]), 1), (None, 1), ("[", 1), ("null", 1)], "people string, initial int")
    got = groups(name_pairs(frame(spark, [*background, "arvind vesukoremi", "avx"]), memes))
    assert ("arvind vesukoremi", "avx") in got


def test_empty(spark):
    assert name_pairs(frame(spark, ["x"]).limit(0)).count() == 0
    assert name_pairs(frame(spark, ["a", "a", "very " * 2000 + "long name"])).count() == 0
    long = "x" * 20_000
    assert [tuple(r) for r in name_pairs(frame(spark, [f"arvind {long}", f"arvind {long}y", "b"])).collect()] == [(f"arvind {long}", f"arvind {long}y")]


def test_ratio_against_the_table_of_lengths():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs_ratio(a, b) == 2 * t[-1][-1] / (len(a) + len(b))


def test_components_against_union_find(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(400):03}", f"n{rng.randrange(400):03}") for _ in range(300)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)] + [("hub", f"h{i}") for i in range(300)] + [("x", "x")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    expected = {(x, find(x)) for x in list(root) if find(x) != x}
    assert {tuple(r) for r in components(spark.createDataFrame(links, "a string, b string")).collect()} == expected
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_chain_of_single_edits_is_one_group(spark, background):
    """37 spellings, each one letter from the next, frequent ones last: followed to the end."""
    chain = ["vesukoremi"]
    letters = "tkpsnml"
    for i in range(36):
        at = 2 * (i % 5)
        old = chain[-1]
        chain.append(old[:at] + next(x for x in letters if x != old[at] and old[:at] + x + old[at + 1 :] not in chain) + old[at + 1 :])
    assert len(set(chain)) == 37 and all(lcs_ratio(a, b) >= 0.88 for a, b in zip(chain, chain[1:]))
    names = [f"arvind {x}" for k, x in enumerate(chain) for _ in range(k + 1)]
    got = {r.person_name: r.grp for r in name_groups(frame(spark, background * 40 + names)).collect()}
    assert len({got[f"arvind {x}"] for x in chain}) == 1


def test_blocks_that_are_too_common_lose_no_close_pairs(spark):
    """900 cores that all end alike: with blocks of at most 20 the close pairs are still found, by refinement and by sorting."""
    rng = random.Random(6)
    cores = {"".join(rng.choice("kt") + rng.choice("aeiou") for _ in range(3)) + "nagari" for _ in range(1500)}
    rows = [(f"a|{c}", "a", c, 1) for c in sorted(cores)]
    df = spark.createDataFrame(rows, "key string, initial string, core string, n long")
    brute = {(f"a|{a}", f"a|{b}") for a in cores for b in cores if a != b and lcs_ratio(a, b) >= 0.9}
    whole = {(r.key_a, r.key_b) for r in resembling(df, df, 0.9, 4, 10_000, False).collect()}
    cut = {(r.key_a, r.key_b) for r in resembling(df, df, 0.9, 4, 20, False).collect()}
    assert whole == brute and cut <= brute and len(cut) >= 0.9 * len(brute)
    groups = [{(r.key, r.grp) for r in linked(resembling(df, df, 0.9, 4, most, False), 0.9).collect()} for most in (10_000, 20)]
    assert groups[0] == groups[1]


def test_joined_names_with_many_common_parts():
    rng = random.Random(7)
    common = {"".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))): rng.choice("FO") for _ in range(5000)}
    parser = Parser(common)
    firsts = sorted((t for t, k in common.items() if k == "F"), key=lambda t: (-len(t), t))
    for _ in range(300):
        f = rng.choice(firsts)
        t = f + "".join(rng.choice("vz") + rng.choice("aeiou") for _ in range(4))
        best = next(x for x in firsts if t.startswith(x) and len(t) - len(x) >= 5)
        assert parser.parse(t) == (best[0], t[len(best) :])
