"""Problem 5."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motleydex.llm.unify import findings, odd_fields, respell, script, skeleton, token_scripts, unify, unify_columns

PLAIN = ["", "plain text", "café résumé piñata", "5 km² 10²", "👨‍👩‍👧 🤦‍♂️ ❤️", "Ωμέγα Привет", "साफ्ट‍वेयर".replace("‍", ""), "క్‌ష", "क्‍ष", "தமிழ் ಕನ್ನಡ", "क़लम", None]
ODD = [
    ("ＡＢＣ", "wide", "ABC"),
    ("ﬁne", "joined", "fine"),
    ("café", "separate", "café"),
    ("ொ", "separate", "ொ"),
    ("room​mate", "invisible", "roommate"),
    ("room‍mate", "invisible", "roommate"),
    ("a­b", "invisible", "ab"),
    ("a b", "space", "a b"),
    ("a　b", "space", "a b"),
    ("WНILЕ", "mixed", "WHILE"),
    ("οriginal", "mixed", "original"),
    ("п\u0070ивет", "mixed", "привет"),
    ("М\u006fсква", "mixed", "Москва"),
    ("рус\u0063кий", "mixed", "русский"),
    ("Π\u0061ρις", "mixed", "Παρις"),
    ("ᎪPPLE", "mixed", "APPLE"),
    ("𝐡𝐞𝐥𝐥𝐨 𝒳", "styled", "hello X"),
    ("ℌello", "styled", "Hello"),
    ("Ⅻ ⅳ", "styled", "XII iv"),
    ("ʜᴇʟʟᴏ", "styled", "hello"),
    ("a\ufff9b", "invisible", "ab"),
    ("hi\U000e0068\U000e0069", "invisible", "hi"),
]
WHOLE = ["VКонтакте", "Москва", "Παρις", "ısı", "№ 5 ™ ℃ ℹ️", "[ˈhɪstəɹi]", "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "日本語text", "Ω"]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_stays(text):
    assert not findings(text) & {"wide", "joined", "separate", "invisible", "space", "mixed"}
    if text != "क़लम":
        assert unify(text) == text


@pytest.mark.parametrize(("text", "kind", "plain"), ODD)
def test_odd_is_found_and_mended(text, kind, plain):
    assert kind in findings(text) and unify(text) == plain and not findings(plain)


@pytest.mark.parametrize("text", WHOLE)
def test_scripts_and_signs_that_need_their_characters_stay(text):
    assert unify(text) == text and not findings(text) & {"wide", "joined", "separate", "invisible", "space", "styled"}


def test_the_script_of_most_letters_is_selected():
    assert respell("СОP") == "СОР" and script(respell("СОP")[2]) == "CYRILLIC"
    assert respell("COР") == "COP" and respell("COР").isascii()
    assert respell("СP") == "CP"  # as many of each: Latin
    assert token_scripts("п\u0070и") == (frozenset(), frozenset({"CYRILLIC"}))


def test_scripts():
    assert token_scripts("WНILЕ") == (frozenset(), frozenset({"LATIN"}))
    assert findings("СОР") == {"whole"} and unify("СОР") == "СОР" and skeleton("СОР") == "cop"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_idempotent(text):
    once = unify(text)
    assert unify(once) == once


ROWS = "id string, labeled_at timestamp_ntz, caption string, ocr_text string, meaning string, stamp int, bits string"


def test_fields_of_live_rows(spark):
    new, old = datetime(2024, 1, 2), datetime(2024, 1, 1)
    cap = lambda s: json.dumps({"original": s, "translations": {"hindi": "x"}})
    rows = [
        ("a", new, cap("plain"), "ＯＣＲ", None, 1, "x"),
        ("a", old, cap("ＡＢ"), None, "null", 1, "x"),
        ("b", None, cap("ﬁ"), "", "[", 1, "x"),
        ("b", None, cap("ﬁ"), "", "[", 1, "x"),
        ("c", new, "{", "ok", cap("a​b"), 1, "x"),
        (None, new, cap("ＡＢ"), None, None, 1, "x"),
        ("d", new, cap("long " * 100_000 + " "), None, None, 1, "x"),
    ]
    got = sorted(tuple(r) for r in odd_fields(spark.createDataFrame(rows, ROWS)).collect())
    assert got == [("a", "ocr_text"), ("b", "caption"), ("c", "meaning"), ("d", "caption")]
    assert odd_fields(spark.createDataFrame([], ROWS)).count() == 0


def test_columns(spark):
    clash = spark.createDataFrame([("ﬁ", "old", 1, [1.5])], "t string, t_unified string, n int, xs array<double>")
    assert unify_columns(clash, ["t"]).collect()[0].asDict() == {"t": "ﬁ", "n": 1, "xs": [1.5], "t_unified": "fi", "t_findings": ["joined"]}
    r = unify_columns(spark.createDataFrame([("ＡＢ",), (None,), ("",)], "t string"), ["t"]).collect()
    assert [(x.t_unified, x.t_findings) for x in r] == [("AB", ["wide"]), (None, []), ("", [])]
