"""Problem 3."""

import json
from datetime import datetime

import numpy as np
import pytest

from motleydex.llm.language import corrections, fit, parts, record_languages, score, train

CODES = [("hindi", "hi"), ("hinglish", "hi-Latn"), ("english", "en"), ("tamil", "ta")]
WORDS = {
    "hindi": "मुझे तो बस नया फोन चाहिए था और मेरे दोस्त को ले आए हैं यह पल जब देख रहे हैं".split(),
    "hinglish": "mujhe toh bas naya phone chahiye tha aur mera dost ko le aaya hai yeh pal jab dekh raha hai".split(),
    "english": "this is why my friend never gives the new phone to anyone when the teacher is watching".split(),
    "tamil": "எனக்கு புதிய போன் மட்டும் போதும் ஆனால் என் நண்பன் கொண்டு வந்தார்".split(),
}
SCHEMA = "id string, labeled_at timestamp_ntz, caption string, primary_language string, supported_languages string, parts int, label string"


def say(lang, rng, n=8):
    return " ".join(rng.choice(WORDS[lang], n))


def cap(text):
    return json.dumps({"original": text, "translations": {}})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    langs = list(WORDS)
    return [(f"t{i:03}", datetime(2024, 1, 1), cap(say(langs[i % 4], rng)), langs[i % 4] if i % 10 else "hindi", json.dumps([langs[i % 4]]), 1, "x") for i in range(200)]


def test_held_out_accuracy(rows):
    logp = train([(r[2], r[3]) for r in rows], CODES)
    rng = np.random.default_rng(9)
    texts = [(say(l, rng, 6), k) for k, (l, _) in enumerate(CODES) for _ in range(50)]
    got, sure = score([t for t, _ in texts], logp)
    assert (got == [k for _, k in texts]).mean() >= 0.99 and ((sure > 0.25) & (sure <= 1)).all()
    assert len(score([], logp)[0]) == 0


def test_a_language_without_texts_is_never_chosen():
    logp = fit(["abc def"], np.array([0]), 2)
    assert score(["xyz", "abc"], logp)[0].tolist() == [0, 0]


def test_parts():
    assert parts("a | b\n\n!!|c\r\nd e") == ["a", "b", "c", "d", "e"] and parts("42 😂") == []


def test_found_rows(spark, rows):
    rng = np.random.default_rng(5)
    en, hi, hg = say("english", rng), say("hindi", rng), say("hinglish", rng)
    extra = [
        ("a", datetime(2024, 2, 1), cap(f"{en} | {en}"), "EN ", '["English"]', 1, "x"),
        ("b", datetime(2024, 2, 1), cap(en), "hindi", "null", 1, "x"),
        ("b", None, cap(hi), "english", None, 1, "x"),
        ("c", None, cap(f"{hi}|{hg}"), None, '["hi", "hi-latn", "tamil"]', 1, "x"),
        ("d", None, cap("😂😂"), None, None, 1, "x"),
        ("e", None, "{", "english", "[", 1, "x"),
        ("f", None, None, None, None, 1, "x"),
        (None, None, cap(en), "hindi", None, 1, "x"),
        ("g", None, cap((say("hindi", rng, 5000) + " ") * 5), " ", '["hindi"]', 1, "x"),
    ]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    codes = spark.createDataFrame(CODES, "lang string, code string")
    got = sorted(tuple(r)[:4] for r in corrections(df, codes).collect() if not r.id.startswith("t"))
    assert got == [("b", "primary_language", 0, "english"), ("b", "supported_languages", 0, "english"), ("c", "caption", 1, "hindi"), ("c", "caption", 2, "hinglish"), ("g", "primary_language", 0, "hindi")]
    assert record_languages(df, codes).count() == 200 + 7
    assert corrections(df.limit(0), codes).count() == 0
