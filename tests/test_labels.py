"""Reading label texts."""

import json

import pytest

from motleydex.operators.labels import LabelText, StubLabeler, as_list, label_images, number, outcome, read_label, read_labels, response_text, scalar

BASE = "id: m1\nmultilingual_embedding_text: text\n"


def label(extra):
    return read_label(BASE + extra)


@pytest.mark.parametrize(
    ("line", "key", "value"),
    [
        ("emotion[2]: pride,excitement", "emotion", ["pride", "excitement"]),
        ("intent: celebrate", "intent", ["celebrate"]),
        ("supported_languages: a,b", "supported_languages", ["a", "b"]),
        ("emotion[9]: joy", "emotion", ["joy"]),
        ("source: A: B", "source", "A: B"),
        ('source: "12"', "source", "12"),
        ("# comment", "source", ""),
        ("people: Raj", "people", ["Raj"]),
        ("unknown_key: 3", "people", []),
    ],
)
def test_valid(line, key, value):
    got, error = label(line)
    assert error is None and got[key] == value


@pytest.mark.parametrize("line", ["people[0]:", "source:", "tags:\n  english[1]: 2020", "source: null", "source: 12", "safety:\n  nsfw: maybe", "caption: text", "emotion[1]: null"])
def test_rejected(line):
    got, error = label(line)
    assert got is None and error


def test_lenient_mode():
    assert read_label(BASE + "people[0]:\nemotion[1]: 7", strict=False)[0]["people"] == []


def test_missing_id_truncated_and_empty():
    assert read_label("multilingual_embedding_text: x")[1] == "id: required"
    assert read_label("id: m")[1] == "truncated response"
    assert read_label(None)[1] == read_label("  ")[1] == "empty response"


def test_quality_default_depends_on_presence():
    assert label("")[0]["quality"] == {"is_meme": True, "label_confidence": 0}
    assert label("quality:\n  label_confidence: 0.5")[0]["quality"] == {"is_meme": False, "label_confidence": 0.5}


def test_tables_nesting_and_comments():
    text = "rows[2]{a,b}:\n  1,x\n  true,\nouter:\n  inner:\n    deep: 1e3\n  # note\n\n  side: no\nlast: end"
    assert LabelText(text).read() == {"rows": [{"a": 1, "b": "x"}, {"a": True, "b": 0}], "outer": {"inner": {"deep": 1000}, "side": "no"}, "last": "end"}
    assert LabelText("t[1]{a,b,c}:\n  1,2").read() == {"t": [{"a": 1, "b": 2, "c": None}]}


def test_values():
    assert [number(x) for x in ("", " ", "0x1F", "1e2", ".5", "-3", "1_0", "abc")] == [0, 0, 31, 100, 0.5, -3, None, None]
    assert scalar('"a"') == "a" and scalar("null") is None and scalar("x,y") == "x,y"
    assert as_list("a, ,b") == ["a", 0, "b"] and as_list(3) == [3]


def test_response_parts():
    assert response_text([{"text": "a"}, {"x": 1}, {"text": "b"}]) == "ab" and response_text(None) == "" and response_text("t") == "t"


def test_frame(spark):
    df = spark.createDataFrame([(1, BASE), (2, None), (3, "x"), (4, BASE + "source:")], "n int, response string")
    rows = {r.n: r for r in read_labels(df).collect()}
    assert json.loads(rows[1].label)["id"] == "m1" and rows[1].error is None
    assert all(rows[n].label is None and rows[n].error for n in (2, 3, 4))


class Flaky:
    def label(self, content, mime, item_id, attempt):
        if content == b"down":
            raise RuntimeError("HTTP 500")
        return "cut off" if attempt < 3 else StubLabeler().label(content, mime, item_id, attempt)


def test_labelling_retries_texts_but_not_failures(spark):
    images = spark.createDataFrame([("a.png", bytearray(b"x")), ("b.jpg", bytearray(b"down"))], "path string, content binary")
    rows = {r.path: r for r in label_images(images, Flaky()).collect()}
    assert rows["a.png"].attempts == 3 and rows["a.png"].error is None
    assert rows["b.jpg"].attempts == 1 and "HTTP 500" in rows["b.jpg"].error
    assert tuple(outcome(label_images(images, Flaky())).first()) == (2, 1, 1)
