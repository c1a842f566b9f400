"""Problem 9."""

import numpy as np
import pytest

from motleydex.llm import quality
from motleydex.llm.lines import chunks, measure
from motleydex.llm.quality import KINDS, STATES, Model, common_words, expected, fitted, labelled, likeliest, statistics, text_quality

PROSE = [f"The {a} saw the {b} in the {c} because nobody had told {d} about it." for a in ("driver", "teacher", "actor") for b in ("lamp", "chair", "kite") for c in ("hall", "shop", "tunnel") for d in ("him", "her")]
LIST = "\n".join(f"- {w}" for w in ("red lamp", "kite", "blue chair", "tunnel"))
TABLE = "name\tlikes\tscore\nada\t12\t0.5\nbob\t7\t0.25"
CASES = [
    (PROSE[0], "prose"),
    (" ".join(PROSE[:3]).replace(" in ", "\nin "), "prose"),
    ("Ann: the driver saw it in the hall\nBob: because nobody had told her about it", "prose"),
    (LIST, "list"),
    ("1. lamp\n2. chair\n3. kite", "list"),
    ("→ lamp\n→ red chair\n→ kite", "list"),
    ("lamp, red chair, kite, hall, blue tunnel", "list"),
    ("spoon / red ladder / basket / tree", "list"),
    ("the spoon; the red ladder; the basket; the tree; the salary", "list"),
    ("the spoon · the red ladder · a basket · the tree · the salary · a kite", "list"),
    ("Years later the driver saw it because nobody\nhad told him about it\non 2/2/2015 at 9:12 in the tunnel.", "prose"),
    ("0O Il| '. 5S l1 ii1 ;: -- 0O \U0001d4b3 5S l1 ~ 5S cl", "junk"),
    (TABLE, "table"),
    ("a | b | c\n--- | --- | ---\nx | 1 | 2\ny | 3 | 4", "table"),
    ('"a";"1";"0.5"\r\n"b";"2";"0.7"', "table"),
    ("id=a; hits=3; p=0.5\nid=b; hits=4; p=0.6", "table"),
    ("id: x\nlanguage: hindi\nwidth: 30", "table"),
    ("@@@ ### <<< &&&\n%%% !!!", "junk"),
    ("#a1 #bcd #efg #hij", "junk"),
    ("http://a.example/x?id=1\nhttp://b.example/y", "junk"),
    ("lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp", "junk"),
    ("xkjhqw zzrtq vbnmk qwrtp lkjhg zxcvb", "junk"),
    ("Ã±o Ã¤ti â€™ba ï»¿li à®mo Â©li", "junk"),
]
SCHEMA = "doc_id long, text string, kind int"


@pytest.fixture(scope="module")
def corpus(spark):
    wrapped = ["\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6)) for k in range(0, 18, 3) if (w := " ".join(PROSE[k : k + 3]).split())]
    rows = [(i, t, 1) for i, t in enumerate(PROSE * 3)] + [(1000 + i, LIST, 1) for i in range(30)] + [(2000 + i, t, 1) for i, t in enumerate(wrapped)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def model(corpus):
    words = common_words(corpus)
    return words, fitted(corpus, words)


def one(text, model):
    return {k: v[0] for k, v in statistics([text], *model).items()}


def test_common_words(model):
    found = measure(["the because nobody had lamp"])
    known = np.isin(found.word_hash, model[0].hashes)
    assert known.tolist() == [True, True, True, True, False]


@pytest.mark.parametrize(("text", "kind"), CASES)
def test_kinds(model, text, kind):
    assert one(text, model)["kind"] == kind


def test_larger_part_decides(model):
    assert one(PROSE[0] + "\n" + "\n".join(["- red lamp"] * 30), model)["kind"] == "list"
    assert one(" ".join(PROSE) + "\n- red lamp", model)["kind"] == "prose"


def test_statistics(model):
    s = one("The lamp.\nTwo words", model)
    assert (s["words"], s["pieces"], s["punctuated_lines"]) == (4, 4, 0.5) and s["mean_word_length"] == 3.75
    assert s["symbol_ratio"] == 1 / 16
    assert s["prose"] + s["list"] + s["table"] + s["junk"] == pytest.approx(1)
    assert len(labelled([""], *model)[1]) == 0


def test_a_text_alone_and_among_others_is_the_same(model):
    texts = [t for t, _ in CASES] + ["", None, "\U0001f600 \u200d \x85 a\u2028b", "x" * 300_000, "\udc80 lone"]
    together = statistics(texts, *model)
    for i, t in enumerate(texts):
        assert one(t, model) == {k: v[i] for k, v in together.items()}
    assert [at for at, _ in chunks(["a" * 5, "b" * 5, None, "c" * 50, "d"], 12)] == [0, 3, 4]


def slow_counts(line):
    pieces = line.split()
    return len(pieces), sum(not any(c.isalnum() for c in p) for p in pieces)


def test_counts_of_lines_against_a_plain_loop():
    texts = [t for t, _ in CASES]
    found = measure(texts)
    lines = [x for t in texts for x in t.splitlines() if x.strip()]
    assert found.pieces.tolist() == [slow_counts(x)[0] for x in lines]
    for at, x in enumerate(lines):
        if found.values["marker"][at] == 0 and found.values["broken"][at] == 0:
            share = slow_counts(x)[1] / slow_counts(x)[0]
            assert found.values["signs"][at] == sum(share >= e for e in (0.001, 0.15, 0.4, 0.75))


def test_likeliest_states_and_expectations_against_all_paths():
    """Viterbi and forward-backward over documents of 1 to 4 lines against all sequences of states."""
    import itertools

    rng = np.random.default_rng(3)
    n = len(STATES)
    model = Model(np.log(rng.dirichlet(np.ones(n))), np.log(rng.dirichlet(np.ones(n), n)), {})
    sizes = [2, 1, 3]
    doc = np.repeat(np.arange(3), sizes)
    scores = rng.standard_normal((len(doc), n))
    got = likeliest(model, scores, doc)
    held, first, moves = expected(model, scores, doc)
    at, all_first, all_moves = 0, np.zeros(n), np.zeros((n, n))
    for size in sizes:
        paths = list(itertools.product(range(n), repeat=size))
        w = np.array([model.first[p[0]] + sum(model.after[a, b] for a, b in zip(p, p[1:])) + sum(scores[at + i, s] for i, s in enumerate(p)) for p in paths])
        assert tuple(got[at : at + size]) == paths[int(w.argmax())]
        w = np.exp(w - w.max())
        w /= w.sum()
        for i in range(size):
            assert np.allclose(held[at + i], np.bincount([p[i] for p in paths], weights=w, minlength=n))
        all_first += np.bincount([p[0] for p in paths], weights=w, minlength=n)
        for p, x in zip(paths, w):
            for a, b in zip(p, p[1:]):
                all_moves[a, b] += x
        at += size
    assert np.allclose(first, all_first) and np.allclose(moves, all_moves)


def test_frame(spark, corpus):
    odd = spark.createDataFrame([(5000, None, 1), (5001, "", 1), (5002, " \n\t", 1), (5003, LIST, 1), (5004, "word " * 100_000, 1), (None, TABLE, 1), (5003, LIST, 1)], SCHEMA)
    rows = text_quality(corpus.unionByName(odd)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == corpus.count() + 7
    assert all(by[i].kind is None and by[i].pieces == 0 and by[i].prose is None for i in (5000, 5001, 5002))
    assert by[5003].kind == "list" and by[5004].kind == "junk" and by[None].kind == "table"
    assert text_quality(corpus.limit(0)).count() == 0 and set(KINDS) == {"prose", "list", "table", "junk"} and quality.KIND_OF.max() == 3
