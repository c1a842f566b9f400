"""BM25 and the query language against SQLite's full-text index."""

import sqlite3

import pytest

from motleydex.operators.fulltext import Op, Phrase, QuerySyntaxError, bm25, parse_query, postings, query_terms, replace_texts

DOCS = [
    ("a", "exam result exam café"),
    ("b", "the cricket match was over before the exam"),
    ("c", "Cafe owner lost the match result"),
    ("d", "मोगैम्बो खुश हुआ exam"),
    ("e", "cricket, match! cricket match"),
    ("f", "homework and home alone"),
    ("g", ""),
    ("h", "résumé naïve match of the day"),
]
QUERIES = ["exam", "exam result", "cafe", '"cricket match"', "home*", "exam OR match", "match NOT cricket", "(exam OR match) AND result", '"match result"', "खुश", "ख", "मोगैम्बो", "cricket + match", "exam AND (result OR cricket)", '"cri" + "cket"', "naive", "nothing", "match NOT (cricket OR result)", '"the" match*', "NEAR(cricket exam, 5)", "NEAR(cricket exam, 3)", "NEAR(cricket exam)", 'NEAR("cricket match" before exam, 4)', "NEAR(match cricket, 0)", "NEAR(exam result, 0) OR cafe", "NEAR(match* day, 2)", "^exam", "^exam OR ^cricket", '^"the cricket" AND exam', "^match", "search_text : exam", "meme_id : a", "- meme_id : exam", "- search_text : exam", "{search_text meme_id} : match", "search_text : (exam OR match) AND result", "exam NOT meme_id : exam", "NEAR(exam)", "near", "search_text : NEAR(cricket exam, 5)", "search_text : ^ exam", "cricket OR meme_id : exam"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(meme_id UNINDEXED, search_text, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this SQLite")
    con.executemany("INSERT INTO t VALUES (?, ?)", DOCS)
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(DOCS, "meme_id string, search_text string")


@pytest.mark.parametrize("query", QUERIES)
def test_same_scores(fts, texts, query):
    expected = {i: round(-s, 5) for i, s in fts.execute("SELECT meme_id, rank FROM t WHERE search_text MATCH ?", (query,))}
    got = {r.meme_id: round(r.score, 5) for r in bm25(texts, query, 100).collect()}
    assert got == pytest.approx(expected, abs=2e-5)


@pytest.mark.parametrize("query", ["what?", "don't", "exam-stress", "", '"open', "(exam", "exam)", "AND", "exam OR", "NOT exam", "a:b", "(exam OR match) result", "NEAR(exam result, x)", "NEAR(exam", "other : exam", "{search_text : exam", "^", "exam ^", "NEAR(exam, 5", "- exam", "search_text :"])
def test_errors_give_nothing(texts, query):
    with pytest.raises(QuerySyntaxError):
        parse_query(query)
    assert bm25(texts, query, 10).count() == 0


def test_precedence():
    assert parse_query("a OR b c") == Op("OR", Phrase(("a",)), Op("AND", Phrase(("b",)), Phrase(("c",))))


def test_terms():
    assert query_terms("Café, मोगैम्बो 42!") == ("cafe", "म", "ग", "म", "ब", "42")


def test_limit_and_ties(texts):
    assert [r.pos for r in bm25(texts, "match", 2).orderBy("pos").collect()] == [1, 2]


def test_empty_table_and_nulls(spark):
    empty = spark.createDataFrame([], "meme_id string, search_text string")
    assert bm25(empty, "exam", 5).count() == 0
    some = spark.createDataFrame([("a", None), ("b", "exam"), ("c", "x"), ("d", "y")], "meme_id string, search_text string")
    assert [r.meme_id for r in bm25(some, "exam", 5).collect()] == ["b"]


def test_postings_and_replacing(spark, texts):
    assert {(r.term, r.tf) for r in postings(texts).filter("meme_id = 'a'").collect()} == {("exam", 2), ("result", 1), ("cafe", 1)}
    new = spark.createDataFrame([("a", "new"), ("z", "last")], "meme_id string, search_text string")
    once = replace_texts(texts, new)
    assert once.count() == len(DOCS) + 1 and replace_texts(once, new).count() == len(DOCS) + 1
