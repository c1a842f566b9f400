"""Problem 6: the entry of a reference list that is meant by a freely typed value.

Values are first made distinct, then normalised (look-alikes, case, separators and
punctuation removed). An inverted index from n-grams (single letters, pairs of letters, and letters one apart,
with marks for both ends) to the names of the list, entries and aliases, retrieves
candidates. They are scored by the cosine of n-gram vectors weighted by rarity; the entry with the best one is
accepted if it reaches ``LEAST`` and is ahead of every other entry by ``MARGIN`` or more. An exact check follows that only
rejects: a bounded number of single edits (neighbouring letters swapped count as one) must turn the value into the name.

The index of a list of up to ``most_names`` names is broadcast. A longer list is a table joined by n-grams (``joined_lookup``), with the
same result: a value need only meet names with which it shares one of its rarer n-grams, as those it leaves out
have together too small a norm to reach ``LEAST``.

Defined cases: null and blank values are no values; lists may be JSON arrays, single
JSON strings, null or unreadable (then without values); a value that is nothing but
signs has no entry; of equal candidates none is taken; an empty list of names matches
nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import persist_table
from .common import age, map_batches, newest, parse
from .unify import skeleton

FIELDS = ("emotion", "intent", "regions")
SIGNS = re.compile("[^\\w\u0300-\u036f\u0900-\u0dff]|_")


def plain(value: str) -> str:
    """A value without case, separators and punctuation."""
    return SIGNS.sub("", skeleton(value))


LEAST, MARGIN = 0.25, 0.03


def grams(s: str) -> Counter[str]:
    """The n-grams of a value: letters, pairs and letters one apart, with marks at both ends."""
    t = f"^{s}$"
    return Counter([t[i : i + 2] for i in range(len(t) - 1)] + [f"s{t[i]}{t[i + 2]}" for i in range(len(t) - 2)] + [f"u{c}" for c in s])


def edits(a: str, b: str, most: int) -> int:
    """The number of single edits from a to b, or most + 1 if more; neighbouring letters swapped count as one."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


def allowed(value: str, name: str) -> int:
    """The edits that a value of this length may be away from a name."""
    n = max(len(value), len(name))
    return 1 if n <= 4 else 2 if n <= 11 else 3


class Index:
    """The inverted index of one kind's names."""

    def __init__(self, names: list[tuple[str, str]]):
        self.names = sorted({(plain(n), e) for n, e in names if plain(n)})
        self.exact: dict[str, set[str]] = defaultdict(set)
        for n, e in self.names:
            self.exact[n].add(e)
        seen = Counter(g for n, _ in self.names for g in grams(n))
        self.weight = {g: math.log(1 + len(self.names) / c) for g, c in seen.items()}
        self.unseen = math.log(1 + len(self.names)) if self.names else 0.0
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (n, _) in enumerate(self.names):
            v = {g: c * self.weight[g] for g, c in grams(n).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for g, x in v.items():
                self.index[g].append((k, x / norm))

    def lookup(self, value: str) -> tuple[str, float]:
        """The entry meant by a value and the score, or the empty string."""
        p = plain(value)
        if not p:
            return "", 0.0
        if len(own := self.exact.get(p, ())) == 1:
            return next(iter(own)), 1.0
        v = {g: c * self.weight.get(g, self.unseen) for g, c in grams(p).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        score: dict[int, float] = defaultdict(float)
        for g, x in v.items():
            for k, w in self.index.get(g, ()):
                score[k] += x * w / norm
        best: dict[str, tuple[float, str]] = {}
        for k, s in score.items():
            name, entry = self.names[k]
            if entry not in best or (-s, name) < best[entry]:
                best[entry] = (-s, name)
        return accepted(p, sorted((s, n, e) for e, (s, n) in best.items())[:2])


def accepted(p: str, ranked: list[tuple[float, str, str]]) -> tuple[str, float]:
    """The entry and score of the first of at most two candidates (-cosine, name, entry) of a normalised value, or the empty string."""
    if not ranked or -ranked[0][0] < LEAST or len(ranked) > 1 and ranked[1][0] - ranked[0][0] < MARGIN:
        return "", 0.0
    s, name, entry = ranked[0]
    most = allowed(p, name)
    return (entry, -s) if edits(p, name, most) <= most else ("", 0.0)


def live_values(memes: DataFrame) -> DataFrame:
    """(id, fld, raw): the distinct non-blank values of the fields of live records."""

    def values(text: str | None) -> list[str]:
        v = parse(text)
        v = [v] if isinstance(v, str) else v if isinstance(v, list) else []
        return list(dict.fromkeys(x for x in v if isinstance(x, str) and x.strip()))

    def make():
        def step(c):
            return {"id": c["id"], "stamp": c["stamp"], "vals": [[{"fld": f, "raw": x} for f in FIELDS for x in values(c[f][i])] for i in range(len(c["id"]))]}

        return step

    rows = map_batches(memes.filter("id is not null").select("id", age().alias("stamp"), *FIELDS), make, "id string, stamp timestamp_ntz, vals array<struct<fld:string, raw:string>>")
    return newest(rows, ["id"], "stamp", ["vals"]).select("id", F.explode("vals").alias("v")).select("id", "v.*")


def joined_lookup(values: DataFrame, names: DataFrame) -> DataFrame:
    """(fld, raw, entry, score) of distinct values (fld, raw) against names (kind, entry, name) of any number, by joins on n-grams."""

    def counted(df: DataFrame, columns: list[str], text: str, normal: str) -> DataFrame:
        def make():
            def step(c):
                out: dict[str, list] = {k: [] for k in (*columns, normal, "g", "c")}
                for i, t in enumerate(c[text]):
                    p = plain(t or "")
                    for g, n in (grams(p) if p else {}).items():
                        for k in columns:
                            out[k].append(c[k][i])
                        for k, v in ((normal, p), ("g", g), ("c", n)):
                            out[k].append(v)
                return out

            return step

        return map_batches(df, make, ", ".join(f"{k} string" for k in (*columns, normal)) + ", g string, c int")

    ng = persist_table(counted(names, ["kind", "entry"], "name", "name").distinct(), "name-grams")
    size = ng.select("kind", "entry", "name").distinct().groupBy("kind").agg(F.count("*").alias("names"))
    weight = persist_table(ng.groupBy("kind", "g").agg(F.count("*").alias("often")).join(size, "kind").withColumn("w", F.log(1 + F.col("names") / F.col("often"))), "gram-weights")
    ng = ng.join(weight.select("kind", "g", "w"), ["kind", "g"]).withColumn("x", F.col("c") * F.col("w"))
    own = Window.partitionBy("kind", "entry", "name")
    ng = persist_table(ng.select("kind", "entry", "name", "g", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(own))).alias("y")), "name-vectors")
    vg = counted(values, ["fld", "raw"], "raw", "p").withColumnRenamed("fld", "kind").join(size, "kind").join(weight.drop("names"), ["kind", "g"], "left")
    vg = vg.withColumn("x", F.col("c") * F.coalesce("w", F.log(1 + F.col("names")))).withColumn("often", F.coalesce("often", F.lit(0)))
    mine = Window.partitionBy("kind", "raw")
    vg = vg.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(mine)))
    left_out = F.sum(F.col("x") * F.col("x")).over(mine.orderBy(F.desc("often"), "g"))  # the commonest n-grams together
    vg = persist_table(vg.withColumn("needed", left_out >= LEAST * LEAST * 0.98).select("kind", "raw", "p", "g", "x", "needed"), "value-vectors")
    met = vg.filter("needed").select("kind", "g", "raw").join(ng.select("kind", "g", "entry", "name"), ["kind", "g"]).select("kind", "raw", "entry", "name").distinct()
    score = met.join(ng, ["kind", "entry", "name"]).join(vg.select("kind", "raw", "p", "g", "x"), ["kind", "raw", "g"]).groupBy("kind", "raw", "p", "entry", "name").agg((-F.sum(F.col("x") * F.col("y"))).alias("s"))
    best = score.groupBy("kind", "raw", "p", "entry").agg(F.min(F.struct("s", "name")).alias("b"))
    ranked = best.groupBy("kind", "raw", "p").agg(F.slice(F.array_sort(F.collect_list(F.struct("b.s", "b.name", "entry"))), 1, 2).alias("ranked"))
    same = ng.select("kind", "name", "entry").distinct().groupBy("kind", "name").agg(F.min("entry").alias("same"), F.count("*").alias("n")).filter("n = 1")
    ranked = ranked.join(same.select("kind", F.col("name").alias("p"), "same"), ["kind", "p"], "left")

    def make():
        def step(c):
            found = [(e, 1.0) if e is not None else accepted(p, [(x["s"], x["name"], x["entry"]) for x in r]) for p, e, r in zip(c["p"], c["same"], c["ranked"])]
            return {"fld": c["kind"], "raw": c["raw"], "entry": [e for e, _ in found], "score": [s for _, s in found]}

        return step

    found = map_batches(ranked, make, "fld string, raw string, entry string, score double")
    return values.join(found, ["fld", "raw"], "left").na.fill({"entry": "", "score": 0.0})


def mapped(values: DataFrame, vocabulary: DataFrame, most_names: int = 100_000) -> DataFrame:
    """Adds ``entry`` and ``score`` to (.., fld, raw): each distinct value is looked up once and joined back."""
    spark = values.sparkSession
    listed = F.array_union(F.array("entry"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = vocabulary.select("kind", "entry", F.explode(listed).alias("name")).filter("kind is not null and entry is not null and name is not null")
    # few distinct values may stand in one task after they are merged
    distinct = values.select("fld", "raw").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = names.limit(most_names + 1).collect()
    if len(rows) > most_names:
        return values.join(joined_lookup(persist_table(distinct, "values"), names), ["fld", "raw"])
    by_kind: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for r in rows:
        by_kind[r.kind].append((r.name, r.entry))
    known = spark.sparkContext.broadcast(dict(by_kind))

    def make():
        index = {k: Index(v) for k, v in known.value.items()}
        none = Index([])

        def step(c):
            found = [index.get(f, none).lookup(x) for f, x in zip(c["fld"], c["raw"])]
            return c | {"entry": [e for e, _ in found], "score": [s for _, s in found]}

        return step

    return values.join(map_batches(distinct, make, "fld string, raw string, entry string, score double"), ["fld", "raw"])


def mapped_fields(memes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, fld, raw, entry, score): every value that is not literally an entry of its kind, with the entry meant or the empty string."""
    entries = F.broadcast(vocabulary.select(F.col("kind").alias("fld"), F.col("entry").alias("raw")).filter("raw is not null"))
    return mapped(live_values(memes).join(entries, ["fld", "raw"], "left_anti"), vocabulary).select("id", "fld", "raw", "entry", "score")
