"""Problem 2: the spellings of one person or organisation.

Each distinct name is cleaned (honorifics, roles, legal forms), put into Latin letters
and split into a core, the rarest long part (a surname, or what names an organisation),
and the first name's initial. Common parts, first names and kinds of organisation,
are those that stand beside parts of more different initials than their partners do, learned from
all names; a part at the back whose partners are first names is a surname, however common.

Cores that may be spellings of one another come from suffix blocking: every suffix of
at least ``shortest`` letters of a core, read forwards and backwards, is indexed together with
the initial, a field of its own. A block that is too common, over ``most`` cores, is refined by the core's other end,
then by its length; what is still over ``most`` is sorted, and each core meets those up to ``most``
places away. Pairs are compared by the ratio of their longest common
subsequence. Each core is linked to the most frequent core that it resembles, so a group
gathers around its usual spelling, and to all that are a single edit apart; groups are the connected
components of these links, followed to the end. Names without a first name, and abbreviations, join a group
through the aliases that records state in parentheses, or the only or clearly
most frequent bearer of that core.

Defined cases: null and blank names are left out; repeated rows only count; a name
that resembles no other is its own group; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import persist_table
from .common import map_batches, parse
from .components import components
from .unify import skeleton

# Titles, and the ends of companies' names, that do not tell entities apart.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "shri", "sri", "shree", "smt", "kumari", "ji", "sahab", "saab", "madam", "the", "m/s", "messrs", "ustad", "pandit", "late", "capt", "col"}
LEGAL = {"pvt", "ltd", "private", "limited", "india", "inc", "llp", "llc", "corp", "co", "company", "group", "&", "and", "plc", "gmbh"}
ROLE = re.compile(r"\s+(?:as|in the role of|playing|plays)\s+.*$|\s*[\[{<].*$")
LONGEST_SUFFIX = 64
SPLIT = re.compile(r"[\s\-_,;/]+")


@lru_cache(8192)
def _sound(ch: str) -> tuple[str, str]:
    """How a letter of an Indic script is read: its kind and its Latin letters."""
    name = unicodedata.name(ch, "")
    last = name.rpartition(" ")[2].lower()
    if "VIRAMA" in name:
        return "virama", ""
    if "NUKTA" in name:
        return "none", ""
    if "ANUSVARA" in name or "CANDRABINDU" in name or "BINDI" in name or "TIPPI" in name:
        return "sign", "n"
    last = re.sub(r"(.)\1+", r"\1", last)
    if "VOWEL SIGN" in name:
        return "vowel", last
    if " LETTER " in name:
        return ("letter", last[:-1]) if len(last) > 1 and last.endswith("a") and last[0] not in "aeiou" else ("sign", last)
    return "sign", ch


def latin(text: str) -> str:
    """A text with the letters of Indic scripts read as Latin ones; other accents are dropped."""
    if text.isascii():
        return text
    out: list[str] = []
    pending = False
    for ch in unicodedata.normalize("NFC", text):
        if not 0x900 <= ord(ch) <= 0xDFF:
            out.append(("a" if pending else "") + "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)))
            pending = False
            continue
        kind, sound = _sound(ch)
        if kind in ("letter", "sign") and pending:
            out.append("a")
        if kind != "none":
            pending = kind == "letter"
        out.append(sound)
    return "".join(out) + ("a" if pending else "")


def tokens(name: str) -> list[str]:
    """The parts of a name without titles, roles and legal forms, in Latin letters; an initial keeps its point."""
    s = latin(skeleton(name))
    s = ROLE.sub("", re.sub(r"\(.*?\)|\(.*$", " ", s))
    s = re.sub(r"\bm/s\b", " ", s)
    out = []
    for t in SPLIT.split(s):
        t = re.sub(r"[^\w.&]", "", t)
        bare = t.strip(".")
        if bare and bare not in TITLES and t != "&":
            out += [p + "." for p in bare.split(".")] if "." in bare else [t if t.endswith(".") else bare]
    kept = [t for t in out if t.strip(".") not in LEGAL]
    return kept or out


def folded(s: str) -> str:
    """Letters that scripts without voiced stops do not tell apart made one."""
    return s.translate(str.maketrans("bdgvz", "ptkws"))


def lcs_ratio(a: str, b: str) -> float:
    """The share of two words' letters in their longest common subsequence."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full  # a bit is cleared for each letter of a subsequence found so far
    for y in b:
        hit = open_ & at.get(y, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return 2 * (len(a) - open_.bit_count()) / (len(a) + len(b))


class Parser:
    """Splits names by the common parts: kind of each, F for first names and O for kinds of organisation."""

    def __init__(self, common: dict[str, str]):
        self.common = common
        order = sorted(common, key=lambda t: (common[t] == "F", -len(t), t))
        self.firsts = {t for t in order if common[t] == "F"}
        self.kinds = {t for t in order if common[t] == "O"}
        self.longest = max(map(len, common), default=0)
        self.seen: dict[str, str] = {}
        self.by_end: dict[tuple[int, str, int], list[str]] = {}
        self.by_start: dict[str, str] = {}  # a part's beginning: the first common part that begins so, kinds before first names, long ones before short ones
        for t in order:
            for end in (0, -1):
                self.by_end.setdefault((end, t[end], len(t)), []).append(t)
            for n in range(3, len(t) + 1):
                self.by_start.setdefault(t[:n], t)

    def near(self, part: str) -> list[tuple[float, str]]:
        """The common parts of about the same length and with the same first or last letter, with their likeness."""
        found = {c for end in (0, -1) for n in range(len(part) - 2, len(part) + 3) for c in self.by_end.get((end, part[end], n), ())}
        return [(lcs_ratio(part, c), c) for c in found]

    def kind(self, t: str) -> str:
        """F, O, I for an initial, or the empty string for a rare part."""
        bare = t.strip(".")
        if len(bare) == 1:
            return "I"
        got = self.seen.get(t)
        if got is None:
            got = self.common.get(bare, "")
            if not got:
                near = self.near(bare) if len(bare) >= 4 else []
                if near and max(near)[0] >= 0.82:
                    got = self.common[max(near)[1]]
                elif t.endswith(".") or len(bare) <= 5:
                    at = self.by_start.get(bare)
                    got = self.common[at] if at else "S" if len(bare) <= 5 else ""
            if len(self.seen) < 1 << 17:
                self.seen[t] = got
        return got

    def parse(self, name: str) -> tuple[str, str]:
        """(initial, core); initial is # for an organisation and empty when unknown; an abbreviation has ! as initial."""
        ts = tokens(name)
        if not ts:
            return "", ""
        if len(ts) == 1:
            t = ts[0].strip(".")
            if len(t) <= 4:
                return "!", t
            for n in range(min(self.longest, len(t) - 5), 0, -1):
                if t[:n] in self.firsts:
                    return t[0], t[n:]
            joined = self._org(t)
            if joined:
                return "#", joined
            for n in range(min(self.longest + 2, len(t) - 6), 0, -1) if len(t) >= 13 else ():
                if any(c in self.firsts and lcs_ratio(t[:n], c) >= 0.82 for c in self.by_end.get((0, t[0], n), ())):
                    return t[0], t[n:]
            return "", t
        kinds = [self.kind(t) for t in ts]
        bare = [t.strip(".") for t in ts]
        rare = [t for t, k in zip(bare, kinds) if k == ""]
        if len(ts) == 2 and sorted(kinds) in (["F", "O"], ["I", "O"]):  # no part is rare: a person whose surname is common
            at = kinds.index("O")
            return bare[1 - at][0], bare[at]
        core = max(rare, key=len) if rare else max((t for t, k in zip(bare, kinds) if k != "O"), key=len, default=bare[0])
        others = [(t, k) for t, k in zip(bare, kinds) if t != core]
        if any(k == "O" for _, k in others):
            return "#", core
        for want in "FI":
            for t, k in others:
                if k == want:
                    return t[0], core
        # a part that is not known tells the initial only where a first name is expected
        if others and (bare[0] != core or "," in name):
            return others[0][0][0], core
        return "", core

    def _org(self, t: str) -> str:
        """A joined name without the kinds of organisation at its end, or the empty string if there is none."""
        rest = t
        while n := next((n for n in range(min(self.longest, len(rest) - 5), 0, -1) if rest[-n:] in self.kinds), 0):
            rest = rest[:-n]
        return rest if rest != t else ""


def common_parts(names: DataFrame, least_initials: int = 5, most_parts: int = 500_000) -> dict[str, str]:
    """The common parts of names, at the front (F) or the back (O).

    A part is more varied than its partners if it has three or more, of two or more initials, and two thirds of its
    rows are beside parts with fewer initials; that does not depend on the size of the table. F also are parts with
    ``least_initials`` at the front. O are only those whose partners, by rows,
    are not mostly first names (at the front, and varied or of four initials): others are surnames.
    They are broadcast; more than ``most_parts`` (some 10 MB) raise an error.
    """

    def make():
        def step(c):
            part, other, front, n = [], [], [], []
            for name, k in zip(c["person_name"], c["n"]):
                ts = [t.strip(".") for t in tokens(name)]
                if 2 <= len(ts) <= 3 and "," not in name:
                    for i, t in enumerate(ts):
                        if len(t) >= 2:
                            for j, u in enumerate(ts):
                                if i != j and len(u) >= 6:
                                    part.append(t)
                                    other.append(u)
                                    front.append(k if i == 0 else 0)
                                    n.append(k)
            return {"part": part, "other": other, "front": front, "n": n}

        return step

    seen = map_batches(names, make, "part string, other string, front long, n long")
    beside = persist_table(seen.groupBy("part", "other").agg(F.sum("front").alias("front"), F.sum("n").alias("n")), "name-parts")
    found = beside.groupBy("part").agg(F.countDistinct(F.substring("other", 1, 1)).alias("initials"), F.count("*").alias("partners"), F.sum("front").alias("front"), F.sum("n").alias("n"))
    found = persist_table(found.filter("initials >= 2 and partners >= 3"), "name-kinds")
    partner = found.select(F.col("part").alias("other"), F.col("initials").alias("its"))
    edges = beside.select("part", "other", F.col("n").alias("k")).join(partner, "other", "left").join(found.select("part", "initials"), "part")
    weaker = edges.groupBy("part").agg(F.sum(F.when(F.coalesce("its", F.lit(0)) < F.col("initials"), F.col("k")).otherwise(0)).alias("above"))
    judged = found.join(weaker, "part", "left").selectExpr("part", "initials", "2 * front >= n as first", "3 * coalesce(above, 0) >= 2 * n as varied", "n")
    firsts = judged.filter("first and (varied or initials >= 4)").select(F.col("part").alias("other"))  # what names an organisation has few kinds beside it
    given = beside.join(firsts, "other", "left_semi").groupBy("part").agg(F.sum("n").alias("given"))
    judged = judged.filter((F.col("first") & (F.col("initials") >= least_initials)) | F.col("varied"))
    common = judged.join(given, "part", "left").filter("first or 2 * coalesce(given, 0) <= n")
    rows = common.limit(most_parts + 1).collect()
    if len(rows) > most_parts:
        raise ValueError(f"more than {most_parts} common parts of names")
    return {r.part: "F" if r["first"] else "O" for r in rows}


def stated_aliases(memes: DataFrame) -> DataFrame:
    """(alias, full, n): what records state in parentheses behind a name, as A - B."""

    def make():
        def step(c):
            alias, full = [], []
            for p in c["people"]:
                v = parse(p)
                for x in v if isinstance(v, list) else []:
                    if isinstance(x, str) and (m := re.match(r"(.*?)\((.+?)\)\s*$", x)):
                        for a in re.split(r"\s+[-–/,]\s+", m.group(2)):
                            if a.strip():
                                alias.append(a.strip().lower())
                                full.append(m.group(1).strip().lower())
            return {"alias": alias, "full": full}

        return step

    return map_batches(memes.filter(F.col("people").contains("(")).select("people"), make, "alias string, full string").groupBy("alias", "full").agg(F.count("*").alias("n"))


def blocks(cores: DataFrame, shortest: int, fold: bool) -> DataFrame:
    """(block, finer, finest, key, core, n): the suffixes of cores (key, initial, core, n), both ways, with what refines them."""

    def make():
        def step(c):
            out: dict[str, list] = {k: [] for k in ("block", "finer", "finest", "key", "core", "n")}
            for key, initial, core, n in zip(c["key"], c["initial"], c["core"], c["n"]):
                core = folded(core) if fold else core
                for way, s in ((">", core), ("<", core[::-1])):
                    first = max(0, len(s) - LONGEST_SUFFIX)  # cores that share a longer suffix share this one too
                    for i in range(first, max(first + 1, len(s) - shortest + 1)):
                        block = f"{'' if fold else initial}{way}{s[i:]}"
                        out["block"].append(block)
                        out["finer"].append(f"{block}/{s[:2]}")
                        out["finest"].append(f"{block}/{s[:2]}/{len(s)}")
                        out["key"].append(key)
                        out["core"].append(core)
                        out["n"].append(n)
            return out

        return step

    return map_batches(cores.select("key", "initial", "core", "n"), make, "block string, finer string, finest string, key string, core string, n long")


def placed(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The left and the right rows of blocks(), with their ``side`` (0 left, 1 right, 2 both), at the places where they meet: (place, key, core, n).

    A place is a block of at most ``most`` right rows, or one of its refinements that is small enough,
    or a stretch of the sorted finest refinement: there left rows stand in one stretch of ``most``, right rows also in the two beside it.
    """
    right = rows.filter("side <> 0")
    place = F.lit(None).cast("string")
    for level in ("finest", "finer", "block"):
        wide = right.groupBy(level).agg(F.count("*").alias("size")).filter(F.col("size") > most).select(level, F.lit(True).alias(f"wide_{level}"))
        rows = rows.join(wide, level, "left")  # few blocks are too common
        place = F.when(F.col(f"wide_{level}").isNull(), F.col(level)).otherwise(place)
    stored = persist_table(rows.select("side", place.alias("place"), "finest", "key", "core", "n"), "places")
    columns = ["place", "key", "core", "n"]
    rest = stored.filter("place is null").withColumn("stretch", F.floor(F.row_number().over(Window.partitionBy("finest").orderBy("core", "key", "side")) / most))
    at = lambda c: F.concat_ws("/", "finest", c.cast("string")).alias("place")
    one = rest.filter("side <> 1").select(at(F.col("stretch")), *columns[1:])
    beside = rest.filter("side <> 0").withColumn("stretch", F.explode(F.sequence(F.col("stretch") - 1, F.col("stretch") + 1))).select(at(F.col("stretch")), *columns[1:])
    small = stored.filter("place is not null")
    return small.filter("side <> 1").select(*columns).unionByName(one), small.filter("side <> 0").select(*columns).unionByName(beside)


def resembling(left: DataFrame, right: DataFrame, least: float, shortest: int, most: int, fold: bool) -> DataFrame:
    """Pairs (key_a, n_a, key_b, n_b, ratio) of left and right cores (key, initial, core, n) that share a suffix and resemble each other."""
    if left is right:
        rows = blocks(right, shortest, fold).withColumn("side", F.lit(2))
    else:
        rows = blocks(left, shortest, fold).withColumn("side", F.lit(0)).unionByName(blocks(right, shortest, fold).withColumn("side", F.lit(1)))
    a, b = placed(persist_table(rows, "blocks"), most)
    a, b = (x.select("place", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "core", "n")]) for x, side in ((a, "a"), (b, "b")))
    pairs = a.hint("merge").join(b, "place").filter("key_a <> key_b").drop("place").distinct()

    def make():
        def step(c):
            return {k: c[k] for k in ("key_a", "n_a", "key_b", "n_b")} | {"ratio": [lcs_ratio(x, y) for x, y in zip(c["core_a"], c["core_b"])]}

        return step

    return map_batches(pairs, make, "key_a string, n_a long, key_b string, n_b long, ratio double").filter(F.col("ratio") >= least)


def linked(pairs: DataFrame, one_edit: float) -> DataFrame:
    """(key, grp): the groups of the cores of resembling pairs: components of the links to the most frequent core and of those a single edit apart."""
    up = pairs.filter("n_b > n_a or (n_b = n_a and key_b < key_a)")
    followed = up.groupBy("key_a").agg(F.max_by("key_b", F.struct("n_b", "ratio", "key_b")).alias("b")).select(F.col("key_a").alias("a"), "b")
    close = pairs.filter(F.col("ratio") >= one_edit).filter("key_a > key_b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return components(followed.unionByName(close)).select(F.col("a").alias("key"), F.col("b").alias("grp"))


def name_groups(meme_people: DataFrame, memes: DataFrame | None = None, least: float = 0.8, shortest: int = 4, most: int = 400, one_edit: float = 0.88) -> DataFrame:
    """(person_name, grp): the group of every distinct name."""
    spark = meme_people.sparkSession
    names = meme_people.filter(F.length(F.trim("person_name")) > 0).groupBy("person_name").agg(F.count("*").alias("n"))
    common = spark.sparkContext.broadcast(common_parts(names))

    def split(column):
        def make():
            parser = Parser(common.value)

            def step(c):
                got = [parser.parse(x) for x in c[column]]
                return c | {"initial": [i for i, _ in got], "core": [k for _, k in got]}

            return step

        return make

    parsed = persist_table(map_batches(names, split("person_name"), "person_name string, n long, initial string, core string").filter("core <> ''").withColumn("key", F.concat_ws("|", "initial", "core")), "names")
    cores = persist_table(parsed.groupBy("key", "initial", "core").agg(F.sum("n").alias("n")), "cores")
    known = cores.filter("initial not in ('', '!')")
    pairs = persist_table(resembling(known, known, least, shortest, most, False), "pairs")
    link = persist_table(known.hint("merge").join(linked(pairs, one_edit), "key", "left").select("key", "n", F.coalesce("grp", "key").alias("to")), "name-links")
    # names without a first name: the bearers of the most similar core, if one of them is clearly the most frequent
    near = resembling(cores.filter("initial = ''"), known, 0.86, shortest, most, True)
    bearers = near.select("key_a", F.col("key_b").alias("key"), "ratio", "n_b").hint("merge").join(link.select("key", "to"), "key").groupBy("key_a", "to").agg(F.sum("n_b").alias("n_b"))
    of = bearers.groupBy("key_a").agg(F.max(F.struct("n_b", "to")).alias("best"), F.sum("n_b").alias("all"))
    base = persist_table(of.filter("best.n_b >= 0.6 * all").select(F.col("key_a").alias("key"), F.col("best.to").alias("base")), "name-bearers")
    groups = parsed.hint("merge").join(link.select("key", "to"), "key", "left").join(base, "key", "left")
    if memes is not None:
        full = map_batches(stated_aliases(memes), split("full"), "alias string, full string, n long, initial string, core string").withColumn("key", F.concat_ws("|", "initial", "core"))
        stated = full.hint("merge").join(link.select("key", F.col("to").alias("of")), "key").groupBy("alias", "of").agg(F.sum("n").alias("n")).groupBy("alias").agg(F.max_by("of", F.struct("n", "of")).alias("of"))
        groups = groups.hint("merge").join(stated.withColumnRenamed("alias", "person_name"), "person_name", "left")
        return groups.select("person_name", F.when(F.col("initial").isin("", "!"), F.coalesce("of", "to", "base", "key")).otherwise(F.coalesce("to", "key")).alias("grp"))
    return groups.select("person_name", F.coalesce("to", "base", "key").alias("grp"))


def name_pairs(meme_people: DataFrame, memes: DataFrame | None = None) -> DataFrame:
    """(name_a, name_b): all pairs of different names of a group, smaller name first by code point."""
    g = persist_table(name_groups(meme_people, memes), "name-groups")
    a, b = g.select(F.col("person_name").alias("name_a"), "grp"), g.select(F.col("person_name").alias("name_b"), "grp")
    return a.join(b, "grp").filter("name_a < name_b").select("name_a", "name_b")
