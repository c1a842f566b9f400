"""Problem 4 against brute force."""

from datetime import datetime

import numpy as np

from motleydex.llm.neighbors import ascend, branch_strings, common_prefix, forest_plan, meeting, run_pairs, similar_pairs, similar_vectors

SCHEMA = "aspect string, meme_id string, embedding array<float>, created_at timestamp_ntz, v int, tree string"


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((500, 64))
    v = np.concatenate([centres + 0.3 * k / 5 * rng.standard_normal((500, 64)) for k in range(6)]) * rng.uniform(0.3, 3, (3000, 1))
    df = spark.createDataFrame([("main", f"{i:05}", x.tolist(), None, 1, "x") for i, x in enumerate(v)], SCHEMA)
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    expected = {tuple(sorted((i, int(j)))) for i in range(len(v)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.85}
    for options in ({}, {"run_rows": 700}, {"run_rows": 700, "most_tasks": 3}):
        got = {(int(r.id_a), int(r.id_b)) for r in similar_pairs(df, **options).collect()}
        assert len(got & expected) >= 0.97 * len(expected) and len(got - expected) <= 0.01 * len(expected)


def test_defined_cases(spark):
    one = [1.0] + [0.0] * 63
    near = [1.0, 0.1] + [0.0] * 62
    far = [0.0] * 63 + [1.0]
    rows = [
        ("main", "a", one, datetime(2024, 1, 2), 1, "x"),
        ("main", "a", far, datetime(2024, 1, 1), 1, "x"),
        ("main", "b", near, None, 1, "x"),
        ("main", "b", near, None, 1, "x"),
        ("people", "c", one, None, 1, "x"),
        ("main", "d", [0.0] * 64, None, 1, "x"),
        ("main", "e", [1.0] * 3, None, 1, "x"),
        ("main", "f", None, None, 1, "x"),
        ("main", "g", [float("nan")] * 64, None, 1, "x"),
        ("main", "h", [None] * 64, None, 1, "x"),
        ("main", "i", [float("inf")] + [1.0] * 63, None, 1, "x"),
        ("main", None, one, None, 1, "x"),
    ]
    assert [tuple(r) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [("main", "a", "b")]
    assert similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_large_group_of_copies_stays_linear(spark):
    df = spark.range(2000).selectExpr("'main' aspect", "cast(id as string) meme_id", "transform(sequence(1, 64), x -> cast(x as float)) embedding", "cast(null as timestamp_ntz) created_at")
    got = similar_vectors(df)
    assert got.count() == 10_000 and got.selectExpr("max(rank)").first()[0] == 5


def test_members_of_a_large_group_get_the_smallest_ids(spark):
    rng = np.random.default_rng(4)
    one, near = (np.array([1.0] + [0.0] * 62 + [x]) for x in (0.0, 0.3))
    ids = [f"{i:05}" for i in rng.permutation(4000)]
    v = [one if i < 3000 else near if i < 3900 else rng.standard_normal(64) for i in range(4000)]
    rows = [("main", i, (x * rng.uniform(1, 2) if n > 3990 else x).tolist(), None, 1, "x") for n, (i, x) in enumerate(zip(ids, v))]
    got = {}
    for r in similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbour
    for members in (ids[:3000], ids[3000:3900]):
        least = sorted(members)[:6]
        for i in members:
            assert [got[i][r] for r in range(1, 6)] == [x for x in least if x != i][:5]


def test_copies_of_a_neighbour_are_taken_by_id(spark):
    one, near = [1.0] + [0.0] * 63, [1.0, 0.1] + [0.0] * 62
    rows = [("main", i, one, None, 1, "x") for i in ("b", "d")] + [("main", i, near, None, 1, "x") for i in ("a", "c", "e", "f", "g", "h", "i")]
    got = {i: [] for i in "abcdefghi"}
    for r in sorted(similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["rank"]):
        got[r.id].append(r.neighbour)
    assert got["b"] == ["d", "a", "c", "e", "f"] and got["d"] == ["b", "a", "c", "e", "f"]
    assert got["a"] == ["c", "e", "f", "g", "h"] and got["i"] == ["a", "c", "e", "f", "g"]


def near_pairs(rng, n, cosine, m):
    """Unit vectors of which the first m and the last m are partners of the given cosine."""
    v = rng.standard_normal((n, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.standard_normal((m, 64)).astype(np.float32)
    w -= (w * v[:m]).sum(1, keepdims=True) * v[:m]
    v[-m:] = cosine * v[:m] + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    return v


def test_a_run_of_full_size_finds_pairs_at_the_planned_rate():
    run, _, _, branches, candidates = forest_plan(27_000_000)
    assert run == 393_216
    v = near_pairs(np.random.default_rng(8), run, 0.88, 3000)
    i, j, cos = run_pairs(v, 5, branches, candidates, 0.85)
    found = set(zip(i.tolist(), j.tolist()))
    assert sum((k, run - 3000 + k) in found for k in range(3000)) >= 0.94 * 3000
    assert (cos >= 0.85 - 1e-6).all() and (i < j).all()


def test_ascent_stops_at_the_longest_prefix_with_enough_candidates():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 64)).astype(np.float32)
    strings = [branch_strings(v, 3, b) for b in range(4)]
    orders = np.stack([np.argsort(s) for s in strings]).astype(np.int32)
    shared = np.stack([common_prefix(s[o]) for s, o in zip(strings, orders)])
    start, end = ascend(orders, shared, 40)
    depth = 62
    for x in range(0, 300, 7):
        groups = [[sum((int(s[x]) ^ int(y)) >> (depth - length) == 0 for y in s) - 1 for s in strings] for length in range(depth + 1)]
        stop = max(length for length in range(depth + 1) if sum(groups[length]) >= 40)
        for b in range(4):
            at = int(np.flatnonzero(orders[b] == x)[0])
            assert end[b, at] - start[b, at] - 1 == groups[stop][b]
            assert all((int(strings[b][x]) ^ int(strings[b][y])) >> (depth - stop) == 0 for y in orders[b][start[b, at] : end[b, at]])


def test_plan_counts_both_losses():
    run, trees, _, branches, candidates = forest_plan(0)
    assert (run, trees, candidates) == (2048, 3, 170 * branches) and forest_plan(100_000)[:2] == (25_000, 3)
    for rows in (1_000_000, 27_000_000, 10**10):
        run, trees, bits, branches, _ = forest_plan(rows)
        branch = (1 - np.arccos(0.88) / np.pi) ** np.log2(run / 170)
        inside = 1 - (1 - branch) ** branches
        assert inside >= 0.95 and 1 - (1 - inside * meeting(0.88, max(0, bits - 1), 2)) ** trees >= 0.97
    assert forest_plan(27_000_000)[1] == 4
