"""Problems 2 and 3 against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import p2_neighbours, p3_near_copies

VEC = "run_id bigint, row_id bigint, embedding array<float>, rank int, cell int"
RUN = "run_id bigint, embedding_dimension int, part int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = []
    for run, n in ((1, 400), (2, 60), (3, 3)):
        for i in range(n):
            v = centres[rng.integers(12)] + 0.5 * rng.normal(size=16)
            rows.append((run, i + 1, [float(x) for x in v], 0, 0))
    hot = rows[5][2]
    rows += [(1, 1000 + i, hot, 0, 0) for i in range(150)]  # one vector many times
    rows += [rows[7], (1, 2000, None, 0, 0), (1, 2001, [1.0], 0, 0), (1, 2002, [0.0] * 16, 0, 0), (1, 2003, [float("nan")] * 16, 0, 0), (9, 1, [1.0] * 16, 0, 0), (None, 1, hot, 0, 0), (1, None, hot, 0, 0)]
    return spark.createDataFrame(rows, VEC), spark.createDataFrame([(1, 16, 0), (2, 16, 0), (3, 16, 0), (4, None, 0), (None, 16, 0)], RUN), rows


def brute(rows, k=5):
    out = {}
    for run in (1, 2, 3):
        d = {r[1]: r[2] for r in rows if r[0] == run and r[1] is not None and r[2] is not None and len(r[2]) == 16 and np.isfinite(r[2]).all() and any(r[2])}
        ids = sorted(d)
        x = np.array([d[i] for i in ids], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 10)
        for a, i in enumerate(ids):
            out[run, i] = [j for _, j in sorted((-s[a, b], j) for b, j in enumerate(ids) if j != i)[:k]]
    return out


def near(df):
    got = {}
    for r in df.orderBy("rank").collect():
        got.setdefault((r.run_id, r.row_id), []).append(r.other)
    return got


def test_exact_with_factor_one(vectors):
    v, runs, rows = vectors
    assert near(p2_neighbours.neighbours(v, runs, factor=1.0)) == brute(rows)


def test_many_shards_and_recall(vectors, monkeypatch):
    v, runs, rows = vectors
    monkeypatch.setattr(p2_neighbours, "SHARD", 60)
    monkeypatch.setattr(p2_neighbours, "QUERIES", 100)
    monkeypatch.setattr(p2_neighbours, "LEAF", 10)
    want = brute(rows)
    assert near(p2_neighbours.neighbours(v, runs, factor=1.0)) == want
    got = near(p2_neighbours.neighbours(v, runs))
    hits = sum(len(set(got[k]) & set(want[k])) for k in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(r.recall >= 0.9 for r in p2_neighbours.recall(v, runs, every=10).collect())


def test_found_and_empty(spark, vectors):
    v, runs, rows = vectors
    want = {(run, min(i, j), max(i, j)) for (run, i), js in brute(rows).items() for j in js}
    assert {tuple(r) for r in p2_neighbours.found(v, runs).collect()} == want
    assert p2_neighbours.found(v.limit(0), runs).count() == 0 and p2_neighbours.found(v, runs.limit(0)).count() == 0


WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        w = [rng.choice(WORDS) for _ in range(rng.randint(50, 300))]
        rows.append((0, i, " ".join(w)))
        for k in range(i % 4):  # edits, moves, exact copies
            x = list(w)
            for _ in range(k * len(x) // 60):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            if k == 2:
                x = x[len(x) // 2 :] + x[: len(x) // 2]
            rows.append((0, 1000 + 10 * i + k, " ".join(x)))
    rows += [(1, 1, rows[0][2]), (1, 2, rows[0][2].upper()), (0, 5000, None), (0, 5001, ""), (0, 5002, "short text"), (0, None, rows[0][2]), rows[3], (0, 6000, "long " + " ".join(rng.choice(WORDS) for _ in range(40_000)))]
    rows += [(1, 100 + i, rows[8][2]) for i in range(30)]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "src int, id bigint, text string, n int, rep string"), rows


def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 50 else None


def brute_pairs(rows):
    s = {(a, b): shingles(t) for a, b, t in rows if b is not None}
    s = {k: v for k, v in s.items() if v}
    return {(a[0], a[1], b[1]) for a in s for b in s if a < b and a[0] == b[0] and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b]) - 1e-12}


def closure(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, a, b in pairs:
        x, y = find((s, a)), find((s, b))
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_pairs_equal_brute_force(texts):
    df, rows = texts
    want = brute_pairs(rows)
    got = {tuple(r) for r in p3_near_copies.NearCopies(df).pairs().collect()}
    big = {i for s, i, t in rows if s == 1 and 100 <= (i or 0)}  # more than FULL copies: linked to their representative
    inside = {p for p in want if p[0] == 1 and p[1] in big and p[2] in big}
    assert want - got <= inside and got <= want and {p for p in got if p[1] == 100 and p[2] in big} == {(1, 100, i) for i in big - {100}}


def test_groups_equal_closure(texts):
    df, rows = texts
    want = closure(brute_pairs(rows))
    got = {(r.src, r.id): (r.src, r.class_id) for r in p3_near_copies.NearCopies(df).groups().collect()}
    assert all(got[k] == want.get(k, k) for k in got) and set(want) <= set(got)


def test_hot_windows_lose_nothing(texts, monkeypatch):
    df, rows = texts
    monkeypatch.setattr(p3_near_copies, "SHARD", 2)
    got = {tuple(r) for r in p3_near_copies.NearCopies(df).pairs().collect()}
    assert brute_pairs([r for r in rows if r[0] == 0]) <= got


def test_heavy_windows_are_salted(spark, monkeypatch):
    monkeypatch.setattr(p3_near_copies, "HEAVY", 8)
    rng = random.Random(8)
    core = [f"c{i}" for i in range(60)]
    rows = [(0, i, " ".join(core + [f"x{rng.randrange(9)}" for _ in range(12)])) for i in range(60)]
    df = spark.createDataFrame(rows, "src int, id bigint, text string").coalesce(1)
    got = {tuple(r) for r in p3_near_copies.NearCopies(df).pairs().collect()}
    assert got == brute_pairs(rows) and len(got) > 1000


def test_texts_with_few_hot_windows_keep_them(spark, monkeypatch):
    monkeypatch.setattr(p3_near_copies, "SHARD", 3)
    rng = random.Random(2)
    rows = []
    for g in range(6):  # moved sentences: of 9 words only two windows of 8 survive, 22 %
        parts = [" ".join(f"g{g}w{rng.randrange(10_000)}" for _ in range(9)) for _ in range(22)]
        for i in range(5):
            rng.shuffle(parts)
            rows.append((0, 10 * g + i, " ".join(parts)))
    got = {tuple(r) for r in p3_near_copies.NearCopies(spark.createDataFrame(rows, "src int, id bigint, text string")).pairs().collect()}
    assert got == brute_pairs(rows) and len(got) == 60


def test_tree_drops_no_pair_above_the_threshold():
    rng = np.random.default_rng(0)
    sets = [rng.choice(3000, 120, replace=False) for _ in range(40)]
    sets += [np.r_[s[:110], rng.choice(3000, 10)] for s in sets[:20]]
    sh = np.concatenate([np.unique(s) for s in sets]).astype(np.uint64) << np.uint64(20)
    doc = np.concatenate([np.full(len(np.unique(s)), i) for i, s in enumerate(sets)])
    size = np.bincount(doc)
    group = np.repeat([0, 1], [30, 30])[np.arange(60) % 60]
    o = np.lexsort((size, group))
    a, b = p3_near_copies.tree_pairs(group[o], size[o].astype(np.int64), p3_near_copies.bitmaps(sh, doc, 60)[o])
    got = {frozenset((o[i], o[j])) for i, j in zip(a, b)}
    q = [set(s.tolist()) for s in sets]
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if group[i] == group[j] and len(q[i] & q[j]) >= 0.6 * len(q[i] | q[j])}
    assert want <= got and len(got) < 60 * 59 / 8


def test_long_texts_on_one_window_are_no_candidates(spark):
    rng = random.Random(4)
    core = [f"c{i}" for i in range(40)]
    rows = [(0, i, " ".join(core + [f"w{rng.randrange(50_000)}" for _ in range(900 + 10 * i)])) for i in range(60)]
    for i in range(5):  # near copies, one of them twice as wide as its original
        w = rows[i][2].split() + [f"y{k}" for k in range(150)]
        rows.append((0, 100 + i, " ".join(w[:70] + w[90:])))
    reps = p3_near_copies.describe(spark.createDataFrame(rows, "src int, id bigint, text string"))
    assert {(r.src, r.a, r.b) for r in p3_near_copies.candidates(reps).collect()} == brute_pairs(rows) == {(0, i, 100 + i) for i in range(5)}


def test_matrices_leave_what_the_tree_leaves(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [rng.choice(9000, rng.integers(50, 1200), replace=False) for _ in range(300)]
    sets += [np.unique(np.r_[s[: int(rng.uniform(0.6, 1) * len(s))], rng.choice(9000, 20)]) for s in sets]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    sh, doc = np.concatenate(sets).astype(np.uint64) << np.uint64(20), np.repeat(np.arange(600), size)
    side = rng.integers(0, 2, 600)
    args = (np.zeros(600, np.int64), size, p3_near_copies.bitmaps(sh, doc, 600), side)
    wide = p3_near_copies.Wide.of(sh, doc, size)
    got = [set(zip(*p3_near_copies.tree_pairs(*args, wide=w))) for w in (None, wide)]
    monkeypatch.setattr(p3_near_copies, "MATRIX_PAIRS", 1 << 40)
    assert got == [set(zip(*p3_near_copies.tree_pairs(*args, wide=w))) for w in (None, wide)] and got[1] < got[0]
    q = [set(s.tolist()) for s in sets]
    assert {(i, j) for j in range(600) for i in range(j) if side[i] != side[j] and len(q[i] & q[j]) >= 0.6 * len(q[i] | q[j])} <= got[1]


def test_components(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 7, 3), (0, 9, 10), (1, 1, 5)] + [(0, 20 + i, 21 + i) for i in range(12)], "src int, a bigint, b bigint")
    got = {(r.src, r.id): r.label for r in p3_near_copies.components(e).collect()}
    assert got[0, 7] == 1 and got[0, 10] == 9 and got[1, 5] == 1 and got[0, 32] == 20
    assert p3_near_copies.components(e.limit(0)).count() == 0


def test_empty(spark, texts):
    df, _ = texts
    n = p3_near_copies.NearCopies(df.limit(0))
    assert n.pairs().count() == 0 and n.groups().count() == 0
    assert p3_near_copies.NearCopies(df.filter(F.length("text") < 100)).pairs().count() == 0
