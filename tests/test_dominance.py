import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from gainsay.operators import dominance, grouped, inversions, verify
from tests import brute

NAMES, CLASSES = ["id", "g", "s", "t", "r", "a", "b", "d"], ["INTEGER", "INTEGER", "STRING", "STRING", "REAL", "INTEGER", "REAL", "INTEGER"]
SCHEMA = "id int, g int, s string, t string, r double, a int, b double, d bigint"


def data(seed, n, shape="ties"):
    """Ties, NaN and nulls; ``rising``: nearly no violation of all-opposite orderings; one key holds most rows."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = 0 if rnd.random() < 0.8 else rnd.randint(0, 3)
        x = rnd.randint(0, 8) if shape == "ties" else i
        out.append((i, g, rnd.choice("aab"), rnd.choice([None, "u", "NaN"]), rnd.choice([1.0, 1.0, -0.0, 0.0, math.nan, None]),
                    x + (rnd.randint(0, 8) if shape == "ties" else 0), rnd.choice([math.nan, -1.5, 2.0, 2.5]) if shape == "ties" and rnd.random() < .5 else float(x),
                    (1 << 60) + (rnd.randint(0, 5) if shape == "ties" else x)))
    return out


SHAPES = [[("g", "=="), ("a", "<"), ("b", ">"), ("d", "<")], [("g", "=="), ("a", "<="), ("b", "<="), ("d", ">=")], [("a", "<"), ("b", "<="), ("d", "<")],
          [("g", "=="), ("a", ">"), ("b", "<"), ("d", ">="), ("id", "<")], [("g", "=="), ("a", "<="), ("b", "<="), ("d", "<="), ("id", ">")],
          [("g", "=="), ("s", "!="), ("a", "<"), ("b", ">=")], [("g", "=="), ("r", "!="), ("a", "<=")], [("g", "=="), ("s", "!="), ("t", "!="), ("a", ">")],
          [("g", "=="), ("r", "!="), ("s", "!="), ("a", "<="), ("b", ">="), ("d", "<=")], [("r", "!="), ("t", "!="), ("d", "<=")], [("g", "=="), ("t", "!="), ("a", "<="), ("d", "<=")]]


@pytest.mark.parametrize("shape", ["ties", "rising"])
@pytest.mark.parametrize("dc", SHAPES, ids=str)
def test_rows_of_any_shape(spark, monkeypatch, dc, shape):
    monkeypatch.setattr(dominance, "PIECE", 6)
    monkeypatch.setattr(dominance, "COARSE", 2)
    monkeypatch.setattr(dominance, "SPREAD", 3)
    rows = data(len(dc), 110, shape) + ([data(1, 9)[k % 9] for k in range(18)] if shape == "ties" else [])      # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    enc = [tuple(brute.encode(v, c) for v, c in zip(r, CLASSES)) for r in rows]
    want = sorted(rows[i][0] for i in {i for p in brute.violating(enc, [(NAMES.index(c), o) for c, o in dc]) for i in p})
    assert sorted(r.id for r in verify.violating_rows(df, dc).collect()) == want


def test_no_rows_and_no_pairs_in_the_plan(spark):
    dc = [("g", "=="), ("a", "<"), ("b", ">"), ("d", "<")]
    df = spark.createDataFrame(data(1, 40), SCHEMA)
    assert verify.violating_rows(df.where("false"), dc).collect() == [] and verify.holds(df.limit(1), dc)
    plan = verify.violating_rows(df, dc)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("slab,merged", [(1 << 17, 1 << 20), (9, 12), (40, 10)])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_rising_pairs(spark, monkeypatch, slab, merged, keys):
    monkeypatch.setattr(inversions, "SLAB", slab)
    monkeypatch.setattr(inversions, "MERGED", merged)
    rnd = random.Random(slab)
    points = [(0 if rnd.random() < 0.9 else rnd.randint(1, 30), 7 if rnd.random() < 0.4 else rnd.randint(0, 60), 1.5 if rnd.random() < 0.3 else rnd.uniform(0, 9), rnd.choice([1, 2, 10**10]))
              for _ in range(300)]
    df = spark.createDataFrame(points, "g int, v int, w double, c long").groupBy("g", "v", "w").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c")
    if not keys:
        df = df.drop("g").groupBy("v", "w").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c")
    held = df.collect()
    want = sum(p.c * q.c for p in held for q in held if (not keys or p.g == q.g) and p.v < q.v and p.w < q.w)
    assert int(inversions.rising(df, keys, "v", "w").first().rising) == want


def test_ascents_by_brute_force():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 200):
        rank, weight = r.integers(0, max(1, n // 2), n), r.integers(1, 5, n)
        assert inversions.ascents(rank, weight) == sum(int(weight[i] * weight[j]) for i, j in itertools.combinations(range(n), 2) if rank[i] < rank[j])


def test_tasks_take_whole_groups_of_bounded_size():
    """A task once kept each of a million points in arrays of its group."""
    sizes = [3, 1, 40, 2, 2, 2, 1, 7, 5, 5, 1]
    keys = np.repeat(np.arange(len(sizes)) % 4, sizes)
    rows = pa.record_batch({"k": [f"k{k}" for k in keys], "n": np.repeat(np.arange(len(sizes)), sizes), "i": np.arange(len(keys))})
    got = list(grouped.whole_groups((rows.slice(k, 4) for k in range(0, len(keys), 4)), 2, 8))
    assert [i for _, part in got for i in part.column(2).to_pylist()] == list(range(len(keys)))
    for group, part in got:
        n = part.column(1).to_numpy()
        assert (np.diff(group) == (np.diff(n) != 0)).all() and (len(part) <= 8 + 4 or 2 in n)
    held = [set(part.column(1).to_pylist()) for _, part in got]
    assert sum(map(len, held)) == len(sizes)


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_small_groups_are_counted_alike(monkeypatch, few):
    monkeypatch.setattr(inversions, "FEW", few)
    r = np.random.default_rng(2)
    g = np.sort(r.integers(0, 40, 300))
    v, w, c = r.integers(0, 9, 300), r.integers(0, 9, 300).astype(float), r.integers(1, 5, 300)
    want = sum(int(c[i] * c[j]) for i in range(300) for j in range(300) if g[i] == g[j] and v[i] < v[j] and w[i] < w[j])
    assert inversions._counted(g, v, w, c) == want


def test_small_groups_need_no_pieces(spark, monkeypatch):
    """Every group once became a piece with a box that met all boxes of its group, once for each role."""
    monkeypatch.setattr(dominance, "hits", None)
    df = spark.range(400).selectExpr("id", "id DIV 40 AS g", "id % 7 AS a", "CAST(id % 5 AS DOUBLE) AS b", "-id AS d", "CAST(id % 2 AS STRING) AS s")
    for dc in ([("g", "=="), ("a", "<"), ("b", ">"), ("d", "<")], [("g", "=="), ("s", "!="), ("a", "<="), ("d", ">")]):
        rows = [tuple(r) for r in df.collect()]
        want = sorted(rows[i][0] for i in {i for p in brute.violating(rows, [(df.columns.index(c), o) for c, o in dc]) for i in p})
        assert sorted(r.id for r in verify.violating_rows(df, dc).collect()) == want


def test_points_that_few_others_violate_with():
    r = np.random.default_rng(3)
    group = np.repeat([0, 1, 2], [300, 60, 5])
    a = np.arange(len(group))
    b = a.astype(float)
    b[[7, 290, 310]] = [250.5, 20.5, 350.5]
    u = r.integers(0, 2, len(group))
    beats = (group[:, None] == group) & (a[:, None] < a) & (b[:, None] >= b) & (u[:, None] != u)
    want = beats.any(axis=0) | beats.any(axis=1)
    assert 0 < want.sum() < len(group) and (dominance._met(group, np.zeros(len(group), dtype=bool), [a, b], ["<", ">="], [u]) == want).all()


def test_pieces_are_read_by_points(monkeypatch):
    """A task once took all pieces of an Arrow batch apart at once, thousands of points each."""
    monkeypatch.setattr(dominance, "SLICE", 10)
    sizes = [4, 4, 4, 25, 1, 9, 1, 10, 3]
    batch = pa.record_batch({"id": list(range(len(sizes))), "points": pa.array([[0] * n for n in sizes])})
    got = [part.column(0).to_pylist() for part in dominance._slices(iter([batch.slice(0, 2), batch.slice(2)]), 1)]
    assert got == [[0, 1], [2], [3], [4, 5], [6], [7], [8]]
