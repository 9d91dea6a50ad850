import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gainsay.llm import nn_descent as N

SCHEMA = "vec_id long, embedding array<double>, label int, node long, n_links string"


def brute(rows, threshold=0.93):
    """Links by all pairs, components by union-find; pairs too close to the threshold to tell are not in the data."""
    ok = [v is not None and lab is not None and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    unit = [np.array(v) / np.abs(v).max() if o else None for (_, v, _), o in zip(rows, ok)]
    unit = [u / np.sqrt((u * u).sum()) if u is not None else None for u in unit]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i], n[j], parent[find(i)] = n[i] + 1, n[j] + 1, find(j)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    return sorted(((r[0], n[i], least.get(find(i)), None if r[0] is None else r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str)


def got(spark, rows):
    table = spark.createDataFrame([(i, v, lab, 5, "clash") for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in N.dedup(table).collect()), key=str)


def clusters(seed, n, dims, spreads, sizes):
    r = np.random.default_rng(seed)
    x = [r.standard_normal(dims) for _ in range(n)]
    labels = r.integers(0, 3, n).tolist()
    for spread, size in zip(spreads, sizes):
        centre, label = r.standard_normal(dims), int(r.integers(0, 3))
        x += [centre + spread * r.standard_normal(dims) for _ in range(size)]
        labels += [label] * size
    order = r.permutation(len(x))
    return [(int(7 + k), (x[i] * r.uniform(0.1, 9)).tolist(), labels[i]) for k, i in enumerate(order)]


def test_dedup_equals_all_pairs(spark):
    # Pairs, tight groups that become balls, wide ones at the threshold that don't, copies, and a group in two labels.
    rows = clusters(1, 400, 48, [0.02, 0.05, 0.1, 0.27, 0.24, 0.2, 0.1], [2, 40, 160, 60, 25, 9, 3])
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(30)] + [(2000 + k, rows[1][1], (rows[1][2] + k % 2) % 3) for k in range(10)]
    assert got(spark, rows) == brute(rows)


def test_balls_are_looked_into(spark, monkeypatch):
    # Two tight groups with an angle between them at which some of their pairs link.
    r = np.random.default_rng(4)
    a = r.standard_normal(32)
    side = r.standard_normal(32)
    side -= a * (a @ side) / (a @ a)
    b = math.cos(0.375) * a / np.linalg.norm(a) + math.sin(0.375) * side / np.linalg.norm(side)
    rows = [(k, v.tolist(), 1) for k, v in enumerate([c + 0.012 * r.standard_normal(32) for c in [a / np.linalg.norm(a)] * 40 + [b] * 40])]
    rows += [(100 + k, r.standard_normal(32).tolist(), 1) for k in range(100)]
    want = brute(rows)
    assert {n for _, n, _, _ in want} & set(range(40, 79))      # some pairs of the groups link, others don't
    assert got(spark, rows) == want


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 0.5], [1.0, 2.0, 0.51]
    rows = [(3, a, 1), (3, a, 1), (2, b, 1), (9, a, None), (8, None, 1), (7, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1), (5, [float("nan"), 1.0, 1.0], 1),
            (4, [float("inf"), 1.0, 1.0], 1), (None, a, 1), (10, a, 2), (11, [1.0, 2.0], 1), (12, [2e200, 4e200, 1e200], 2), (13, [1e-200, 2e-200, 5e-201], 2), (14, [], 1)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("dims", [8, 64, 1500])
def test_rounded_vectors_bound_the_angle(spark, dims):
    r = np.random.default_rng(dims)
    x = r.standard_normal((60, dims)) + 3 * r.standard_normal(dims)
    x[:, 0] *= 50
    table = spark.createDataFrame([(k, "1", v.tolist(), 0.0, 8) for k, v in enumerate(x)], "node long, label string, v array<double>, radius double, k int")
    rows = sorted(N.rounded(table).collect())
    q = np.stack([np.frombuffer(row["q"], dtype=np.int8) for row in rows])
    s, e = (np.array([row[c] for row in rows], dtype=np.float32) for c in "se")
    u, v, gap, low, _ = N._best(np.arange(60), np.ones(60, dtype=bool), q, s, e, np.zeros(60), np.full(60, 60), np.full(60, 10.0))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = np.arccos(np.clip((unit[u] * unit[v]).sum(axis=1), -1, 1))
    assert len(u) == 60 * 59 and (low <= exact + 1e-9).all() and (dims > 100 or (low >= exact - 0.3).all())


def test_lists_grow_and_the_audit_finds_what_is_missing(spark, monkeypatch):
    monkeypatch.setattr(N, "CONTRACTIONS", 0)       # only longer lists help
    monkeypatch.setattr(N, "TREES", 1)
    rows = clusters(2, 300, 24, [0.1, 0.15], [60, 21])
    assert got(spark, rows) == brute(rows)
