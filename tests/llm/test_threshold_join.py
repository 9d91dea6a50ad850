import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gainsay.llm import threshold_join as T

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, rank int"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, _, v in rows]
    if not lengths:
        return []
    most = min(set(lengths), key=lambda d: (-lengths.count(d), d))
    rows = [r for r in rows if len(r[2]) == most]
    out = []
    for a in sorted({i for i, _, _ in rows if i % 10 == 0}):
        _, label, own = min((r for r in rows if r[0] == a), key=lambda r: (r[1], r[2]))
        scored = sorted((-sum(x * y for x, y in zip(own, v)), i, lab) for i, lab, v in rows if i != a or lab != label)
        near = [(-s, i) for s, i, lab in scored if lab == label][:positives]
        for ps, p in near:
            fits = [(-s, i) for s, i, lab in scored if lab != label and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i) in enumerate(fits)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash", 1) for i, v, lab in rows], SCHEMA).repartition(3)


def mined(spark, rows):
    return sorted(tuple(r) for r in T.mine(table(spark, rows), F.col("vec_id") % 10 == 0).collect())


@pytest.mark.parametrize("seed,dims,sample", [(1, 64, 4096), (2, 20, 30), (3, 5, 0), (4, 40, 60)])
def test_mine_equals_all_scores(spark, monkeypatch, seed, dims, sample):
    monkeypatch.setattr(T, "SAMPLE", sample)
    monkeypatch.setattr(T, "SLICE_BYTES", 8 * dims * (7 if seed % 2 else 1000))
    r = np.random.default_rng(seed)
    centre = r.standard_normal(dims)
    x = r.standard_normal((300, dims)) * np.geomspace(1, 0.05, dims) + 0.4 * centre
    x[::3] = x[0] + 0.01 * r.standard_normal((100, dims))           # a third are near copies
    x[5::30] = x[5]                                                   # exact ones, which tie
    rows = [(i, v, int(lab)) for i, (v, lab) in enumerate(zip(x.tolist(), r.choice(5, 300, p=[.5, .2, .1, .1, .1])))]
    rows += [(1000, [0.0] * dims, 1), (1010, (10 * x[1]).tolist(), 9), (1020, (-x[2]).tolist(), 2)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(10, [1.0, 0.5], 1), (10, [1.0, 0.4], 1), (11, [1.0, 0.5], 1), (11, [1.0, 0.5], 1), (12, [0.5, 0.2], 2), (12, [0.5, 0.2], 2), (None, [1.0, 1.0], 1),
            (13, None, 1), (14, [1.0, None], 1), (15, [float("nan"), 1.0], 2), (16, [float("inf"), 1.0], 2), (17, [0.5, 0.3], None), (18, [1.0], 2),
            (20, [0.0, 0.0], 3), (21, [1.0, 1.0], 3), (22, [0.0, 0.0], 4), (30, [-1.0, 0.0], 5), (31, [1.0, 0.0], 5), (40, [0.3, 0.3], 7)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(10, None, 1)]) == [] and mined(spark, [(10, [], 1), (11, [], 1)]) == []


def test_pruning_keeps_all_pairs_above_the_floor():
    r = random.Random(5)
    g = np.random.default_rng(5)
    for dims in (3, 16, 50):
        x, w = (np.floor(256 * g.standard_normal((n, dims)) * np.geomspace(1, 0.01, dims)).astype(np.int64) for n in (400, 30))
        exact = w @ x.T
        floor = np.array([np.sort(row)[-r.choice([1, 5, 40])] for row in exact], dtype=np.float64)
        length = np.sqrt((w.astype(float) ** 2).sum(axis=1))
        index = T.Index(x, float((floor / length).min()))
        got = {(int(a), int(b)) for qi, xi in index.pairs(w, floor) for a, b in zip(qi, xi)}
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(exact >= floor[:, None]))}
        assert want <= got and len(got) < exact.size / 2
        assert dims < 50 or (index.posted < index.rest.shape[1] - 1).any()      # suffixes are left out
