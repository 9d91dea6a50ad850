import itertools
import math
import random

import pytest

from gainsay.operators import verify
from tests import brute


def data(seed=3, n=70, hot=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = 0 if hot and rnd.random() < 0.7 else rnd.randint(0, 4)      # one key holds most rows
        out.append((i, g, rnd.choice("abc"), rnd.choice([None, "u", "v"]), rnd.choice([1.0, 2.0, 3.5, math.nan, None]), rnd.randint(0, 9)))
    return out


SCHEMA = "id int, g int, s string, t string, r double, q int"
CLASSES = ["INTEGER", "INTEGER", "STRING", "STRING", "REAL", "INTEGER"]
NAMES = ["id", "g", "s", "t", "r", "q"]


def check(spark, rows, dc):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    enc = [tuple(brute.encode(v, c) for v, c in zip(r, CLASSES)) for r in rows]
    return df, brute.violating(enc, [(NAMES.index(c), o) for c, o in dc])


COUNTS = [[("g", "==")], [("g", "=="), ("s", "!=")], [("g", "=="), ("s", "!="), ("t", "!=")], [("g", "=="), ("r", "!=")],
          [("r", "=="), ("s", "!=")], [("g", "=="), ("r", "<")], [("g", "=="), ("r", "<="), ("s", "!=")], [("q", ">=")],
          [("s", "!=")], [("g", "=="), ("s", "=="), ("r", "!="), ("q", ">")]]
COUNTS += [[("g", "=="), ("r", a), ("q", b)] for a, b in itertools.product(("<", "<=", ">", ">="), repeat=2)]
COUNTS += [[("id", "<"), ("q", ">")], [("g", "=="), ("s", "!="), ("q", "<="), ("id", ">")], [("g", "=="), ("s", "!="), ("r", "!="), ("q", "<"), ("id", "<=")]]


@pytest.mark.parametrize("dc", COUNTS, ids=str)
def test_counts(spark, dc):
    df, pairs = check(spark, data(), dc)
    assert int(verify.violation_count(df, dc).first().violations) == len(pairs)


ROWS = [[("g", "==")], [("g", "=="), ("s", "!=")], [("g", "=="), ("r", "!=")], [("g", "=="), ("s", "!="), ("t", "!=")],
        [("g", "=="), ("r", "<")], [("r", ">=")], [("g", "=="), ("s", "!="), ("q", ">")], [("s", "!="), ("r", "<=")]]
ROWS += [[("g", "=="), ("r", a), ("q", b)] for a, b in itertools.product(("<", "<=", ">", ">="), repeat=2)]
ROWS += [[("id", "<"), ("q", ">")], [("id", "<"), ("q", "<=")]]


@pytest.mark.parametrize("dc", ROWS, ids=str)
def test_rows(spark, dc):
    rows = data(11, 40)
    df, pairs = check(spark, rows, dc)
    want = sorted({i for p in pairs for i in p})
    assert sorted(r.id for r in verify.violating_rows(df, dc).collect()) == want
    assert verify.holds(df, dc) == (not want)


def test_marginals(spark):
    rows = data(5, 30)
    df, _ = check(spark, rows, [])
    enc = [tuple(brute.encode(v, c) for v, c in zip(r, CLASSES)) for r in rows]
    for r in verify.marginals(df).collect():
        want = len(brute.violating(enc, [(NAMES.index(r.col), r.op)]))
        assert int(r.pairs) == want and math.isclose(r.prob, want / (30 * 29))


def test_planted_violations(spark):
    df = spark.range(20000).selectExpr("id", "id % 50 AS k", "CASE WHEN id IN (17, 4021) THEN -1 ELSE id % 50 END AS v")
    got = verify.fd_violations(df, ["k"], "v").collect()
    assert sorted(r.k for r in got) == [17, 21] and {r.n_rows for r in got} == {400} and {int(r.pairs) for r in got} == {2 * 399}
    assert verify.holds(df, [("k", "=="), ("v", "!=")]) is False
    assert verify.holds(df.where("v >= 0"), [("k", "=="), ("v", "!=")])


def test_witnesses_are_violations(spark):
    rows = data(2, 60)
    for dc in ([("g", "=="), ("s", "!=")], [("g", "=="), ("q", "<")], [("g", "=="), ("r", ">")]):
        df, pairs = check(spark, rows, dc)
        got = [(r.x, r.y) for r in verify.violations(df, dc, "id").collect()]
        assert set(got) <= set(pairs) and sorted(x for x, _ in got) == sorted({x for x, _ in pairs})


def test_refused_shapes(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    for bad in ([("s", "<")], [("g", "~")], [("g", "=="), ("g", "!=")], [("nope", "==")], [("r", "<"), ("q", "<"), ("s", ">=")]):
        with pytest.raises(ValueError):
            verify.violating_rows(df, bad)
    with pytest.raises(ValueError):
        verify.violation_count(df, [("r", "<"), ("q", "<"), ("id", "<")])
