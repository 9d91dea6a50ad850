import math

import pytest

from gainsay import dependency_scores, discover, discover_many, discover_table
from gainsay.operators import pairs as P
from gainsay.operators import rows as R
from gainsay.plans import discover as D
from gainsay.sources.tables import inline_rows
from tests import brute

STAFF = [(1, "Alice", "New York", "NY", "10001", 95000), (2, "Bob", "New York", "NY", "10001", 80000),
         (3, "Charlie", "San Francisco", "CA", "94105", 120000), (4, "David", "San Francisco", "CA", "94105", 110000),
         (5, "Eve", "Los Angeles", "CA", "90001", 105000), (6, "Frank", "Los Angeles", "CA", "90001", 90000),
         (7, "Grace", "Miami", "FL", "33101", 85000), (8, "Heidi", "Miami", "FL", "33101", 88000),
         (9, "Ivan", "Chicago", "IL", "60601", 92000), (10, "Jack", "Chicago", "IL", "60601", 94000),
         (11, "Karl", "Boston", "MA", "02108", 97000), (12, "Linda", "Boston", "MA", "02108", 99000)]
STAFF_SCHEMA = "id int, name string, city string, state string, zip string, salary int"


def expected(spark, df, order, threshold, seed):
    rows = R.index_rows(df, order)
    end = D.batch_limit(rows.n, threshold * 0.01)
    data = [tuple(r[f"c{c.col_id}"] for c in rows.columns) for r in sorted(rows.values([c.col_id for c in rows.columns]).join(rows.df.select("rid"), "rid").collect(), key=lambda r: r.rid)]
    batches = [[] for _ in range(end)]
    for r in sorted(P.sample_pairs(spark, rows.n, end, 0, seed).collect(), key=lambda r: r.i):
        batches[r.batch].append((r.x, r.y))
    preds = [(p.col_id, p.op) for p in rows.predicates]
    names = [f"{p.col} {p.op}" for p in rows.predicates]
    found = brute.search(data, preds, batches, threshold * 0.01)
    return {frozenset(names[p] for p in s): v for s, v in found.items()}


def as_sets(result):
    return {frozenset(f"{p.col} {p.op}" for p in r.predicates): r.score for r in result.collect()}


def same(got, want):
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def table(spark):
    return spark.range(150).selectExpr(
        "id AS k", "id % 5 AS g", "concat('n', CAST(id % 5 AS STRING)) AS name",
        "CAST((id * 37) % 101 AS DOUBLE) AS v", "CAST((id * 37) % 101 AS DOUBLE) * 2 AS w",
        "CASE WHEN id % 10 = 3 THEN NULL ELSE CAST(id % 4 AS DOUBLE) END AS r", "1 AS one")


@pytest.mark.parametrize("threshold,seed", [(1e-2, 42), (1e-3, 7)])
def test_search_matches_depth_first_recomputation(spark, threshold, seed):
    df = table(spark)
    got = as_sets(discover(df, threshold, order_by=["k"], seed=seed))
    assert got
    same(got, expected(spark, df, ["k"], threshold, seed))


def test_two_looks_match_recomputation(spark, monkeypatch):
    monkeypatch.setattr(D, "_FIRST_WAVE", 300)
    df = table(spark).drop("v", "one")
    same(as_sets(discover(df, 1e-3, order_by=["k"])), expected(spark, df, ["k"], 1e-3, 42))


def test_proving_uniqueness_changes_nothing(spark, monkeypatch):
    df = table(spark).drop("one")
    monkeypatch.setattr(D, "_FIRST_WAVE", 300)
    asked = []
    monkeypatch.setattr(D, "is_unique", lambda rows, c: asked.append(c) and False)
    drawn = D.sample_table(D.index_rows(df, ["k"]), 1e-4)
    want = as_sets(discover(df, 1e-4, order_by=["k"]))
    monkeypatch.undo()
    monkeypatch.setattr(D, "_FIRST_WAVE", 300)
    proven = D.sample_table(D.index_rows(df, ["k"]), 1e-4)
    assert 0 in asked
    assert [(s.pred, s.a, s.b, s.last_batch) for s in proven.states] == [(s.pred, s.a, s.b, s.last_batch) for s in drawn.states]
    same(as_sets(discover(df, 1e-4, order_by=["k"])), want)


def test_functional_dependency_is_found(spark):
    got = set(as_sets(discover(table(spark).select("k", "g", "name"), 1e-3, order_by=["k"])))
    assert frozenset({"g ==", "name !="}) in got and frozenset({"g !=", "name =="}) in got


def test_staff_and_result_shape(spark):
    df = inline_rows(spark, STAFF, STAFF_SCHEMA)
    got = discover(df, 1e-5, order_by=["id"])
    assert got.columns == ["denial_constraint", "predicates", "size", "score", "sampled_pairs", "anchor"]
    same(as_sets(got), expected(spark, df, ["id"], 1e-5, 42))
    for r in got.collect():
        assert r.denial_constraint.startswith("!(") and r.denial_constraint.endswith(" & )") and r.size >= 2


@pytest.mark.parametrize("n", [0, 1])
def test_too_few_rows(spark, n):
    df = inline_rows(spark, STAFF, STAFF_SCHEMA).where(f"id <= {n}")
    assert discover(df).count() == 0
    assert [r.score for r in dependency_scores(df).collect()] == [0.0] * 6


def test_odd_names_and_all_constant(spark):
    df = spark.range(50).selectExpr("1 AS `a b`", "'x' AS `c.d(e)`", "2.0D AS `f``g`")
    assert discover(df, 1e-2).count() == 0
    odd = table(spark).selectExpr("g AS `my group`", "name AS `na.me(String)`")
    got = discover(odd, 1e-3)
    assert frozenset({"my group ==", "na.me(String) !="}) in as_sets(got)
    assert any("na.me(String) != na.me(String) & " in r.denial_constraint for r in got.collect())


def test_table_function_and_sections(spark, tmp_path):
    df = table(spark).select("k", "g", "name")
    df.createOrReplaceTempView("disc_input")
    got = discover_table(spark, "disc_input", threshold=1e-3)
    assert got.columns == ["denial_constraint"] and got.count() > 0
    path = str(tmp_path / "rows.csv")
    df.coalesce(1).write.option("header", True).csv(path)
    assert discover_table(spark, path, threshold=1e-3, order_by=["k"]).count() > 0
    many = discover_many({"one": df, "two": df.select("g", "name")}, 1e-3)
    assert {r.section for r in many.select("section").distinct().collect()} == {"one", "two"}


def test_dependency_scores_match_recomputation(spark):
    df = table(spark)
    got = {r.col: r.score for r in dependency_scores(df, "g", 1e-3, order_by=["k"]).collect()}
    rows = R.index_rows(df, ["k"])
    end = D.batch_limit(rows.n, 1e-5)
    data = [tuple(r)[1:] for r in sorted(rows.values(range(7)).collect(), key=lambda r: r.rid)]
    drawn = sorted(spark_pairs(spark, rows.n, end), key=lambda r: r.i)
    state = {}
    for p in rows.predicates:
        true = [brute.OPS[p.op](data[r.x][p.col_id], data[r.y][p.col_id]) for r in drawn]
        a, b = 1, 1
        for batch in range(end):
            lo, hi = P.batch_start(batch), P.batch_start(batch + 1)
            a, b = a + sum(true[lo:hi]), b + (hi - lo) - sum(true[lo:hi])
            if b / (a * (a + b) ** 2) <= 1e-5:
                break
        state[p] = (a, b, true, hi)
    want = dict.fromkeys(got, 0.0)
    for p, (a, _, true, used) in state.items():
        if p.col == "g" or (p.col == "one" and p.op in ("!=", ">", "<")) or a == 1:
            continue
        for q, (qa, qb, qtrue, _) in state.items():
            if q.col == "g" and qa > 1:
                both = 1 + sum(t and u for t, u in zip(true[:used], qtrue[:used]))
                want[p.col] = max(want[p.col], brute.distance((qa, qb), (both, 1 + a - both)))
    assert set(got) == set(want) and all(math.isclose(got[c], want[c], rel_tol=1e-6, abs_tol=1e-9) for c in want)
    assert got["g"] == 0.0 and got["name"] > 2
    line = dependency_scores(table(spark).select("g", "name"), threshold=1e-3).orderBy("column_id").first().line
    assert line == "0 0 0.000000"


def spark_pairs(spark, n, end):
    return P.sample_pairs(spark, n, end).collect()
