"""Arithmetic and plans that must hold on tables far larger than the test data."""

import time

import pytest
from pyspark.sql import functions as F

from gainsay.operators import pairs as P, predsets, rows as R, schema_model as M, verify
from gainsay.plans import discover as D
from gainsay.sources import tables


def looped_count(n):
    want, batch = P.PAIR_SHARE * n * n, 0
    while P.batch_start(batch) < want:
        batch += 1
    return batch


def looped_limit(n, min_grad):
    limit, batch = P.batch_count(n), 0
    while batch < limit:
        batch += 1
        m = P.batch_start(batch)
        if (m + 1) / (m + 2) ** 2 <= min_grad:
            break
    return batch


@pytest.mark.parametrize("n", [0, 1, 2, 3, 12, 55, 56, 1000, 1500, 40_000, 56_000, 100_000, 700_001, 1_000_000])
def test_batches_in_closed_form(n):
    assert P.batch_count(n) == (looped_count(n) if n > 1 else 0)
    for grad in (0.3, 0.01, 1e-4, 1e-6, 1e-9):
        assert D.batch_limit(n, grad) == (looped_limit(n, grad) if n > 1 else 0)


def test_bounds_of_huge_tables_cost_nothing():
    began = time.perf_counter()
    assert D.batch_limit(10**12, 1e-9) == looped_limit(10**6, 1e-9)
    assert D.batch_limit(10**12, 0) == P.batch_count(10**12)
    assert time.perf_counter() - began < 0.1


def test_threshold_zero_draws_every_batch(spark):
    df = spark.range(60).selectExpr("id", "id % 3 AS a", "id % 3 + 1 AS b")
    found = D.discover(df, 0.0, order_by=["id"]).collect()
    assert {r.denial_constraint for r in found} >= {"!(a == a & b != b & )"} or {"!(b != b & a == a & )"} & {r.denial_constraint for r in found}


def test_slices_of_draws_give_the_same_values(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "id % 7 AS a", "concat('s', id % 11) AS b")
    rows = R.index_rows(df, ["id"])
    drawn = P.sample_pairs(spark, rows.n, 3)
    n = P.batch_start(3)
    whole = sorted(map(tuple, P.pair_values(rows, drawn, n).collect()))
    monkeypatch.setattr(P, "BROADCAST_BYTES", 2 * n * 48 // 3)
    sliced = P.pair_values(rows, drawn, n)
    assert sorted(map(tuple, sliced.collect())) == whole
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_wall_clock_times_ignore_the_session_zone(spark):
    df = spark.sql("SELECT id, TIMESTAMP_NTZ '2024-03-10 02:30:00.25' + make_dt_interval(0, CAST(id AS INT)) AS t FROM range(3)")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        info = M.column_infos(df.schema, order_temporal=True)[1]
        got = [r[0] for r in df.select(F.expr(M.encoded_sql("t", df.schema["t"].dataType, info))).collect()]
        assert [b - a for a, b in zip(got, got[1:])] == [3_600_000_000] * 2 and got[0] % 1_000_000 == 250_000
        assert verify.violation_count(df.select("t"), [("t", "==")]).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dependency_pairs_equal_the_counted_violations(spark):
    df = spark.sql("SELECT * FROM VALUES ('k', 0.0), ('k', NULL), ('k', double('NaN')), (NULL, 1.0), ('', 1.0), ('', 2.0) AS t(`a.b`, c)")
    pairs = sum(r["pairs"] for r in verify.fd_violations(df, ["a.b"], "c").collect())
    assert pairs == verify.violation_count(df, [("a.b", "=="), ("c", "!=")]).first()[0] == 10


def test_grown_sets_keep_names_with_spaces_apart(spark):
    sets = spark.createDataFrame([(["a b !="],)], "members array<string>")
    preds = spark.createDataFrame([("a b", "=="), ("a b", "!="), ("c", "==")], "col string, op string")
    assert {r.set_id for r in predsets.grown_sets(sets, preds, 2).collect()} == {"a b !=", "a b != & c =="}


def test_hot_key_of_a_row_check_is_split(spark, monkeypatch):
    monkeypatch.setattr(verify, "BROADCAST_BYTES", 0)
    df = spark.range(200_000).selectExpr("id", "IF(id % 10 = 0, id, 0) AS k", "id % 3 AS v", "sha2(CAST(id AS STRING), 256) AS pad")
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        hit = verify.violating_rows(df, [("k", "=="), ("v", "!=")])
        assert hit.count() == 180_000 + 1
        rows = hit.agg(F.max("id"), F.max("pad"))
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_csv_dialects_are_sniffed(spark, tmp_path):
    assert tables.sniffed(["a,b", "1,2"]) == (",", '"') and tables.sniffed(["only one"])[0] == ","
    for sep, quote in ((";", "'"), ("\t", '"'), ("|", '"'), (",", "'")):
        path = tmp_path / f"d{ord(sep)}{ord(quote)}.csv"
        path.write_text(f"id{sep}name\n" + "".join(f"{i}{sep}{quote}x{sep}{i}{quote}\n" for i in range(5)))
        got = tables.read_input(spark, str(path))
        assert got.columns == ["id", "name"] and sorted(map(tuple, got.collect())) == [(i, f"x{sep}{i}") for i in range(5)]


def test_discovered_constraints_over_times_can_be_checked(spark):
    df = spark.sql("SELECT id AS a, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS t FROM range(40)")
    reading = verify.Reading(order_temporal=True)
    assert not verify.holds(df, [("a", "<"), ("t", "<")], reading) and verify.holds(df, [("a", "<"), ("t", ">")], reading)
    for row in D.discover(df, 1e-2, order_by=["a"], order_temporal=True).select("predicates").collect():
        assert verify.holds(df, row.predicates, reading)


def test_few_violating_combinations_are_broadcast_to_the_rows(spark):
    df = spark.range(10_000).selectExpr("id", "id % 500 AS k", "IF(id = 7, 1, 0) AS v", "sha2(CAST(id AS STRING), 256) AS pad")
    got = verify.violating_rows(df, [("k", "=="), ("v", "!=")])
    assert got.count() == 20 and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
