import math

import pytest
from pyspark.sql import functions as F

from gainsay.operators import evidence as E
from gainsay.operators import pairs as P
from gainsay.operators import rows as R
from gainsay.operators import schema_model as M
from tests import brute


def test_type_classes_and_space(spark):
    df = spark.sql("SELECT 1 AS a, 1.5D AS b, CAST(2 AS DECIMAL(9,2)) AS c, 'x' AS d, true AS e, DATE'2020-01-01' AS f, array(1) AS g, CAST(1 AS TINYINT) AS h")
    assert [r.type_class for r in M.type_classes(df).collect()] == ["INTEGER", "REAL", "REAL", "STRING", "STRING", "STRING", "STRING", "INTEGER"]
    space = M.predicate_space(df).collect()
    assert len(space) == 4 * 6 + 4 * 2 and [r.pred_id for r in space] == list(range(32))
    assert M.predicate_space(df, order_temporal=True).count() == 36
    assert M.schemas_equal(df, df) and not M.schemas_equal(df, df.drop("a"))


def test_encoding_and_constants(spark):
    df = spark.createDataFrame([(0, 1.0, "", 7, 1.0, "k"), (None, None, None, 7, 1.0, "k"), (3, math.nan, "z", 7, 1.0, "k")],
                               "i int, r double, s string, c int, f double, t string")
    got = M.encode(df).collect()
    assert [r.i for r in got] == [0, 0, 3] and [r.s for r in got] == ["", "", "z"]
    assert math.isnan(got[1].r)
    flags = {r.col: r.is_constant for r in M.constant_columns(df).collect()}
    assert flags == {"i": False, "r": False, "s": False, "c": True, "f": True, "t": True}
    assert R.index_rows(df).constant == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True}
    nan = spark.createDataFrame([(math.nan,), (math.nan,)], "r double")
    assert not M.constant_columns(nan).first().is_constant and not R.index_rows(nan).constant[0]


def test_late_difference_is_not_constant(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id = 4999 THEN 1 ELSE 0 END AS flag", "1 AS one")
    assert R.index_rows(df, ["id"]).constant == {0: False, 1: False, 2: True}


@pytest.mark.parametrize("order", [None, ["k"]])
def test_row_ids_are_dense(spark, order):
    df = spark.range(0, 10000, 1, 7).selectExpr("id % 3 AS k", "id AS v")      # three huge groups
    got = R.with_row_id(df.repartition(5), order).collect()
    assert sorted(r.rid for r in got) == list(range(10000))
    if order:
        ordered = sorted(got, key=lambda r: r.rid)
        assert [(r.k, r.v) for r in ordered] == sorted((r.k, r.v) for r in got)


def test_num_lines(spark):
    df = spark.range(100).withColumnRenamed("id", "v")
    assert R.index_rows(df, num_lines=10).n == 10
    assert R.index_rows(df, num_lines=-1).n == 100 and R.index_rows(df, num_lines=1000).n == 100
    assert sorted(r.c0 for r in R.index_rows(df, ["v"], 10).df.collect()) == list(range(10))


def test_batches():
    assert [P.batch_size(b) for b in (0, 1, 20, 25)] == [100, 200, 104857600, 104857600]
    assert P.batch_start(20) == 104857500 and P.batch_start(22) == 104857500 + 2 * 104857600
    assert P.batch_count(12) == 1 and P.batch_count(1) == 0
    assert P.batch_start(P.batch_count(1500)) >= 0.0325 * 1500 ** 2 > P.batch_start(P.batch_count(1500) - 1)


def test_pairs_are_distinct_uniform_and_repeatable(spark):
    first = P.sample_pairs(spark, 5, 9).collect()
    assert len(first) == P.batch_start(9) and all(0 <= r.x < 5 and 0 <= r.y < 5 and r.x != r.y for r in first)
    cells = {}
    for r in first:
        cells[r.x, r.y] = cells.get((r.x, r.y), 0) + 1
    want = len(first) / 20
    assert len(cells) == 20 and sum((c - want) ** 2 / want for c in cells.values()) < 50
    again = P.sample_pairs(spark, 5, 9, 6).collect()
    assert sorted((r.i, r.batch, r.x, r.y) for r in again) == sorted((r.i, r.batch, r.x, r.y) for r in first if r.batch >= 6)
    assert P.sample_pairs(spark, 1, 3).count() == 0


def test_gather_strategies_agree(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id AS k", "id % 7 AS g", "CAST(id % 11 AS STRING) AS s", "CASE WHEN id % 5 = 0 THEN NULL ELSE id / 3D END AS r")
    rows = R.index_rows(df, ["k"])
    n = P.batch_start(4)
    results = []
    for limit, fewer in ((1 << 40, True), (1 << 40, False), (0, False)):
        monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
        rows.n = 3000 if fewer else 1000
        pairs = P.sample_pairs(spark, 3000, 4)
        got = E.pair_patterns(rows, pairs, n).collect()
        results.append(sorted((r.i, r.x, r.y, r.w0) for r in got))
    assert len(results[0]) == n and results[0] == results[1] == results[2]


def test_patterns_match_brute_force_on_forty_columns(spark):
    cols = [f"(id * {k + 3}) % {k + 2} AS `col {k}.x`" for k in range(38)]
    df = spark.range(60).selectExpr("id", "CASE WHEN id % 4 = 0 THEN double('NaN') ELSE CAST(id % 6 AS DOUBLE) END AS r", *cols)
    rows = R.index_rows(df, ["id"])
    assert E.word_count(40) == 3
    data = [tuple(r) for r in rows.values(range(40)).drop("rid").collect()]
    data = sorted(data, key=lambda t: t[0])
    pairs = P.sample_pairs(spark, 60, 2)
    ev = E.evidence(E.pair_patterns(rows, pairs, P.batch_start(2)))
    got = {(r.batch, r.pred_id): r.hits for r in E.predicate_counts(ev, rows.predicates, 0, 2).collect()}
    drawn = pairs.collect()
    for p in rows.predicates:
        for b in (0, 1):
            want = sum(brute.OPS[p.op](data[r.x][p.col_id], data[r.y][p.col_id]) for r in drawn if r.batch == b)
            assert got[b, p.pred_id] == want, p


def test_orderings_of_strings_are_refused():
    with pytest.raises(ValueError):
        E.predicate_sql("x", "y", "<", M.STRING)
    with pytest.raises(ValueError):
        E.predicate_sql("x", "y", "~", M.REAL)


def test_long_strings_differ_by_their_end(spark):
    long = "a" * 5000
    df = spark.createDataFrame([(1, long + "x"), (2, long + "y"), (3, long + "x")], "id int, s string")
    values = [r.c1 for r in sorted(R.index_rows(df, ["id"]).values([0, 1]).collect(), key=lambda r: r.c0)]
    assert values[0] == values[2] != values[1] and max(map(len, values)) == 64


def test_numbers_survive_a_change_of_cores(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 160_000, 1, 16).selectExpr("id", "id % 7 AS g").write.parquet(path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        for make in (lambda: spark.read.parquet(path), lambda: spark.read.parquet(path).where("g < 6"), lambda: spark.read.parquet(path).selectExpr("id", "explode(array(1, 2)) AS g")):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
            rows, n = R.numbered(make())
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
            got = rows.selectExpr("count(1)", "count(DISTINCT rid)", "min(rid)", "max(rid)").first()
            assert tuple(got) == (n, n, 0, n - 1) and n == make().count()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_scan_is_numbered_where_it_lies(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(0, 1000, 1, 4).selectExpr("id", "id * 2 AS `a b`").write.parquet(path)
    df = spark.read.parquet(path)
    assert R.plain_scan(df) and R.plain_scan(df.select("`a b`", F.col("id").alias("x")))
    for other in (df.where("id > 3"), df.limit(5), df.unionByName(df), df.selectExpr("explode(array(id, id)) AS id"), df.distinct(), df.join(df, "id"), spark.range(9),
                  df.sample(0.5)):
        assert not R.plain_scan(other)
    rows, n = R.numbered(df.select("`a b`"))
    assert n == 1000 and path in str(rows.inputFiles()) and "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString()
