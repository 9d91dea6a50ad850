import math

from pyspark.sql import functions as F

from gainsay.functions import beta, text
from gainsay.operators import triage
from tests import brute


def test_polygamma_matches_sums(spark):
    ns = [1, 2, 3, 15, 16, 17, 40, 199, 200, 499, 500, 999, 1000, 5000]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = df.selectExpr("n", f"{beta.digamma_sql('n')} AS y1", f"{beta.trigamma_sql('n')} AS y2", f"{beta.tetragamma_sql('n')} AS y3").collect()
    for r in got:
        assert math.isclose(r.y1, brute.digamma(r.n), abs_tol=1e-11)
        assert math.isclose(r.y2, brute.trigamma(r.n), abs_tol=1e-11)
        y3 = 1 / r.n ** 2 if r.n >= 200 else -2.404114 + sum(2 / k ** 3 for k in range(1, r.n))
        assert math.isclose(r.y3, y3, abs_tol=1e-11)


def test_beta_and_distance(spark):
    cases = [(1, 1, 1, 5), (50, 50, 20, 80), (900, 100, 1, 700), (5, 5, 95, 5), (2000, 3000, 1500, 1000)]
    df = spark.createDataFrame(cases, "la long, lb long, ua long, ub long")
    got = df.selectExpr("*", f"{beta.norm_dist_sql('la', 'lb', 'ua', 'ub')} AS d", *beta.beta_columns("la", "lb")).collect()
    for r in got:
        assert math.isclose(r.d, brute.distance((r.la, r.lb), (r.ua, r.ub)), rel_tol=1e-8)
        assert math.isclose(r.mean_log, brute.stats(r.la, r.lb)[0], abs_tol=1e-10)
        assert math.isclose(r.grad, r.lb / (r.la * (r.la + r.lb) ** 2), rel_tol=1e-12)


def test_render_and_parse_round_trip(spark):
    df = spark.createDataFrame([([("a", "=="), ("b", "!=")],)], "p array<struct<col:string,op:string>>")
    row = df.select(text.dc_text(F.col("p")).alias("t"), text.dc_text(F.col("p"), "sql").alias("s")).first()
    assert row.t == "!(a == a & b != b & )"
    assert row.s == "!(t1.a = t2.a & t1.b != t2.b)"
    parsed = spark.createDataFrame([(row.t,)], "line string").select(text.parse_dc(F.col("line")).alias("p")).first().p
    assert [(p.left, p.op, p.right) for p in parsed] == [("a", "==", "a"), ("b", "!=", "b")]


def test_triage_classes(spark):
    lines = {
        "nothing here": text.EMPTY,
        "!( & )": text.EMPTY,
        "!(a == a & )": text.SINGLE_COLUMN,
        "!(rt_role != rt_role & rt_id == rt_id & )": text.LOOKUP,
        "!(cct_sub_id == cct_sub_id & cc_subject_kind != cc_subject_kind & )": text.LOOKUP,
        "!(id < id & year >= year & )": text.SPURIOUS_ORDER,
        "!(movie_id < movie_id & year >= year & )": text.SPURIOUS_ORDER,
        "!(movie_id == movie_id & year >= year & )": text.USEFUL,
        "!(ID(String) == ID(String) & Gestor(String) != Gestor(String) & )": text.USEFUL,
    }
    df = spark.createDataFrame([("s", k, i) for i, k in enumerate(lines)], "section string, denial_constraint string, position int")
    got = triage.triage(df)
    assert {r.denial_constraint: r.category for r in got.collect()} == lines
    total = [r for r in triage.summary(got).collect() if r.section is None][0]
    assert (total.total, total.useful, total.useless) == (9, 2, 7)


def test_examples_keep_five_and_count_the_rest(spark):
    df = spark.createDataFrame([("s", "!(a == a & )", i) for i in range(8)], "section string, denial_constraint string, position int")
    got = triage.examples(triage.triage(df)).collect()
    assert sorted(r.place for r in got) == [1, 2, 3, 4, 5] and {r.more for r in got} == {3}
    assert triage.category_counts(triage.triage(df)).first().n == 8


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("split(")


def test_examples_parse_a_line_a_few_times(spark):
    """A filter on the class once parsed the line again for every use of its terms."""
    df = spark.range(3).selectExpr("'s' AS section", "concat('!(a == a', id, ' & )') AS denial_constraint", "id AS position")
    assert 1 <= parses(triage.examples(triage.triage(df))) <= 6


def test_counts_parse_a_line_once(spark):
    df = spark.range(9).selectExpr("'s' AS section", "concat('!(a == a', IF(id < 6, '', CAST(id AS STRING)), ' & )') AS denial_constraint")
    counts = triage.category_counts(triage.triage(df))
    assert parses(counts) == 1 and [r.n for r in counts.collect()] == [6]


def test_dependency_line(spark):
    row = spark.range(1).select(text.dependency_text(F.lit(3), F.lit(0), F.lit(2.5)).alias("t")).first()
    assert row.t == "3 0 2.500000"
