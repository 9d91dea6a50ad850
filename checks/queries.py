"""Every registered query with its independent SQL statement."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqltext as Q
from gainsay.functions import beta
from gainsay.functions.text import dc_text, predicate_text
from gainsay.operators import adaptive, audit, evidence as E, pairs as P, predsets, rows as R, schema_model as M, triage, verify
from gainsay.plans import discover as D
from gainsay.plans import workloads
from gainsay.shared import shared_dir
from gainsay.sources import tables
from gainsay.sources.dc_log import label_sections, read_dc_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def loaded(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: load(spark, sf, n) for n in names}


# ---- derived inputs -------------------------------------------------------------------------

CUSTOMER_NATION = Q.CLASSES["customer"] + Q.CLASSES["nation"][1:]
CUSTOMER_NATION_SQL = "customer JOIN nation ON c_nationkey = n_nationkey"
LINEITEM_PART = Q.CLASSES["lineitem"] + Q.CLASSES["part"][1:]
LINEITEM_PART_SQL = "lineitem JOIN part ON l_partkey = p_partkey"
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# events with a constant column, NULLs next to true zeros and NaN next to numbers
EVENT_COLUMNS = [("event_id", "I"), ("user_id", "I"), ("event_type", "S"), ("value", "R"), ("unit", "S"), ("level", "I"), ("code", "I")]
EVENT_EXPRS = ["event_id", "CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id",
               "CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type"]
EVENTS_SQL = ("(SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, "
              "CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type, "
              "CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN NULL ELSE value END AS value, "
              "'eur' AS unit, 3 AS level, CASE WHEN event_type <> 'view' THEN length(event_type) END AS code FROM events)")


def customer_nation(spark: SparkSession, sf: str) -> DataFrame:
    return workloads.star_join(loaded(spark, sf, "customer", "nation"), "join_customer_nation")


def lineitem_part(spark: SparkSession, sf: str) -> DataFrame:
    return workloads.star_join(loaded(spark, sf, "lineitem", "part"), "join_lineitem_part")


def marked_events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").selectExpr(
        *EVENT_EXPRS, "CASE WHEN event_id % 97 = 0 THEN double('NaN') WHEN event_id % 89 = 0 THEN NULL ELSE value END AS value",
        "'eur' AS unit", "3 AS level", "CASE WHEN event_type <> 'view' THEN length(event_type) END AS code")


# ---- typing, encoding, predicate space ------------------------------------------------------

def _constant_sql(source: str, cols: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {k} AS col_id, '{n}' AS col, '{Q.NAMES[c]}' AS type_class, min(v) = max(v)"
        f"{' AND NOT isnan(max(v))' if c == 'R' else ''} AS is_constant FROM (SELECT {Q.encoded(n, c)} AS v FROM {source})"
        for k, (n, c) in enumerate(cols))


@register("column_profile_lineitem", _constant_sql("lineitem", Q.CLASSES["lineitem"]))
def column_profile_lineitem(spark, sf):
    return M.constant_columns(load(spark, sf, "lineitem"))


@register("constant_columns_events", _constant_sql(EVENTS_SQL, EVENT_COLUMNS))
def constant_columns_events(spark, sf):
    return M.constant_columns(marked_events(spark, sf))


@register("encode_nulls_events", f"""
    SELECT event_id, coalesce(user_id, 0) AS user_id, coalesce(event_type, '') AS event_type,
           value IS NULL OR isnan(value) AS value_is_nan,
           CASE WHEN value IS NULL OR isnan(value) THEN NULL ELSE CAST(CAST(value AS FLOAT) AS DOUBLE) END AS value_narrow
    FROM {EVENTS_SQL}""")
def encode_nulls_events(spark, sf):
    return M.encode(marked_events(spark, sf), parity=True).selectExpr(
        "event_id", "user_id", "event_type", "isnan(value) AS value_is_nan",
        "CASE WHEN NOT isnan(value) THEN value END AS value_narrow")


@register("dictionary_part_brand", "SELECT p_brand AS value, count(*) AS cnt FROM part GROUP BY 1")
def dictionary_part_brand(spark, sf):
    return M.dictionary(load(spark, sf, "part"), "p_brand")


def _marginals_sql(source: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for pid, _, _, col, op, cls in Q.predicates(cols):
        base = (f"(SELECT sum(c) AS n, coalesce(sum(c) FILTER (WHERE NOT nan), 0) AS m, "
                f"coalesce(sum(c * (c - 1)) FILTER (WHERE NOT nan), 0) AS eq FROM "
                f"(SELECT v, {'isnan(v)' if cls == 'R' else 'false'} AS nan, count(*) AS c FROM (SELECT {Q.encoded(col, cls)} AS v FROM {source}) GROUP BY v))")
        half = "((m * (m - 1) - eq) // 2)"
        expr = {"==": "eq", "!=": "n * (n - 1) - eq", ">": half, "<": half}.get(op, f"{half} + eq")
        parts.append(f"SELECT {pid} AS pred_id, '{col} {op} {col}' AS predicate, CAST({expr} AS BIGINT) AS pairs, "
                     f"round(CAST({expr} AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE), 9) AS prob FROM {base}")
    return " UNION ALL ".join(parts)


def _marginals(df: DataFrame) -> DataFrame:
    return verify.marginals(df).select("pred_id", predicate_text(F.col("col"), F.col("op")).alias("predicate"),
                                       F.col("pairs").cast("long").alias("pairs"), F.round("prob", 9).alias("prob"))


@register("predicate_space_marginals_lineitem", _marginals_sql("lineitem", Q.CLASSES["lineitem"]))
def predicate_space_marginals_lineitem(spark, sf):
    return _marginals(load(spark, sf, "lineitem"))


@register("exact_marginals_events_nan", _marginals_sql(EVENTS_SQL, EVENT_COLUMNS))
def exact_marginals_events_nan(spark, sf):
    return _marginals(marked_events(spark, sf))


# ---- pairs and evidence ---------------------------------------------------------------------

LOOSE = 1e-2
LOOSE_BATCHES = Q.batches_for(LOOSE)


def _with(ctes: list[str], select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


@register("pair_sample_orders", _with(["size AS (SELECT count(*) AS n FROM orders)", Q.pair_ctes(LOOSE_BATCHES)],
                                      "SELECT batch, i, x, y FROM pairs"))
def pair_sample_orders(spark, sf):
    n = load(spark, sf, "orders").count()
    return P.sample_pairs(spark, n, D.batch_limit(n, LOOSE * 0.01))


@register("pair_values_orders", _with([Q.rows_ctes("orders", Q.CLASSES["orders"], "o_orderkey"), Q.pair_ctes(LOOSE_BATCHES)],
          "SELECT batch, i, l.c0 AS x_key, r.c0 AS y_key, l.c3 AS x_price, r.c3 AS y_price, l.c2 AS x_status, r.c2 AS y_status "
          "FROM pairs JOIN rows l ON l.rid = x JOIN rows r ON r.rid = y"))
def pair_values_orders(spark, sf):
    rows = R.index_rows(load(spark, sf, "orders"), ["o_orderkey"])
    end = D.batch_limit(rows.n, LOOSE * 0.01)
    got = P.pair_values(rows, P.sample_pairs(spark, rows.n, end), P.batch_start(end), [0, 2, 3])
    return got.selectExpr("batch", "i", "x_c0 AS x_key", "y_c0 AS y_key", "x_c3 AS x_price", "y_c3 AS y_price",
                          "x_c2 AS x_status", "y_c2 AS y_status")


@register("row_cap_orders", "SELECT o_orderkey, o_custkey, rid FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rid "
                            "FROM orders) WHERE rid < 1000")
def row_cap_orders(spark, sf):
    numbered = R.with_row_id(load(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])
    return numbered.where("rid < 1000").select("o_orderkey", "o_custkey", "rid")


def _counts(spark, df, order, cols, seed=42):
    rows = R.index_rows(df, order)
    end = D.batch_limit(rows.n, LOOSE * 0.01)
    patterns = E.pair_patterns(rows, P.sample_pairs(spark, rows.n, end, 0, seed), P.batch_start(end))
    return rows, E.predicate_counts(E.evidence(patterns), rows.predicates, 0, end)


def _counts_sql(source, cols, order):
    return [Q.rows_ctes(source, cols, order), Q.pair_ctes(LOOSE_BATCHES), Q.states_cte(cols), Q.counts_ctes(cols)]


@register("pred_counts_lineitem", _with(_counts_sql("lineitem", Q.CLASSES["lineitem"], ", ".join(LINEITEM_ORDER)),
                                        "SELECT batch, pred_id, CAST(hits AS BIGINT) AS hits FROM counts"))
def pred_counts_lineitem(spark, sf):
    return _counts(spark, load(spark, sf, "lineitem"), LINEITEM_ORDER, Q.CLASSES["lineitem"])[1]


@register("pred_counts_events_nan", _with(_counts_sql(EVENTS_SQL, EVENT_COLUMNS, "event_id"),
                                          "SELECT batch, pred_id, CAST(hits AS BIGINT) AS hits FROM counts"))
def pred_counts_events_nan(spark, sf):
    return _counts(spark, marked_events(spark, sf), ["event_id"], EVENT_COLUMNS)[1]


def _ieee_sql() -> str:
    tests = {"eq": "a = b AND NOT isnan(a)", "ne": "a <> b OR isnan(a) OR isnan(b)",
             "gt": "a > b AND NOT isnan(a) AND NOT isnan(b)", "le": "a <= b AND NOT isnan(a) AND NOT isnan(b)",
             "lt": "a < b AND NOT isnan(a) AND NOT isnan(b)", "ge": "a >= b AND NOT isnan(a) AND NOT isnan(b)"}
    flags = ", ".join(f"{t} AS {n}" for n, t in tests.items())
    return (f"SELECT event_id, {flags} FROM (SELECT e.event_id, e.value AS a, o.value AS b FROM "
            f"(SELECT event_id, coalesce(value, 'nan'::DOUBLE) AS value FROM {EVENTS_SQL}) e JOIN "
            f"(SELECT event_id, coalesce(value, 'nan'::DOUBLE) AS value FROM {EVENTS_SQL}) o ON o.event_id = e.event_id + 97)")


@register("real_ieee_nan", _ieee_sql())
def real_ieee_nan(spark, sf):
    enc = M.encode(marked_events(spark, sf)).select("event_id", "value")
    other = enc.selectExpr("event_id - 97 AS event_id", "value AS b")
    names = dict(zip(("eq", "ne", "gt", "le", "lt", "ge"), ("==", "!=", ">", "<=", "<", ">=")))
    return (enc.withColumnRenamed("value", "a").join(other, "event_id")
               .selectExpr("event_id", *[f"{E.predicate_sql('a', 'b', op, M.REAL)} AS {n}" for n, op in names.items()]))


_WORD0 = " + ".join(f"(s{k}::BIGINT << {4 * k})" for k in range(6))


@register("evidence_orders", _with(_counts_sql("orders", Q.CLASSES["orders"], "o_orderkey")[:3],
                                   f"SELECT batch, {_WORD0} AS w0, count(*) AS cnt FROM pv GROUP BY 1, 2"))
def evidence_orders(spark, sf):
    rows = R.index_rows(load(spark, sf, "orders"), ["o_orderkey"])
    end = D.batch_limit(rows.n, LOOSE * 0.01)
    return E.evidence(E.pair_patterns(rows, P.sample_pairs(spark, rows.n, end), P.batch_start(end)))


# ---- statistics -----------------------------------------------------------------------------

_STATS = ("pred_id, last_batch, a, b, round(a::DOUBLE / (a + b), 9) AS mean, round(m, 9) AS mean_log, round(s, 9) AS spread_log")


@register("adaptive_stop_lineitem", _with(
    _counts_sql("lineitem", Q.CLASSES["lineitem"], ", ".join(LINEITEM_ORDER)) + [Q.PSI, Q.stop_ctes(Q.CLASSES["lineitem"], LOOSE)],
    f"SELECT {_STATS} FROM stats"))
def adaptive_stop_lineitem(spark, sf):
    _, counts = _counts(spark, load(spark, sf, "lineitem"), LINEITEM_ORDER, Q.CLASSES["lineitem"])
    return adaptive.adaptive_stop(counts, LOOSE * 0.01).selectExpr(
        "pred_id", "last_batch", "a", "b", "round(mean, 9) AS mean", "round(mean_log, 9) AS mean_log",
        "round(spread_log, 9) AS spread_log")


@register("constant_penalty_events", _with(
    _counts_sql(EVENTS_SQL, EVENT_COLUMNS, "event_id") + [Q.PSI, Q.stop_ctes(EVENT_COLUMNS, LOOSE)],
    "SELECT pred_id, col || ' ' || op AS predicate, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM stats"))
def constant_penalty_events(spark, sf):
    df = marked_events(spark, sf)
    rows, counts = _counts(spark, df, ["event_id"], EVENT_COLUMNS)
    stats = adaptive.adaptive_stop(counts, LOOSE * 0.01).join(M.predicate_space(df), "pred_id")
    return (adaptive.penalised(stats.join(M.constant_columns(df).select("col_id", "is_constant"), "col_id"))
            .selectExpr("pred_id", "concat(col, ' ', op) AS predicate", "a", "b"))


@register("predicate_ranking_orders", _with(
    _counts_sql("orders", Q.CLASSES["orders"], "o_orderkey") + [Q.PSI, Q.stop_ctes(Q.CLASSES["orders"], LOOSE)],
    "SELECT CAST(rank AS INTEGER) AS rank, pred_id, round(m, 9) AS mean_log FROM stats"))
def predicate_ranking_orders(spark, sf):
    _, counts = _counts(spark, load(spark, sf, "orders"), ["o_orderkey"], Q.CLASSES["orders"])
    ranked = adaptive.rank_predicates(adaptive.adaptive_stop(counts, LOOSE * 0.01))
    return ranked.selectExpr("rank", "pred_id", "round(mean_log, 9) AS mean_log")


_GAMMA_SQL = ("WITH psi AS (SELECT list(v ORDER BY n) AS g1, list(w ORDER BY n) AS g2, list(u ORDER BY n) AS g3 FROM (SELECT n, "
              "-0.5772156649015329 + coalesce(sum(CASE WHEN n > 1 THEN 1.0::DOUBLE / (n - 1) END) OVER w1, 0) AS v, "
              "pi() * pi() / 6 - coalesce(sum(CASE WHEN n > 1 THEN 1.0::DOUBLE / ((n - 1) * (n - 1)) END) OVER w1, 0) AS w, "
              "-2.404114 + coalesce(sum(CASE WHEN n > 1 THEN 2.0::DOUBLE / ((n - 1) * (n - 1) * (n - 1)) END) OVER w1, 0) AS u "
              "FROM (SELECT range AS n FROM range(1, 1000)) WINDOW w1 AS (ORDER BY n))), "
              "args AS (SELECT DISTINCT CAST(l_quantity * (1 + l_linenumber) * (1 + l_suppkey % 5) AS BIGINT) AS n FROM lineitem) "
              f"SELECT n, round({Q.digamma('n')}, 9) AS y1, round({Q.trigamma('n')}, 9) AS y2, "
              "round(CASE WHEN n >= 200 THEN 1.0::DOUBLE / (n * n) ELSE (SELECT g3 FROM psi)[n] END, 9) AS y3 FROM args")


@register("polygamma_lineitem", _GAMMA_SQL)
def polygamma_lineitem(spark, sf):
    args = load(spark, sf, "lineitem").selectExpr(
        "CAST(l_quantity * (1 + l_linenumber) * (1 + l_suppkey % 5) AS BIGINT) AS n").distinct()
    return args.selectExpr("n", f"round({beta.digamma_sql('n')}, 9) AS y1", f"round({beta.trigamma_sql('n')}, 9) AS y2",
                           f"round({beta.tetragamma_sql('n')}, 9) AS y3")


@register("beta_stats_part_brand", f"""
    WITH {Q.PSI}, g AS (SELECT p_brand, p_size, count(*) AS a, CAST(sum(p_partkey % 13) + 1 AS BIGINT) AS b FROM part GROUP BY 1, 2)
    SELECT p_brand, p_size, round(a::DOUBLE / (a + b), 9) AS mean, round({Q.mean_log('a', 'b')}, 8) AS mean_log,
           round({Q.spread_log('a', 'b')}, 8) AS spread_log, round(b::DOUBLE / (a::DOUBLE * (a + b) * (a + b)), 8) AS grad FROM g""")
def beta_stats_part_brand(spark, sf):
    groups = load(spark, sf, "part").groupBy("p_brand", "p_size").agg(
        F.expr("count(1) AS a"), F.expr("sum(p_partkey % 13) + 1 AS b"))
    return groups.selectExpr("p_brand", "p_size", *beta.beta_columns()).selectExpr(
        "p_brand", "p_size", "round(mean, 9) AS mean", "round(mean_log, 8) AS mean_log",
        "round(spread_log, 8) AS spread_log", "round(grad, 8) AS grad")


# ---- search ---------------------------------------------------------------------------------

_DISCOVERED = ["denial_constraint", "size", "round(score, 5) AS score", "anchor", "sampled_pairs"]


@register("discover_customer_nation", Q.discover_sql(CUSTOMER_NATION_SQL, CUSTOMER_NATION, "c_custkey", 1e-4, 4))
def discover_customer_nation(spark, sf):
    return D.discover(customer_nation(spark, sf), 1e-4, order_by=["c_custkey"]).selectExpr(*_DISCOVERED)


@register("discover_lineitem_part", Q.discover_sql(LINEITEM_PART_SQL, LINEITEM_PART, ", ".join(LINEITEM_ORDER), 1e-4, 5))
def discover_lineitem_part(spark, sf):
    return D.discover(lineitem_part(spark, sf), 1e-4, order_by=LINEITEM_ORDER).selectExpr(*_DISCOVERED)


@register("discover_table_customer_nation", Q.discover_sql(CUSTOMER_NATION_SQL, CUSTOMER_NATION, "c_custkey", 1e-4, 4,
                                                             select=f"SELECT denial_constraint FROM ({Q.found_sql(4)})"))
def discover_table_customer_nation(spark, sf):
    name = f"customer_nation_{uuid.uuid4().hex}"
    customer_nation(spark, sf).createOrReplaceTempView(name)
    return D.discover_table(spark, name, threshold=1e-4, order_by=["c_custkey"])


# The searches end by themselves before the depth of the SQL statements.
@register("discover_row_cap_customer_nation", Q.discover_sql(f"(SELECT * FROM {CUSTOMER_NATION_SQL} ORDER BY c_custkey LIMIT 500)", CUSTOMER_NATION,
                                                              "c_custkey", 1e-4, 5))
def discover_row_cap_customer_nation(spark, sf):
    return D.discover(customer_nation(spark, sf), 1e-4, num_lines=500, order_by=["c_custkey"]).selectExpr(*_DISCOVERED)


# The rows of a single file, numbered by their places in it: DuckDB numbers them in that order where no order is asked for.
@register("discover_file_order_conversations", Q.discover_sql("(SELECT *, row_number() OVER () AS place FROM conversations)", Q.CLASSES["conversations"], "place", 1e-4, 4))
def discover_file_order_conversations(spark, sf):
    return D.discover(load(spark, sf, "conversations"), 1e-4).selectExpr(*_DISCOVERED)


@register("row_numbers_lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER () - 1 AS rid FROM lineitem")
def row_numbers_lineitem(spark, sf):
    return R.with_row_id(load(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "rid")


@register("num_lines_orders", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rid FROM orders QUALIFY rid < 700")
def num_lines_orders(spark, sf):
    rows = R.index_rows(load(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], num_lines=700)
    return rows.df.selectExpr("c0 AS o_orderkey", "c3 AS o_totalprice", "rid")


@register("discover_events_nan", Q.discover_sql(EVENTS_SQL, EVENT_COLUMNS, "event_id", 1e-4, 5))
def discover_events_nan(spark, sf):
    return D.discover(marked_events(spark, sf), 1e-4, order_by=["event_id"]).selectExpr(*_DISCOVERED)


_SECTIONS = {
    "conversations": ("conversations", Q.CLASSES["conversations"], ["conv_id", "turn"]),
    "documents": ("documents", Q.CLASSES["documents"], ["doc_id"]),
    "join_customer_orders": ("customer JOIN orders ON c_custkey = o_custkey", Q.CLASSES["customer"] + [c for c in Q.CLASSES["orders"] if c[0] != "o_custkey"],
                             ["o_orderkey"]),
    "join_nation_region": ("nation JOIN region ON n_regionkey = r_regionkey", Q.CLASSES["nation"] + Q.CLASSES["region"][1:], ["n_nationkey"]),
}


def _sections_sql() -> str:
    parts = [f"SELECT '{name}' AS section, denial_constraint, size, score FROM "
             f"({Q.discover_sql(src, cols, ', '.join(order), 1e-4, 4)})" for name, (src, cols, order) in _SECTIONS.items()]
    return " UNION ALL ".join(parts)


@register("discover_sections", _sections_sql())
def discover_sections(spark, sf):
    t = loaded(spark, sf, "customer", "orders", "nation", "region", "conversations", "documents")
    inputs = {n: t[n] if n in t else workloads.star_join(t, n) for n in _SECTIONS}
    return D.discover_many(inputs, 1e-4, {n: s[2] for n, s in _SECTIONS.items()}).selectExpr(
        "section", "denial_constraint", "size", "round(score, 5) AS score")


def _level_sql(k: int) -> str:
    joins = " ".join(f"JOIN stats x{j} ON x{j}.rank = t.r{j}" for j in range(1, k + 1))
    text = " || ' & ' || ".join(f"x{j}.col || ' ' || x{j}.op" for j in range(1, k + 1))
    pick = (f"SELECT {text} AS members, CAST(t.a AS BIGINT) AS a, round(t.score, 5) AS score, t.sound "
            f"FROM t{k} t {joins}")
    return Q.discover_sql(CUSTOMER_NATION_SQL, CUSTOMER_NATION, "c_custkey", 1e-4, k, pick)


def _level(spark, sf, k):
    rows = R.index_rows(customer_nation(spark, sf), ["c_custkey"])
    sample = D.sample_table(rows, 1e-4)
    names = "array(" + ", ".join(f"'{s.pred.col} {s.pred.op}'" for s in sample.states) + ")"
    levels = D.lattice_levels(sample)
    for _ in range(k - 1):
        level = next(levels)
    return level.selectExpr(f"array_join(transform(members, r -> element_at({names}, r + 1)), ' & ') AS members",
                            "a", "round(score, 5) AS score", "sound")


@register("search_level2_customer_nation", _level_sql(2))
def search_level2_customer_nation(spark, sf):
    return _level(spark, sf, 2)


@register("search_level3_customer_nation", _level_sql(3))
def search_level3_customer_nation(spark, sf):
    return _level(spark, sf, 3)


@register("set_support_customer_nation", Q.discover_sql(
    CUSTOMER_NATION_SQL, CUSTOMER_NATION, "c_custkey", 1e-4, 2,
    "SELECT x1.col || ' ' || x1.op AS anchor, x2.col || ' ' || x2.op AS added, CAST(t.a - 1 AS BIGINT) AS hits "
    "FROM t2 t JOIN stats x1 ON x1.rank = t.r1 JOIN stats x2 ON x2.rank = t.r2 WHERE t.a > 1"))
def set_support_customer_nation(spark, sf):
    rows = R.index_rows(customer_nation(spark, sf), ["c_custkey"])
    sample = D.sample_table(rows, 1e-4)
    nodes = D._state_table(spark, sample)
    candidates = D._second_level(nodes, 1)
    index = D._index(sample)
    masks = E.narrowed(candidates.selectExpr("*", "slice(members, 1, 1) AS parent"), E.all_patterns(index).selectExpr("array(anchor) AS members", "chunk", "mask"),
                       index, [s.pred for s in sample.states])
    hits = E.counted_hits(candidates, masks).where("hits > 0")
    names = "array(" + ", ".join(f"'{s.pred.col} {s.pred.op}'" for s in sample.states) + ")"
    return hits.selectExpr(f"element_at({names}, members[0] + 1) AS anchor", f"element_at({names}, members[1] + 1) AS added", "hits")


def _scores_sql() -> str:
    # The target's comparisons are added to each comparison of the other columns.
    pairs = ("SELECT p1.col_id AS f, p1.a AS from_a, p2.m AS lm, p2.s AS ls, "
             "CAST(1 + coalesce((SELECT sum(cnt) FROM anchored e WHERE e.anchor = p1.rank AND (e.st[p2.col_id + 1] & p2.allowed) <> 0), 0) AS BIGINT) AS a "
             "FROM stats p1 JOIN stats p2 ON p2.col_id = 2 AND p1.col_id <> 2 AND p1.a > 1 AND p2.a > 1")
    measured = (f"SELECT *, {Q.mean_log('a', '(1 + from_a - a)')} AS m, {Q.spread_log('a', '(1 + from_a - a)')} AS s, "
                f"a::DOUBLE / (1 + from_a) AS mean FROM ({pairs})")
    cols = ", ".join(f"({k}, '{n}')" for k, (n, _) in enumerate(CUSTOMER_NATION))
    select = (f"SELECT CAST(c.id AS INTEGER) AS column_id, 2 AS target_id, c.name AS col, 'c_nationkey' AS target, "
              f"round(greatest(coalesce(max({Q._distance('lm', 'ls')}), 0), 0), 5) AS score, "
              f"printf('%d 2 %.3f', c.id, greatest(coalesce(max({Q._distance('lm', 'ls')}), 0), 0)) AS line "
              f"FROM (VALUES {cols}) c(id, name) LEFT JOIN ({measured}) q ON q.f = c.id GROUP BY c.id, c.name")
    return (f"WITH {Q.sample_sql(CUSTOMER_NATION_SQL, CUSTOMER_NATION, 'c_custkey', 1e-4)}, {Q.anchored_cte(CUSTOMER_NATION)} {select}")


@register("dependency_scores_customer_nation", _scores_sql())
def dependency_scores_customer_nation(spark, sf):
    return D.dependency_scores(customer_nation(spark, sf), "c_nationkey", 1e-4, order_by=["c_custkey"]).selectExpr(
        "column_id", "target_id", "col", "target", "round(score, 5) AS score",
        # Read back to three of its six decimals: beyond them the two engines' floating-point sums differ.
        "concat(substring_index(line, ' ', 2), ' ', format_string('%.3f', CAST(substring_index(line, ' ', -1) AS DOUBLE))) AS line")


# ---- exact verification ---------------------------------------------------------------------

_FDS = {
    "fd_violations_part": ("part", ["p_brand"], "p_type"),
    "fd_violations_events": ("events", ["user_id"], "event_type"),
    "fd_violations_lineitem": ("lineitem", ["l_shipdate"], "l_linestatus"),
    "fd_violations_documents": ("documents", ["source"], "lang"),
}


def _fd_sql(table, keys, dep):
    k = ", ".join(keys)
    return (f"SELECT {k}, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_values, min(v) AS least, max(v) AS greatest, "
            f"CAST(sum(c) * sum(c) - sum(c * c) AS BIGINT) AS pairs FROM (SELECT {k}, {dep} AS v, count(*) AS c FROM {table} "
            f"GROUP BY ALL) GROUP BY {k} HAVING count(*) > 1")


def _fd_query(table, keys, dep):
    return lambda spark, sf: verify.fd_violations(load(spark, sf, table), keys, dep).withColumn("pairs", F.col("pairs").cast("long"))


@register("fd_violations_events_nan", f"""
    SELECT min(user_id) AS user_id, count(*) AS n_rows, count(DISTINCT v) FILTER (WHERE NOT isnan(v)) + count(*) FILTER (WHERE isnan(v)) AS n_values,
           CAST(count(*) * count(*) - coalesce(sum(c) FILTER (WHERE NOT isnan(v)), 0) - count(*) FILTER (WHERE isnan(v)) AS BIGINT) AS pairs
    FROM (SELECT user_id, k, v, count(*) OVER (PARTITION BY k, v) AS c FROM
          (SELECT user_id, coalesce(user_id, 0) AS k, coalesce(value, 'nan'::DOUBLE) AS v FROM {EVENTS_SQL}))
    GROUP BY k HAVING n_values > 1""")
def fd_violations_events_nan(spark, sf):
    return verify.fd_violations(marked_events(spark, sf), ["user_id"], "value").selectExpr("user_id", "n_rows", "n_values", "CAST(pairs AS BIGINT) AS pairs")


@register("violation_count_temporal_orders", """
    SELECT CAST(sum(n * (n - 1) - same) / 2 AS BIGINT) AS violations FROM (SELECT sum(c) AS n, sum(c * (c - 1)) AS same FROM
        (SELECT o_custkey, o_orderdate, count(*) AS c FROM orders GROUP BY ALL) GROUP BY o_custkey)""")
def violation_count_temporal_orders(spark, sf):
    earlier = [("o_custkey", "=="), ("o_orderdate", "<")]
    return verify.violation_count(load(spark, sf, "orders"), earlier, verify.Reading(order_temporal=True)).selectExpr("CAST(violations AS BIGINT) AS violations")


@register("violation_count_gap_orders", """
    SELECT CAST(sum(c * (c - 1)) AS BIGINT) AS violations FROM (SELECT t, count(*) AS c FROM
        (SELECT TIMESTAMP '2024-03-10 00:30:00' + to_hours(CAST(o_orderkey % 5 AS INTEGER)) AS t FROM orders) GROUP BY t)""")
def violation_count_gap_orders(spark, sf):
    shifted = load(spark, sf, "orders").selectExpr("o_orderkey", "TIMESTAMP_NTZ '2024-03-10 00:30:00' + make_dt_interval(0, o_orderkey % 5) AS t")
    return verify.violation_count(shifted.select("t"), [("t", "==")]).selectExpr("CAST(violations AS BIGINT) AS violations")


for _name, (_t, _k, _d) in _FDS.items():
    register(_name, _fd_sql(_t, _k, _d))(_fd_query(_t, _k, _d))


_COUNTED = {
    "violation_count_part": ("part", [("p_brand", "=="), ("p_type", "!=")], "p_partkey"),
    "violation_count_two_unequal": ("part", [("p_brand", "=="), ("p_type", "!="), ("p_size", "!=")], "p_partkey"),
    "violation_count_order": ("customer", [("c_nationkey", "=="), ("c_acctbal", "<")], "c_custkey"),
    "violation_count_weak_order": ("part", [("p_brand", "=="), ("p_type", "!="), ("p_size", "<=")], "p_partkey"),
    "violation_count_two_orders": ("lineitem", [("l_suppkey", "=="), ("l_quantity", "<"), ("l_extendedprice", ">")], "rowid"),
    "violation_count_two_weak_orders": ("orders", [("o_custkey", "=="), ("o_orderpriority", "!="), ("o_orderkey", "<="), ("o_totalprice", "<=")], "o_orderkey"),
    "violation_count_key": ("supplier", [("s_nationkey", "==")], "s_suppkey"),
}


def _pair_condition(dc) -> str:
    sql_op = {"==": "=", "!=": "<>"}
    return " AND ".join(f"x.{c} {sql_op.get(o, o)} y.{c}" for c, o in dc)


def _count_query(table, dc):
    return lambda spark, sf: verify.violation_count(load(spark, sf, table), dc).withColumn("violations", F.col("violations").cast("long"))


for _name, (_t, _dc, _id) in _COUNTED.items():
    # Where an ordering is strict a row is no partner of itself.
    _other = "true" if _id == "rowid" else f"x.{_id} <> y.{_id}"
    register(_name, f"SELECT count(*) AS violations FROM {_t} x JOIN {_t} y ON {_other} AND {_pair_condition(_dc)}")(_count_query(_t, _dc))


_ROWS = {
    "violating_rows_fd": ("events", [("user_id", "=="), ("event_type", "!=")], "event_id", "event_id, user_id, event_type"),
    "violating_rows_key": ("part", [("p_name", "=="), ("p_size", "==")], "p_partkey", "p_partkey, p_name, p_size"),
    "violating_rows_order": ("customer", [("c_nationkey", "=="), ("c_acctbal", "<=")], "c_custkey", "c_custkey, c_nationkey, c_acctbal"),
    "violating_rows_two_orders": ("customer", [("c_custkey", "<"), ("c_acctbal", ">")], "c_custkey", "c_custkey, c_acctbal"),
    "violating_rows_grouped_orders": ("orders", [("o_custkey", "=="), ("o_orderkey", "<="), ("o_totalprice", ">=")], "o_orderkey",
                                      "o_orderkey, o_custkey, o_totalprice"),
    "violating_rows_weak_orders": ("part", [("p_brand", "=="), ("p_size", "<="), ("p_retailprice", ">")], "p_partkey",
                                   "p_partkey, p_brand, p_size, p_retailprice"),
    "violating_rows_unequal_order": ("orders", [("o_custkey", "=="), ("o_orderpriority", "!="), ("o_totalprice", ">")], "o_orderkey",
                                     "o_orderkey, o_custkey, o_orderpriority, o_totalprice"),
    "violating_rows_unequal_two_orders": ("orders", [("o_custkey", "=="), ("o_orderpriority", "!="), ("o_totalprice", ">"), ("o_orderkey", "<=")], "o_orderkey",
                                          "o_orderkey, o_custkey, o_orderpriority, o_totalprice"),
    "violating_rows_two_unequal_order": ("orders", [("o_custkey", "=="), ("o_orderpriority", "!="), ("o_orderstatus", "!="), ("o_totalprice", "<")], "o_orderkey",
                                         "o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice"),
    "violating_rows_four_orders": ("lineitem", [("l_suppkey", "=="), ("l_quantity", "<="), ("l_extendedprice", ">="), ("l_discount", "<"), ("l_tax", ">")], "rowid",
                                   "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount"),
}


def _rows_sql(table, dc, key, cols):
    y, x = ("true", "true") if key == "rowid" else (f"y.{key} <> t.{key}", f"x.{key} <> t.{key}")      # a strict ordering rules a row itself out
    return (f"SELECT {cols} FROM {table} t WHERE EXISTS (SELECT 1 FROM {table} y WHERE {y} AND "
            f"{_pair_condition(dc).replace('x.', 't.')}) OR EXISTS (SELECT 1 FROM {table} x WHERE {x} AND "
            f"{_pair_condition(dc).replace('y.', 't.')})")


def _rows_query(table, dc, cols):
    return lambda spark, sf: verify.violating_rows(load(spark, sf, table), dc).select(*cols.split(", "))


for _name, (_t, _dc, _id, _cols) in _ROWS.items():
    register(_name, _rows_sql(_t, _dc, _id, _cols))(_rows_query(_t, _dc, _cols))


_THREE = [("l_suppkey", "=="), ("l_quantity", "<"), ("l_extendedprice", ">"), ("p_retailprice", "<=")]
_JOINED = "(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"
_THREE_COLS = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, p_retailprice"


@register("violating_rows_three_orders", f"WITH j AS {_JOINED} SELECT {_THREE_COLS} FROM j t WHERE EXISTS (SELECT 1 FROM j y WHERE {_pair_condition(_THREE).replace('x.', 't.')}) "
          f"OR EXISTS (SELECT 1 FROM j x WHERE {_pair_condition(_THREE).replace('y.', 't.')})")
def violating_rows_three_orders(spark, sf):
    return verify.violating_rows(lineitem_part(spark, sf), _THREE).select(*_THREE_COLS.split(", "))


@register("violating_rows_real_unequal_order", f"""
    WITH e AS (SELECT event_id, coalesce(user_id, 0) AS k, coalesce(value, 'nan'::DOUBLE) AS v FROM {EVENTS_SQL})
    SELECT t.event_id FROM e t WHERE EXISTS (SELECT 1 FROM e y WHERE y.k = t.k AND y.event_id <> t.event_id AND (y.v <> t.v OR isnan(y.v)))""")
def violating_rows_real_unequal_order(spark, sf):
    return verify.violating_rows(marked_events(spark, sf), [("user_id", "=="), ("value", "!="), ("event_id", "<")]).select("event_id")


@register("violation_witnesses_part", """
    WITH g AS (SELECT p_brand, min(p_type) AS lo, max(p_type) AS hi FROM part GROUP BY 1),
         w AS (SELECT p_brand, p_type, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM part GROUP BY 1, 2)
    SELECT p.p_partkey AS x, CASE WHEN p.p_type <> lo THEN a.first_key ELSE b.last_key END AS y
    FROM part p JOIN g USING (p_brand) JOIN w a ON a.p_brand = p.p_brand AND a.p_type = lo
    JOIN w b ON b.p_brand = p.p_brand AND b.p_type = hi WHERE lo <> hi""")
def violation_witnesses_part(spark, sf):
    return verify.violations(load(spark, sf, "part"), [("p_brand", "=="), ("p_type", "!=")], "p_partkey")


@register("violation_classes_part", """
    SELECT p_partkey, grp AS "group", [a, b] AS classes, n - na - nb + nab AS n_partners FROM (SELECT p_partkey,
        min(p_partkey) OVER (PARTITION BY p_brand) AS grp, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS a,
        min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS b, count(*) OVER (PARTITION BY p_brand) AS n,
        count(*) OVER (PARTITION BY p_brand, p_type) AS na, count(*) OVER (PARTITION BY p_brand, p_size) AS nb,
        count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS nab FROM part) WHERE n - na - nb + nab > 0""")
def violation_classes_part(spark, sf):
    return verify.violation_classes(load(spark, sf, "part"), [("p_brand", "=="), ("p_type", "!="), ("p_size", "!=")], "p_partkey")


def _verified_sql() -> str:
    """Every constraint of the search, its pairs counted one by one."""
    names = [c for c, _ in CUSTOMER_NATION]
    holds = " AND ".join(f"CASE WHEN NOT list_contains(ps, '{c} ==') THEN true ELSE x.{c} = y.{c} END AND CASE WHEN NOT list_contains(ps, '{c} !=') THEN true ELSE x.{c} <> y.{c} END"
                         + "".join(f" AND CASE WHEN NOT list_contains(ps, '{c} {o}') THEN true ELSE x.{c} {o} y.{c} END" for o in ("<", "<=", ">", ">=")) for c in names)
    found = Q.discover_sql(CUSTOMER_NATION_SQL, CUSTOMER_NATION, "c_custkey", 1e-4, 4)
    parsed = ("SELECT denial_constraint, list_transform(string_split(denial_constraint[3:-3], ' & '), lambda p: string_split(p, ' ')[1] || ' ' || string_split(p, ' ')[2]) AS ps "
              f"FROM ({found})")
    return (f"WITH f AS ({parsed}), t AS (SELECT * FROM {CUSTOMER_NATION_SQL}) SELECT denial_constraint, count(x.c_custkey) AS violations, count(x.c_custkey) = 0 AS holds "
            f"FROM f LEFT JOIN (t x JOIN t y ON x.c_custkey <> y.c_custkey) ON {holds} GROUP BY ALL")


@register("verify_discovered_customer_nation", _verified_sql())
def verify_discovered_customer_nation(spark, sf):
    table = customer_nation(spark, sf)
    found = D.discover(table, 1e-4, order_by=["c_custkey"])
    return audit.check_all(table, found).selectExpr("denial_constraint", "CAST(violations AS BIGINT) AS violations", "holds")


# ---- predicate sets -------------------------------------------------------------------------

# One predicate set per order, built from its values: work grows with the table.
_MEMBERS = ["concat('o_orderstatus ', CASE WHEN o_orderstatus = 'F' THEN '==' ELSE '!=' END)",
            "CASE WHEN o_totalprice > 100000 THEN 'o_totalprice >' ELSE 'o_totalprice <=' END",
            "CASE WHEN o_custkey % 3 > 0 THEN concat('o_custkey ', CASE WHEN o_custkey % 2 = 0 THEN '<' ELSE '>=' END) END",
            "CASE WHEN o_totalprice > 250000 THEN concat('o_orderpriority ', CASE WHEN substr(o_orderpriority, 1, 1) < '3' THEN '==' ELSE '!=' END) END",
            "CASE WHEN o_orderkey % 4 = 1 THEN 'o_orderdate ==' END"]
_MEMBERS_SQL = ("(SELECT DISTINCT array_to_string(m, ' & ') AS set_id, m AS members FROM (SELECT list_sort(list_distinct(list_filter(["
                + ", ".join(_MEMBERS) + "], lambda v: v IS NOT NULL))) AS m FROM orders))")


def order_sets(spark, sf) -> DataFrame:
    raw = load(spark, sf, "orders").selectExpr(f"array_compact(array({', '.join(_MEMBERS)})) AS members")
    return predsets.canonical(raw)


@register("predicate_sets_canonical", f"SELECT set_id, len(members) AS size FROM {_MEMBERS_SQL}")
def predicate_sets_canonical(spark, sf):
    return order_sets(spark, sf).select("set_id", F.size("members").cast("long").alias("size"))


_SUBSUME_SQL = (f"SELECT a.set_id AS sub_id, b.set_id AS sup_id FROM {_MEMBERS_SQL} a JOIN {_MEMBERS_SQL} b "
                "ON len(a.members) < len(b.members) AND list_has_all(b.members, a.members)")


@register("subsumption_pairs_orders", _SUBSUME_SQL)
def subsumption_pairs_orders(spark, sf):
    return predsets.subsumption_pairs(order_sets(spark, sf))


@register("minimal_cover_orders", f"WITH s AS {_MEMBERS_SQL} SELECT set_id FROM s b WHERE NOT EXISTS (SELECT 1 FROM s a "
                                  "WHERE len(a.members) < len(b.members) AND list_has_all(b.members, a.members))")
def minimal_cover_orders(spark, sf):
    return predsets.minimal_cover(order_sets(spark, sf)).select("set_id")


@register("supersets_until_orders", f"""
    WITH s AS {_MEMBERS_SQL}, pr AS (SELECT a.set_id AS sub, b.set_id AS sup FROM s a JOIN s b
         ON len(a.members) < len(b.members) AND list_has_all(b.members, a.members))
    SELECT sub AS set_id, sup AS superset_id FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr p1 JOIN pr p2 ON p1.sup = p2.sub
         JOIN s ON s.set_id = p1.sup WHERE p1.sub = pr.sub AND p2.sup = pr.sup AND list_contains(s.members, 'o_custkey <'))""")
def supersets_until_orders(spark, sf):
    return predsets.supersets(order_sets(spark, sf), "array_contains(members, 'o_custkey <')")


@register("subsets_orders", f"SELECT sup_id AS set_id, sub_id AS subset_id FROM ({_SUBSUME_SQL})")
def subsets_orders(spark, sf):
    return predsets.subsets(order_sets(spark, sf))


@register("set_navigation_orders", f"""
    WITH s AS {_MEMBERS_SQL}
    SELECT set_id, member, array_to_string(list_filter(members, lambda v: v <> member), ' & ') AS other_id, 'down' AS direction
    FROM (SELECT set_id, members, unnest(members) AS member FROM s)
    UNION ALL
    SELECT set_id, member, array_to_string(list_sort(list_append(members, member)), ' & ') AS other_id, 'up' AS direction
    FROM s, (SELECT DISTINCT unnest(members) AS member FROM s) m WHERE NOT list_contains(members, member)""")
def set_navigation_orders(spark, sf):
    sets = order_sets(spark, sf)
    down = predsets.without_member(sets).selectExpr("set_id", "member", "from_id AS other_id", "'down' AS direction")
    # Every member seen anywhere, listed once per set through an aggregate (a handful of values).
    listed = sets.selectExpr("explode(members) AS member").agg(F.expr("collect_set(member) AS all_members")).first()[0]
    choices = F.array(*[F.lit(m) for m in sorted(listed)])
    additions = sets.select("set_id", F.explode(F.array_except(choices, "members")).alias("member"))
    up = predsets.with_member(sets, additions).selectExpr("set_id", "member", "to_id AS other_id", "'up' AS direction")
    return down.unionByName(up)


@register("grown_sets_orders", f"""
    WITH s AS {_MEMBERS_SQL}, one AS (SELECT DISTINCT [member] AS members FROM (SELECT unnest(members) AS member FROM s)),
         ms AS (SELECT members[1] AS m FROM one),
         two AS (SELECT DISTINCT list_sort([a.m, b.m]) AS members FROM ms a JOIN ms b ON split_part(a.m, ' ', 1) <> split_part(b.m, ' ', 1)),
         three AS (SELECT DISTINCT list_sort(list_append(members, m)) AS members FROM two JOIN ms
                   ON NOT list_contains(list_transform(members, lambda v: split_part(v, ' ', 1)), split_part(m, ' ', 1)))
    SELECT array_to_string(members, ' & ') AS set_id, len(members) AS size FROM (SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three)""")
def grown_sets_orders(spark, sf):
    singles = order_sets(spark, sf).selectExpr("explode(members) AS member").distinct()
    preds = singles.selectExpr("substring_index(member, ' ', 1) AS col", "substring_index(member, ' ', -1) AS op")
    return (predsets.grown_sets(singles.selectExpr("array(member) AS members"), preds, 3)
            .select("set_id", F.size("members").cast("long").alias("size")))


# ---- rendering, parsing, triage -------------------------------------------------------------

# One constraint line per part, built from its values.
_COLS = "CASE p_partkey % 6 WHEN 0 THEN 'id' WHEN 1 THEN 'rt_id' WHEN 2 THEN 'movie_id' WHEN 3 THEN 'kt_kind' WHEN 4 THEN 'p_size' ELSE 'p_type' END"
_OTHER = "CASE p_size % 5 WHEN 0 THEN 'rt_role' WHEN 1 THEN 'kt_id' WHEN 2 THEN 'p_name' WHEN 3 THEN 'id' ELSE 'p_brand' END"
_OP1 = "CASE length(p_type) % 3 WHEN 0 THEN '<' WHEN 1 THEN '==' ELSE '>=' END"
_OP2 = "CASE WHEN p_retailprice > 950 THEN '>' WHEN p_retailprice > 920 THEN '!=' ELSE '<=' END"
_PARTS = f"{_COLS} AS c1, {_OP1} AS o1, {_OTHER} AS c2, {_OP2} AS o2"
_LINE = ("CASE WHEN p_partkey % 41 = 0 THEN '!( & )' WHEN p_partkey % 37 = 0 THEN '!(' || c1 || ' ' || o1 || ' ' || c1 || ' & )' "
         "ELSE '!(' || c1 || ' ' || o1 || ' ' || c1 || ' & ' || c2 || ' ' || o2 || ' ' || c2 || ' & )' END")
_LOG_SQL = (f"(SELECT p_partkey AS position, p_brand AS section, {_LINE} AS denial_constraint FROM "
            f"(SELECT p_partkey, p_brand, {_PARTS} FROM part))")


def part_log(spark, sf) -> DataFrame:
    return load(spark, sf, "part").selectExpr("p_partkey", "p_brand", *_PARTS_LIST).selectExpr(
        "p_partkey AS position", "p_brand AS section", f"{_LINE} AS denial_constraint")


_PARTS_LIST = [f"{_COLS} AS c1", f"{_OP1} AS o1", f"{_OTHER} AS c2", f"{_OP2} AS o2"]

# The pattern of a comparison, the pairs of columns that name each other, key names, orderings and class names.
_COMPARISON = r"([a-zA-Z0-9_]+)\s*(==|!=|>=|<=|>|<)\s*([a-zA-Z0-9_]+)"
_BODY = r"!\(\s*(.*?)\s*\)"
_LOOKUP_PAIRS = [("kt_id", "kt_kind"), ("rt_id", "rt_role"), ("it_id", "it_info"), ("ct_id", "ct_kind"), ("lt_id", "lt_link"),
                 ("cct_sub_id", "cc_subject_kind"), ("cct_stat_id", "cc_status_kind")]
_KEY_NAME, _ORDERINGS = "^(id|.*_id)$", ["<", "<=", ">", ">="]
_EMPTY, _SINGLE, _LOOKUP = "Empty/Invalid", "Single-column Triviality", "Lookup Name Mapping"
_SPURIOUS, _USEFUL = "Spurious Order Dependency (Sequential sorting artifact)", "Potentially Useful"


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PARSED_SQL = (f"(SELECT position, section, denial_constraint, list_filter(list_transform(string_split(regexp_extract(denial_constraint, '{_BODY}', 1), '&'), "
               f"lambda p: [regexp_extract(p, '{_COMPARISON}', 1), regexp_extract(p, '{_COMPARISON}', 2), regexp_extract(p, '{_COMPARISON}', 3)]), "
               f"lambda t: t[2] <> '') AS ps FROM {_LOG_SQL})")
_NAMED = " OR ".join(f"(list_contains(attrs, '{a}') AND list_contains(attrs, '{b}'))" for a, b in _LOOKUP_PAIRS)
_TRIAGED_SQL = (
    f"(SELECT position, section, denial_constraint, ps, CASE WHEN len(ps) = 0 THEN '{_EMPTY}' WHEN len(attrs) <= 1 THEN '{_SINGLE}' "
    f"WHEN len(attrs) = 2 AND ({_NAMED}) THEN '{_LOOKUP}' WHEN len(list_filter(ps, lambda t: NOT list_contains({_listed(_ORDERINGS)}, t[2]))) = 0 "
    f"AND len(list_filter(attrs, lambda c: regexp_matches(c, '{_KEY_NAME}'))) > 0 THEN '{_SPURIOUS}' ELSE '{_USEFUL}' END AS category "
    f"FROM (SELECT *, list_sort(list_distinct(flatten(list_transform(ps, lambda t: [t[1], t[3]])))) AS attrs FROM {_PARSED_SQL}))")


@register("parse_dcs", f"SELECT position, len(ps) AS n_predicates, array_to_string(list_transform(ps, lambda t: t[1] || t[2] || t[3]), ';') AS parsed FROM {_PARSED_SQL}")
def parse_dcs(spark, sf):
    return triage.parse(part_log(spark, sf)).selectExpr(
        "position", "CAST(size(parsed) AS BIGINT) AS n_predicates",
        "array_join(transform(parsed, p -> concat(p.left, p.op, p.right)), ';') AS parsed")


@register("triage_part_log", f"SELECT position, section, denial_constraint, category, category <> '{_USEFUL}' AS useless FROM {_TRIAGED_SQL}")
def triage_part_log(spark, sf):
    return triage.triage(part_log(spark, sf)).drop("parsed")


@register("triage_summary", f"SELECT section, count(*) AS total, count(*) FILTER (WHERE category = '{_USEFUL}') AS useful, "
                            f"count(*) FILTER (WHERE category <> '{_USEFUL}') AS useless FROM {_TRIAGED_SQL} GROUP BY ROLLUP (section)")
def triage_summary(spark, sf):
    return triage.summary(triage.triage(part_log(spark, sf)))


@register("triage_categories", f"SELECT section, category, count(*) AS n FROM {_TRIAGED_SQL} WHERE category <> '{_USEFUL}' GROUP BY 1, 2")
def triage_categories(spark, sf):
    return triage.category_counts(triage.triage(part_log(spark, sf)))


@register("triage_examples", f"""
    SELECT section, category, CAST(place AS INTEGER) AS place, denial_constraint, greatest(n - 5, 0) AS more FROM (SELECT *,
        row_number() OVER (PARTITION BY section, category ORDER BY position) AS place, count(*) OVER (PARTITION BY section, category) AS n
        FROM {_TRIAGED_SQL} WHERE category <> '{_USEFUL}') WHERE place <= 5""")
def triage_examples(spark, sf):
    return triage.examples(triage.triage(part_log(spark, sf)))


@register("log_sections", f"""
    SELECT p_partkey AS position, '!(x)' AS denial_constraint, coalesce(last_value(head IGNORE NULLS) OVER (ORDER BY p_partkey
        ROWS UNBOUNDED PRECEDING), 'Unknown') AS section
    FROM (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN p_brand END AS head, p_size FROM part) QUALIFY p_size % 9 <> 0""")
def log_sections(spark, sf):
    lines = load(spark, sf, "part").selectExpr(
        "'log' AS file", "p_partkey DIV 64 AS block", "p_partkey AS position",
        "CASE WHEN p_size % 9 = 0 THEN concat('--- ', p_brand, ' ---') ELSE '!(x)' END AS line")
    return label_sections(lines).select("position", "section", "denial_constraint")


@register("dc_log_file", f"SELECT section, denial_constraint, count(*) AS n FROM {_LOG_SQL} GROUP BY 1, 2")
def dc_log_file(spark, sf):
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    log = part_log(spark, sf).groupBy("section").agg(F.sort_array(F.collect_list("denial_constraint")).alias("found"))
    log.select(F.explode(F.concat(F.array(F.concat(F.lit("--- "), "section", F.lit(" ---"))), "found"))).write.text(path)
    return read_dc_log(spark, path).groupBy("section", "denial_constraint").agg(F.count("*").alias("n"))


@register("render_styles", f"""
    SELECT p_partkey, '!(' || c1 || ' ' || o1 || ' ' || c1 || ' & ' || c2 || ' ' || o2 || ' ' || c2 || ' & )' AS default_text,
           '!(t1.' || c1 || ' ' || CASE o1 WHEN '==' THEN '=' ELSE o1 END || ' t2.' || c1 || ' & t1.' || c2 || ' ' || o2 || ' t2.' || c2 || ')' AS sql_text
    FROM (SELECT p_partkey, {_PARTS} FROM part)""")
def render_styles(spark, sf):
    shaped = load(spark, sf, "part").selectExpr("p_partkey", *_PARTS_LIST).selectExpr(
        "p_partkey", "array(struct(c1 AS col, o1 AS op), struct(c2 AS col, o2 AS op)) AS predicates")
    return shaped.select("p_partkey", dc_text(F.col("predicates")).alias("default_text"),
                         dc_text(F.col("predicates"), "sql").alias("sql_text"))


# ---- joins, sources, sinks ------------------------------------------------------------------

# Written out, so that the SQL does not depend on the table of joins under test.
_JOIN_SQL = {
    "join_lineitem_orders": "SELECT * EXCLUDE (o_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "join_customer_orders": "SELECT * EXCLUDE (o_custkey) FROM customer JOIN orders ON c_custkey = o_custkey",
    "join_customer_nation": "SELECT * EXCLUDE (n_nationkey) FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join_nation_supplier": "SELECT * EXCLUDE (s_nationkey) FROM nation JOIN supplier ON n_nationkey = s_nationkey",
    "join_nation_region": "SELECT * EXCLUDE (r_regionkey) FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_lineitem_part": "SELECT * EXCLUDE (p_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey",
    "join_lineitem_supplier": "SELECT * EXCLUDE (s_suppkey) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
}


def _join_query(name: str) -> Query:
    j = workloads.STAR_JOINS[name]
    return lambda spark, sf: workloads.star_join(loaded(spark, sf, j.left, j.right), name)


for _name, _j in workloads.STAR_JOINS.items():
    if "partsupp" not in (_j.left, _j.right):
        register(_name, _JOIN_SQL[_name])(_join_query(_name))


@register("join_lineitem_part_supplier", "SELECT * EXCLUDE (p_partkey, s_suppkey) FROM lineitem JOIN part ON l_partkey = p_partkey "
                                         "JOIN supplier ON l_suppkey = s_suppkey")
def join_lineitem_part_supplier(spark, sf):
    return workloads.lineitem_part_supplier(loaded(spark, sf, "lineitem", "part", "supplier"))


@register("join_lineitem_partsupp", "SELECT * EXCLUDE (ps_partkey, ps_suppkey) FROM lineitem JOIN (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, "
                                    "count(*) AS ps_lines FROM lineitem GROUP BY 1, 2) ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def join_lineitem_partsupp(spark, sf):
    lines = load(spark, sf, "lineitem")
    supplied = lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.count(F.lit(1)).alias("ps_lines"))
    return workloads.star_join({"lineitem": lines, "partsupp": supplied}, "join_lineitem_partsupp")


@register("join_prefixed_orders", "SELECT o.o_orderkey AS ord_o_orderkey, o.o_custkey AS ord_o_custkey, o.o_orderstatus AS ord_o_orderstatus, "
          "o.o_totalprice AS ord_o_totalprice, o.o_orderdate AS ord_o_orderdate, o.o_orderpriority AS ord_o_orderpriority, "
          "c.c_name AS cu_c_name, c.c_nationkey AS cu_c_nationkey, c.c_acctbal AS cu_c_acctbal, c.c_mktsegment AS cu_c_mktsegment "
          "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_prefixed_orders(spark, sf):
    return workloads.prefixed_join((load(spark, sf, "orders"), "ord", "o_custkey"),
                                   (load(spark, sf, "customer"), "cu", "c_custkey"), ("cu_c_custkey",))


@register("join_dimension_twice", "SELECT o_orderkey, c_nationkey, s_nationkey, a.n_name AS customer_nation, b.n_name AS supplier_nation FROM lineitem "
          "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
          "JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey")
def join_dimension_twice(spark, sf):
    t = loaded(spark, sf, "lineitem", "orders", "customer", "supplier", "nation")
    fact = (t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
            .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
            .select("o_orderkey", "c_nationkey", "s_nationkey"))
    return workloads.twice_joined(fact, t["nation"], ("c_nationkey", "customer_nation"), ("s_nationkey", "supplier_nation"),
                                  "n_nationkey", "n_name")


@register("csv_round_trip_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def csv_round_trip_orders(spark, sf):
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    tables.export_columns(load(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], path)
    return tables.read_input(spark, path).selectExpr("CAST(o_orderkey AS BIGINT) AS o_orderkey",
                                                     "CAST(o_custkey AS BIGINT) AS o_custkey", "o_orderstatus", "o_totalprice")


@register("typed_csv_customer", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def typed_csv_customer(spark, sf):
    path = f"{shared_dir(spark)}/typed-{uuid.uuid4().hex}"
    typed = load(spark, sf, "customer").selectExpr("c_custkey AS `id(Integer)`", "c_name AS `name(String)`", "c_acctbal AS `balance(Double)`")
    tables.export_columns(typed, typed.columns, path)
    return tables.read_typed_csv(spark, path)


@register("typed_csv_rejects_orders", "SELECT 'price' AS \"column\", 'double' AS wanted, 'about ' || CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 7 = 0 "
          "UNION ALL SELECT 'cust', 'bigint', '#' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 11 = 0")
def typed_csv_rejects_orders(spark, sf):
    path = f"{shared_dir(spark)}/rejects-{uuid.uuid4().hex}"
    load(spark, sf, "orders").selectExpr(
        "o_orderkey AS `id(Integer)`", "CASE WHEN o_orderkey % 11 = 0 THEN concat('#', o_custkey) ELSE CAST(o_custkey AS STRING) END AS `cust(Integer)`",
        "CASE WHEN o_orderkey % 7 = 0 THEN concat('about ', o_orderkey) ELSE CAST(o_totalprice AS STRING) END AS `price(Double)`",
        "o_orderstatus AS `status(String)`").write.option("header", True).option("quote", "'").csv(path)
    return tables.typed_csv_rejects(spark, path)


@register("explicit_csv_rejects_supplier", "SELECT s_suppkey % 5 = 0 AS no_number, count(*) AS n FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 GROUP BY 1")
def explicit_csv_rejects_supplier(spark, sf):
    path = f"{shared_dir(spark)}/rejects-{uuid.uuid4().hex}"
    load(spark, sf, "supplier").selectExpr(
        "concat_ws(',', CASE WHEN s_suppkey % 5 = 0 THEN 'no number' ELSE CAST(s_suppkey AS STRING) END, CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 3 = 0 THEN '1,2' ELSE '1' END) AS value").write.text(path)
    bad = tables.explicit_csv_rejects(spark, path, "a bigint, b bigint, c bigint")
    return bad.groupBy(F.col("cause").contains("a").alias("no_number")).agg(F.count("*").alias("n"))


@register("explicit_csv_supplier", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def explicit_csv_supplier(spark, sf):
    path = f"{shared_dir(spark)}/plain-{uuid.uuid4().hex}"
    load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("sep", "|").csv(path)
    return tables.read_explicit_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double", delimiter="|")


@register("materialised_join_nation", "SELECT * EXCLUDE (r_regionkey) FROM nation JOIN region ON n_regionkey = r_regionkey")
def materialised_join_nation(spark, sf):
    return tables.materialise(workloads.star_join(loaded(spark, sf, "nation", "region"), "join_nation_region"))


_RUNS_SQL = ("SELECT l_returnflag AS scenario, l_linestatus AS engine, l_linenumber AS attrs, CAST(l_quantity AS BIGINT) AS n_rows, "
             "l_tax AS threshold, floor(l_extendedprice) AS seconds, floor(l_discount * 1000) AS gigabytes, l_discount < 0.09 AS ok FROM lineitem")


@register("bench_means", f"SELECT scenario, engine, attrs, n_rows, threshold, avg(seconds) AS mean_seconds, "
                         f"avg(gigabytes) AS mean_gigabytes, count(*) AS n_runs FROM ({_RUNS_SQL}) WHERE ok GROUP BY ALL")
def bench_means(spark, sf):
    runs = load(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS scenario", "l_linestatus AS engine", "l_linenumber AS attrs", "CAST(l_quantity AS BIGINT) AS n_rows",
        "l_tax AS threshold", "floor(l_extendedprice) AS seconds", "floor(l_discount * 1000) AS gigabytes", "l_discount < 0.09 AS ok")
    return workloads.run_means(runs)
