"""Exact checks of denial constraints on the full data, without pairing rows up.

A constraint is a list of ``(column, op)``.  Groups may hold any share of the rows: everything is
pre-aggregated before a shuffle, joined back by key, and no row pair is ever enumerated.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.operators import dominance, inversions
from gainsay.operators.schema_model import (RAW_STRING_BYTES, REAL, STRING, ColumnInfo, column_infos, encoded_value,
                                            predicate_space, quoted)
from gainsay.shared import staged

MIRROR = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
_ROW = "__row"
#: The largest set of violating combinations that is broadcast to the rows.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Reading:
    """How values are read, as in discovery: times may be ordered, reals narrowed to 32 bits."""

    order_temporal: bool = False
    parity: bool = False


def _encoded(df: DataFrame, cols: Sequence[str], reading: Reading, keep: bool = False) -> tuple[DataFrame, dict[str, ColumnInfo]]:
    infos = {c.name: c for c in column_infos(df.schema, reading.order_temporal)}
    missing = [c for c in cols if c not in infos]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    used = {c: infos[c] for c in dict.fromkeys(cols)}
    values = [encoded_value(df.schema[c], i, reading.parity, compact=True).alias(f"v{i.col_id}") for c, i in used.items()]
    row = [F.struct(*[quoted(f.name) for f in df.schema.fields]).alias(_ROW)] if keep else []
    return df.select(*row, *values), used


def _split(dc: Sequence[tuple[str, str]]) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    seen: set[str] = set()
    for col, op in dc:
        if op not in MIRROR:
            raise ValueError(f"unknown operator {op!r}")
        if col in seen:
            raise ValueError(f"two predicates on column {col!r}")
        seen.add(col)
    return ([c for c, o in dc if o == "=="], [c for c, o in dc if o == "!="],
            [(c, o) for c, o in dc if o not in ("==", "!=")])


def _check_orders(orders: Sequence[tuple[str, str]], used: dict[str, ColumnInfo]) -> None:
    for col, op in orders:
        if used[col].type_class == STRING:
            raise ValueError(f"{op} is not defined for {STRING} column {col!r}")


def _no_nan(cols: Sequence[str], used: dict[str, ColumnInfo]) -> str:
    tests = [f"NOT isnan(v{used[c].col_id})" for c in cols if used[c].type_class == REAL]
    return " AND ".join(tests) or "true"


def marginals(df: DataFrame, reading: Reading = Reading()) -> DataFrame:
    """Exact pairs and probability of every predicate over the N(N-1) ordered pairs.

    One grouping per column, each reading only that column; counts are DECIMAL(38, 0), since
    N(N-1) leaves the bigint range from three billion rows on.
    """
    parts = []
    for f, c in zip(df.schema.fields, column_infos(df.schema, reading.order_temporal)):
        nan = "isnan(v)" if c.type_class == REAL else "false"
        counts = df.select(encoded_value(f, c, reading.parity, compact=True).alias("v")).groupBy("v").agg(F.expr("count(1) AS c"))
        big = "CAST(c AS DECIMAL(19,0)) * CAST(c - 1 AS DECIMAL(19,0))"
        parts.append(counts.agg(
            F.expr("CAST(coalesce(sum(c), 0) AS DECIMAL(19,0)) AS n"),
            F.expr(f"CAST(coalesce(sum(CASE WHEN {nan} THEN c END), 0) AS DECIMAL(19,0)) AS nans"),
            F.expr(f"CAST(coalesce(sum(CASE WHEN NOT {nan} THEN {big} END), 0) AS DECIMAL(38,0)) AS eq"))
            .withColumn("col_id", F.lit(c.col_id)))
    per_column = functools.reduce(DataFrame.unionByName, parts)
    half = "CAST((m * (m - 1) - eq) / 2 AS DECIMAL(38,0))"
    pairs = (f"CASE op WHEN '==' THEN eq WHEN '!=' THEN CAST(n * (n - 1) - eq AS DECIMAL(38,0)) "
             f"WHEN '>' THEN {half} WHEN '<' THEN {half} ELSE CAST({half} + eq AS DECIMAL(38,0)) END")
    return (predicate_space(df, reading.order_temporal).join(per_column.selectExpr("*", "CAST(n - nans AS DECIMAL(19,0)) AS m"), "col_id")
            .selectExpr("pred_id", "col", "op", f"{pairs} AS pairs",
                        "CAST(n * (n - 1) AS DECIMAL(38,0)) AS all_pairs")
            .selectExpr("*", "CASE WHEN all_pairs > 0 THEN CAST(pairs AS DOUBLE) / CAST(all_pairs AS DOUBLE) END AS prob"))


def violation_count(df: DataFrame, dc: Sequence[tuple[str, str]], reading: Reading = Reading()) -> DataFrame:
    """One row ``violations``: ordered pairs of distinct rows that satisfy every predicate.

    Pairs equal on E and different on all of D number the alternating sum over the subsets T of D
    of the pairs equal on E and T, so groupings suffice.  Of a pair with different values exactly one direction
    satisfies an ordering; under two orderings the pairs in which both columns rise together are counted as well.
    """
    same, differ, orders = _split(dc)
    if len(orders) > 2:
        raise ValueError("counting pairs under three orderings is not supported; use violating_rows or holds")
    values, used = _encoded(df, [c for c, _ in dc], reading)
    _check_orders(orders, used)
    name = {c: f"v{i.col_id}" for c, i in used.items()}
    ordered = [c for c, _ in orders]
    base = values.groupBy(*name.values()).agg(F.expr("count(1) AS c")).where(_no_nan(ordered, used))
    if differ or orders:
        base = staged(base)
    if len(orders) == 2:
        sums = []
        for r in range(len(differ) + 1):
            for t in itertools.combinations(differ, r):
                keys = [name[c] for c in (*same, *t)]
                clean = base.where(_no_nan([*same, *t], used))
                pairs = inversions.ordered_pairs(clean, keys, *[(name[c], o) for c, o in orders])
                sums.append(pairs.selectExpr(f"CAST(2 * {(-1) ** r} * pairs AS DECIMAL(38,0)) AS s"))
        return functools.reduce(DataFrame.unionByName, sums).agg(F.expr("CAST(coalesce(sum(s), 0) / 2 AS DECIMAL(38,0)) AS violations"))
    terms: list[tuple[float, list[str]]] = []

    def add(weight: float, equal: list[str], unequal: list[str]) -> None:
        for r in range(len(unequal) + 1):
            for t in itertools.combinations(unequal, r):
                terms.append((weight * (-1) ** r, equal + list(t)))

    if not orders:
        add(2, same, differ)
    else:
        add(1, same, differ + ordered)
        if orders[0][1] in ("<=", ">="):
            add(2, same + ordered, differ)
    sums = []
    for weight, equal in terms:
        groups = base.where(_no_nan(equal, used)).groupBy(*[name[c] for c in equal]).agg(F.expr("sum(c) AS c"))
        big = "CAST(c AS DECIMAL(19,0)) * CAST(c - 1 AS DECIMAL(19,0))"
        sums.append(groups.agg(F.expr(f"CAST(coalesce(sum({big}), 0) AS DECIMAL(38,0)) * {int(weight)} AS s")))
    total = functools.reduce(DataFrame.unionByName, sums)
    return total.agg(F.expr("CAST(sum(s) / 2 AS DECIMAL(38,0)) AS violations"))


def violating_rows(df: DataFrame, dc: Sequence[tuple[str, str]], reading: Reading = Reading()) -> DataFrame:
    """Rows of ``df`` that take part in a violation, in either role."""
    values, names, flagged = _flag(df, dc, reading)
    hits = staged(flagged.where("hit").select(*names))
    # Combinations that violate go to the rows where they are few; else both sides are shuffled by the join, which splits frequent keys.
    width = sum(16 if values.schema[n].dataType.typeName() in ("long", "double") else 16 + RAW_STRING_BYTES for n in names)
    few = hits.count() * width <= BROADCAST_BYTES
    return values.join(F.broadcast(hits) if few else hits.hint("rebalance"), names, "left_semi").select(f"{_ROW}.*")


def holds(df: DataFrame, dc: Sequence[tuple[str, str]], reading: Reading = Reading()) -> bool:
    """The full data has no violation; ``dc`` may be the ``predicates`` of a discovered constraint."""
    return _flag(df, dc, reading)[2].where("hit").isEmpty()


def _flag(df: DataFrame, dc: Sequence[tuple[str, str]], reading: Reading) -> tuple[DataFrame, list[str], DataFrame]:
    """The rows with their compared values, the names of these, and per distinct combination whether it violates.

    Everything is decided on counted combinations, so no row and no other column of it moves before the last join.
    """
    same, differ, orders = _split(dc)
    values, used = _encoded(df, [c for c, _ in dc], reading, keep=True)
    _check_orders(orders, used)
    name = {c: f"v{i.col_id}" for c, i in used.items()}
    keys = [name[c] for c in same]
    names = list(name.values())
    groups = values.groupBy(*names).agg(F.expr("count(1) AS c"))
    ok = _no_nan(same, used)
    shape = (len(differ), len(orders))
    if shape[1] == 0 and (shape[0] or keys):
        return values, names, _flag_unequal(groups, keys, [name[c] for c in differ], ok,
                                            [_no_nan([c], used) for c in differ])
    if shape == (0, 1):
        (col, op), = orders
        return values, names, _flag_one_order(groups, keys, name[col], op, f"{ok} AND {_no_nan([col], used)}")
    if shape == (1, 1) and used[differ[0]].type_class != REAL:
        (col, op), = orders
        return values, names, _flag_unequal_order(groups, keys, name[differ[0]], name[col], op, f"{ok} AND {_no_nan([col], used)}")
    if shape == (0, 2):
        (c1, o1), (c2, o2) = orders
        return values, names, _flag_two_orders(groups, keys, (name[c1], o1), (name[c2], o2), f"{ok} AND {_no_nan([c1, c2], used)}")
    # Any other number of inequalities and orderings: points of small groups with each other, those of large ones against bounding boxes.
    clean = groups.where(f"{ok} AND {_no_nan([c for c, _ in orders], used)}")
    real = [name[c] for c in differ if used[c].type_class == REAL]
    clean = staged(clean)
    found = dominance.either(clean, keys, [(name[c], o) for c, o in orders], [name[c] for c in differ], real)
    return values, names, found.withColumn("hit", F.lit(True))


def _attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the facts of their group; without keys the group is one row.

    The groups are rebalanced, so the join shuffles both of its sides itself: only then does adaptive execution split
    the partition of a frequent key.
    """
    if keys:
        return rows.join(groups.hint("rebalance"), list(keys), "left")
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(groups.withColumn("__one", F.lit(1))), "__one", "left").drop("__one")


def _flag_unequal(values: DataFrame, keys: list[str], differ: list[str], ok: str, no_nan: list[str]) -> DataFrame:
    """Per row: partners equal on the keys and different on every other column, by counts."""
    out, terms = values, []
    for r in range(len(differ) + 1):
        for t in itertools.combinations(range(len(differ)), r):
            cols = keys + [differ[k] for k in t]
            clean = " AND ".join([ok] + [no_nan[k] for k in t])
            cnt = "n" + "_".join(str(k) for k in t)
            counts = values.where(clean).groupBy(*cols).agg(F.expr(f"sum(c) AS {cnt}"))
            out = _attach(out, counts, cols)
            # A NaN row equals no row, itself included; the row itself is no partner.
            terms.append(f"{'+' if r % 2 == 0 else '-'} (CASE WHEN {clean} THEN coalesce({cnt}, 0) - 1 ELSE 0 END)")
    return out.selectExpr(*keys, *differ, f"(0 {' '.join(terms)}) > 0 AS hit")


def _flag_one_order(values: DataFrame, keys: list[str], v: str, op: str, ok: str) -> DataFrame:
    groups = values.where(ok).groupBy(*keys).agg(F.expr(f"min(struct({v} AS v, c)) AS lo"), F.expr(f"max(struct({v} AS v, c)) AS hi"),
                                        F.expr("sum(c) AS n"))
    # Either role: a strict ordering needs a differing partner, otherwise any partner will do.
    test = "lo.v <> hi.v" if op in ("<", ">") else "n > 1"
    return _attach(values, groups, keys).selectExpr(*keys, v, f"coalesce({ok} AND {test}, false) AS hit")


def _better(op: str) -> tuple[str, str]:
    """For ``x op y``: the extreme of y that satisfies it first, and its opposite order."""
    return ("min", "ASC") if op in (">", ">=") else ("max", "DESC")


def _flag_unequal_order(values: DataFrame, keys: list[str], u: str, v: str, op: str, ok: str) -> DataFrame:
    """Per key the best value and the best one among the other ``u``: enough to serve every row."""
    out, tests = values, []
    clean = values.where(ok)
    for side, o in (("x", op), ("y", MIRROR[op])):
        pick, _ = _better(o)
        per_u = clean.groupBy(*keys, u).agg(F.expr(f"{pick}({v}) AS v"))
        first = per_u.groupBy(*keys).agg(F.expr(f"{pick}(struct(v, {u} AS u)) AS best"))
        other = (_attach(per_u, first, keys).where(f"{u} <> best.u")
                 .groupBy(*keys).agg(F.expr(f"{pick}(v) AS runner")))
        both = first.join(other, keys, "left") if keys else _attach(first, other, keys)
        out = _attach(out, both.selectExpr(*keys, f"best AS best_{side}", f"runner AS runner_{side}"), keys)
        tests.append(f"({v} {o} CASE WHEN {u} <> best_{side}.u THEN best_{side}.v ELSE runner_{side} END)")
    return out.selectExpr(*keys, u, v, f"coalesce({ok} AND ({' OR '.join(f'coalesce({t}, false)' for t in tests)}), false) AS hit")


def _flag_two_orders(values: DataFrame, keys: list[str], first: tuple[str, str], second: tuple[str, str],
                     ok: str) -> DataFrame:
    """Running extreme of the second column over the rows strictly before in the first.

    Distinct (keys, v) are range-partitioned and staged, so a group of any size is spread over
    pieces; each piece gets the extreme of the earlier pieces of its group, then one window inside
    the piece finishes the job.
    """
    (v, o1), (w, o2) = first, second
    clean = values.where(ok)
    per_v = clean.groupBy(*keys, v).agg(F.expr(f"min({w}) AS lo"), F.expr(f"max({w}) AS hi"))
    pieces = staged(per_v.repartitionByRange(*keys, v).withColumn("piece", F.spark_partition_id()))
    out, tests = values, []
    for side, a, b in (("x", o1, o2), ("y", MIRROR[o1], MIRROR[o2])):
        pick, direction = _better(b)
        far, order = ("lo" if pick == "min" else "hi"), ("ASC" if a in (">", ">=") else "DESC")
        by = ", ".join(keys)
        summary = pieces.groupBy(*keys, "piece").agg(F.expr(f"{pick}({far}) AS far"))
        over = f"OVER (PARTITION BY {by or '0'} ORDER BY piece {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        carried = summary.selectExpr(*keys, "piece", f"{pick}(far) {over} AS carried")
        inside = (f"OVER (PARTITION BY {', '.join([*keys, 'piece'])} ORDER BY {v} {order} "
                  "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        least = "least" if pick == "min" else "greatest"
        before = (pieces.selectExpr(*keys, v, "piece", f"{far} AS same_{side}", f"{pick}({far}) {inside} AS inside")
                  .join(carried, [*keys, "piece"])
                  .selectExpr(*keys, v, f"same_{side}", f"{least}(inside, carried) AS before_{side}"))
        out = _attach(out, before, [*keys, v])
        test = [f"{w} {b} before_{side}"]
        if a in (">=", "<="):
            # Ties in v count as well; the row itself only matters when both are non-strict.
            strict = {">=": ">", "<=": "<"}.get(b, b)
            test.append(f"{w} {strict} same_{side}")
        tests += test
    if o1 in (">=", "<=") and o2 in (">=", "<="):
        tests.append("c > 1")
    return out.selectExpr(*keys, v, w, f"coalesce({ok} AND ({' OR '.join(f'coalesce({t}, false)' for t in tests)}), false) AS hit")


def fd_violations(df: DataFrame, keys: Sequence[str], dependent: str) -> DataFrame:
    """Groups that break ``keys -> dependent``: their rows, distinct values, extremes and pairs.

    Values are compared in encoded form, like everywhere: NULL is 0 or the empty text, and NaN differs from every value,
    itself included, so a NaN in a key is in no group and each NaN is a value of its own.  Keys and extremes are shown as they are.
    """
    infos = {c.name: c for c in column_infos(df.schema)}
    nan = {c: infos[c].type_class == REAL for c in (*keys, dependent)}
    code = {c: encoded_value(df.schema[c], infos[c], compact=True) for c in (*keys, dependent)}
    values = df.select(*[code[c].alias(f"__k{i}") for i, c in enumerate(keys)], *[quoted(c).alias(f"__s{i}") for i, c in enumerate(keys)],
                       code[dependent].alias("__v"), quoted(dependent).alias("__d"))
    names = [f"__k{i}" for i in range(len(keys))]
    for i, c in enumerate(keys):
        if nan[c]:
            values = values.where(f"NOT isnan(__k{i})")
    counted = values.groupBy(*names, "__v").agg(
        F.expr("count(1) AS __c"), *[F.min(f"__s{i}").alias(f"__s{i}") for i in range(len(keys))], F.min("__d").alias("__lo"), F.max("__d").alias("__hi"))
    own = "CASE WHEN isnan(__v) THEN __c ELSE 1 END" if nan[dependent] else "1"
    same = "CASE WHEN isnan(__v) THEN __c ELSE __c * __c END" if nan[dependent] else "__c * __c"
    same = same.replace("__c * __c", "CAST(__c AS DECIMAL(19,0)) * CAST(__c AS DECIMAL(19,0))")
    return (counted.groupBy(*names)
            .agg(*[F.min(f"__s{i}").alias(f"__s{i}") for i in range(len(keys))], F.expr("sum(__c) AS __n"), F.expr(f"sum({own}) AS __m"),
                 F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.expr(f"sum({same}) AS __same"))
            .where("__m > 1")
            .select(*[F.col(f"__s{i}").alias(c) for i, c in enumerate(keys)], F.col("__n").alias("n_rows"), F.col("__m").alias("n_values"),
                    F.col("__lo").alias("least"), F.col("__hi").alias("greatest"),
                    F.expr("CAST(CAST(__n AS DECIMAL(19,0)) * CAST(__n AS DECIMAL(19,0)) - __same AS DECIMAL(38,0))").alias("pairs")))


def violations(df: DataFrame, dc: Sequence[tuple[str, str]], row_key: str, reading: Reading = Reading()) -> DataFrame:
    """``(x, y)``: every row that violates as the first of the pair, with one partner as witness.

    For constraints with ``==`` keys and one ``!=`` or strict ordering: the partner is the row with
    the smallest or largest value of the group, so the output has at most one pair per row.
    """
    same, differ, orders = _split(dc)
    if len(differ) + len(orders) != 1 or (orders and orders[0][1] in ("<=", ">=")):
        raise ValueError("witnesses need == keys and exactly one != or strict ordering")
    col, op = (differ[0], "!=") if differ else orders[0]
    values, used = _encoded(df, [c for c, _ in dc], reading, keep=True)
    _check_orders(orders, used)
    if differ and used[col].type_class == REAL:
        raise ValueError("a REAL inequality may meet NaN; use violating_rows")
    keys, v = [f"v{used[c].col_id}" for c in same], f"v{used[col].col_id}"
    clean = values.where(_no_nan([c for c, _ in dc], used)).selectExpr(f"{_ROW}.`{row_key}` AS x", *keys, v)
    groups = clean.groupBy(*keys).agg(F.expr(f"min(struct({v} AS v, x)) AS lo"), F.expr(f"max(struct({v} AS v, x)) AS hi"))
    met = _attach(clean, groups, keys)
    if op == "!=":
        return (met.where("lo.v <> hi.v").selectExpr("x", f"CASE WHEN {v} <> lo.v THEN lo.x ELSE hi.x END AS y"))
    best = "lo" if op == ">" else "hi"
    return met.where(f"{v} {op} {best}.v").selectExpr("x", f"{best}.x AS y")


def violation_classes(df: DataFrame, dc: Sequence[tuple[str, str]], row_key: str, reading: Reading = Reading()) -> DataFrame:
    """All violating pairs of a constraint of ``==`` and ``!=``, factorised: ``(row_key, group, classes, n_partners)``, a row per violating row.

    ``group`` is the least row key with the same values under ``==``, ``classes`` per ``!=`` column the least one that also shares its value there.
    Two rows violate exactly where their groups are equal and their classes differ in every place, and ``n_partners`` counts
    these; so a result as long as the rows stands for any number of pairs.  ``row_key`` is unique and not null; a NaN under ``!=`` is a class of its own.
    """
    same, differ, orders = _split(dc)
    if orders or not differ:
        raise ValueError("classes need == and at least one !=")
    values, used = _encoded(df, [c for c, _ in dc], reading, keep=True)
    keys, cols = [f"v{used[c].col_id}" for c in same], [f"v{used[c].col_id}" for c in differ]
    rows = values.where(_no_nan(same, used)).selectExpr(f"{_ROW}.`{row_key}` AS `{row_key}`", *keys, *cols)
    counted = rows.groupBy(*keys, *cols).agg(F.expr("count(1) AS c"), F.min(quoted(row_key)).alias("first"))
    counted = staged(counted)
    out = _attach(rows, counted.groupBy(*keys).agg(F.min("first").alias("group")), keys)
    terms = []
    for r in range(len(cols) + 1):
        for t in itertools.combinations(range(len(cols)), r):
            by, clean = keys + [cols[k] for k in t], _no_nan([differ[k] for k in t], used)
            cnt = "n" + "_".join(map(str, t))
            facts = counted.where(clean).groupBy(*by).agg(F.expr(f"sum(c) AS {cnt}"), *([F.min("first").alias(f"f{t[0]}")] if r == 1 else []))
            out = _attach(out, facts, by)
            terms.append(f"{'+' if r % 2 == 0 else '-'} (CASE WHEN {clean} THEN coalesce({cnt}, 0) - 1 ELSE 0 END)")
    classes = ", ".join(f"CASE WHEN {_no_nan([c], used)} THEN f{k} ELSE `{row_key}` END" for k, c in enumerate(differ))
    return (out.selectExpr(f"`{row_key}`", "group", f"array({classes}) AS classes", f"CAST(0 {' '.join(terms)} AS BIGINT) AS n_partners").where("n_partners > 0"))
