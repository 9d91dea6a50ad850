"""Checks all constraints of a result at once.

The number of pairs behind a constraint with equalities, inequalities and at most one ordering is an alternating sum over groupings.
Constraints of one result ask for many of the same groupings, and for parts of each other's.  So the column sets of all of them are
planned together: sets are gathered under few wide ones, the table is grouped once by each of these, and every set beneath is a
roll-up of its counts.  All of it is one plan.  Constraints with more orderings are checked one by one after that.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.operators import verify
from gainsay.operators.schema_model import REAL
from gainsay.shared import local_table

#: Columns of a wide set that sets are gathered under, unless a constraint itself asks for more.
WIDE = 4


@dataclass(frozen=True)
class Term:
    """Pairs of rows equal in ``cols``, among the rows without NaN in ``guard``; ``weight`` counts them, in halves."""

    weight: int
    cols: frozenset[str]
    guard: str | None


def terms_of(dc: Sequence[tuple[str, str]], real: set[str]) -> list[Term]:
    """The groupings whose pairs add up to twice the violations of a constraint with at most one ordering."""
    same, differ, orders = verify._split(dc)
    guard = next((c for c, _ in orders if c in real), None)
    out = []

    def add(weight: int, equal: list[str], unequal: list[str]) -> None:
        for r in range(len(unequal) + 1):
            for t in itertools.combinations(unequal, r):
                cols = frozenset([*equal, *t])
                out.append(Term(weight * (-1) ** r, cols, None if guard in cols else guard))

    if not orders:
        add(2, same, differ)
    else:
        add(1, same, [*differ, orders[0][0]])
        if orders[0][1] in ("<=", ">="):
            add(2, [*same, orders[0][0]], differ)
    return out


def gathered(sets: set[frozenset[str]], wide: int = WIDE) -> dict[frozenset[str], set[frozenset[str]]]:
    """Few wide sets, each with the sets that roll up from it."""
    tops: list[set[str]] = []
    for s in sorted(sets, key=lambda s: (-len(s), sorted(s))):
        home = next((t for t in tops if s <= t), None) or next((t for t in tops if len(s | t) <= wide), None)
        if home is None:
            tops.append(set(s))
        else:
            home |= s
    under: dict[frozenset[str], set[frozenset[str]]] = {frozenset(t): set() for t in tops}
    for s in sets:
        under[min((t for t in under if s <= t), key=lambda t: (len(t), sorted(t)))].add(s)
    return {t: held for t, held in under.items() if held}


def check_all(df: DataFrame, constraints: DataFrame, reading: verify.Reading = verify.Reading()) -> DataFrame:
    """``denial_constraint``, ``violations`` (ordered pairs, DECIMAL(38, 0)) and ``holds`` of every row of ``constraints``.

    ``constraints`` holds ``denial_constraint`` and ``predicates``, as discovery returns them.  Pairs are counted for up to two orderings; beyond
    that ``violations`` is null and only ``holds`` is told.
    """
    spark = df.sparkSession
    rows = [(r["denial_constraint"], [(p["col"], p["op"]) for p in r["predicates"]]) for r in constraints.select("denial_constraint", "predicates").collect()]
    orders = {name: len(verify._split(dc)[2]) for name, dc in rows}
    plain = {name: dc for name, dc in rows if orders[name] <= 1}
    parts = [_counted(df, plain, reading)] if plain else []
    for name, dc in rows:
        if orders[name] == 2:
            parts.append(verify.violation_count(df, dc, reading).select(F.lit(name).alias("denial_constraint"), "violations")
                         .withColumn("holds", F.col("violations") == 0))
        elif orders[name] > 2:
            parts.append(local_table(spark, [(name, verify.holds(df, dc, reading))], "denial_constraint string, holds boolean")
                         .select("denial_constraint", F.lit(None).cast("decimal(38,0)").alias("violations"), "holds"))
    empty = local_table(spark, [], "denial_constraint string, violations decimal(38,0), holds boolean")
    return functools.reduce(DataFrame.unionByName, parts, empty)


def _counted(df: DataFrame, dcs: dict[str, list[tuple[str, str]]], reading: verify.Reading) -> DataFrame:
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for dc in dcs.values() for c, _ in dc))
    values, used = verify._encoded(df, columns, reading)
    real = {c for c in columns if used[c].type_class == REAL}
    for dc in dcs.values():
        verify._check_orders(verify._split(dc)[2], used)
    terms = {name: terms_of(dc, real) for name, dc in dcs.items()}
    need = {(t.cols, t.guard) for held in terms.values() for t in held}
    # A guard is looked at where the set is rolled up, so it has to be among the columns of the wide set.
    tops = gathered({cols | ({guard} if guard else set()) for cols, guard in need})
    number = {key: k for k, key in enumerate(sorted(need, key=lambda key: (sorted(key[0]), key[1] or "")))}
    home = {key: next(t for t, held in tops.items() if (key[0] | ({key[1]} if key[1] else set())) in held) for key in need}
    name = {c: f"v{used[c].col_id}" for c in columns}
    sums = []
    for top in tops:
        cols = sorted(top, key=columns.index)
        counts = values.groupBy(*[name[c] for c in cols]).agg(F.expr("count(1) AS c"))
        rolled = [key for key in number if home[key] == top]
        shown = []
        for cols_of, guard in rolled:
            clean = verify._no_nan([*cols_of, *([guard] if guard else [])], used)
            masked = [f"{name[c]} AS {name[c]}" if c in cols_of else f"NULL AS {name[c]}" for c in cols]
            shown.append(f"struct({number[cols_of, guard]} AS term, {clean} AS counts{''.join(', ' + m for m in masked)})")
        groups = counts.selectExpr("c", f"inline(array({', '.join(shown)}))").where("counts").groupBy("term", *[name[c] for c in cols]).agg(F.expr("sum(c) AS c"))
        sums.append(groups.groupBy("term").agg(F.expr("CAST(sum(CAST(c AS DECIMAL(19,0)) * CAST(c - 1 AS DECIMAL(19,0))) AS DECIMAL(38,0)) AS pairs")))
    weights = [(dc, number[t.cols, t.guard], t.weight) for dc, held in terms.items() for t in held]
    wanted = local_table(spark, weights, "denial_constraint string, term int, weight int")
    total = functools.reduce(DataFrame.unionByName, sums)
    return (F.broadcast(wanted).join(total, "term", "left").groupBy("denial_constraint")       # metadata: a few rows a constraint
            .agg(F.expr("CAST(coalesce(sum(CAST(weight * pairs AS DECIMAL(38,0))), 0) / 2 AS DECIMAL(38,0)) AS violations"))
            .withColumn("holds", F.col("violations") == 0))
