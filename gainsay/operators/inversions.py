"""Counts of row pairs under two orderings, by distributed counting of pairs that rise together.

Large groups are cut into slabs by quantiles of the first column and, apart from that, by quantiles of the second; a value that is
itself a quantile is a slab of its own, so a frequent value makes no slab large.  A pair that rises in both columns
either lies in different slabs of both, which a histogram of slabs and its running sums count; or in one slab of the first
column, or in one slab of the second and different ones of the first: those are counted within a task by merging.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gainsay.operators.grouped import bounds, whole_groups
from gainsay.shared import staged

#: Points of a slab, points that a task merges at once, and points of a group whose pairs are looked at one by one.
SLAB, MERGED, FEW = 1 << 17, 1 << 17, 32
_BIG = "DECIMAL(38,0)"


def ordered_pairs(groups: DataFrame, keys: Sequence[str], first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """One row ``pairs``: ordered pairs of different rows with equal keys that satisfy both orderings.

    ``groups`` holds points (keys and compared columns, possibly several times) with their number of rows ``c``, and no NaN among them.
    """
    (v, o1), (w, o2) = first, second
    points = groups.groupBy(*keys, v, w).agg(F.expr("sum(c) AS c"))
    points = staged(points)

    def alike(cols: Sequence[str], name: str) -> DataFrame:
        """Unordered pairs of rows that are equal in these columns."""
        half = f"CAST(coalesce(sum(CAST(n AS DECIMAL(19,0)) * CAST(n - 1 AS DECIMAL(19,0))), 0) / 2 AS {_BIG})"
        return points.groupBy(*cols).agg(F.expr("sum(c) AS n")).agg(F.expr(f"{half} AS n")).withColumn("fact", F.lit(name))

    known = {"everything": list(keys), "same_v": [*keys, v], "same_w": [*keys, w], "same": [*keys, v, w]}
    rows = rising(points, keys, v, w).select(F.col("rising").alias("n"), F.lit("rising").alias("fact"))
    for name, cols in known.items():
        rows = rows.unionByName(alike(cols, name))
    facts = rows.agg(*[F.expr(f"max(CASE WHEN fact = '{name}' THEN n END) AS {name}") for name in (*known, "rising")])
    apart = "rising" if o1[0] == o2[0] else "(everything - same_v - same_w + same - rising)"
    terms = [apart]
    if o1 in ("<=", ">="):
        terms.append("(same_v - same)")
    if o2 in ("<=", ">="):
        terms.append("(same_w - same)")
    if o1 in ("<=", ">=") and o2 in ("<=", ">="):
        terms.append("2 * same")
    return facts.selectExpr(f"CAST({' + '.join(terms)} AS {_BIG}) AS pairs")


def rising(points: DataFrame, keys: Sequence[str], v: str, w: str) -> DataFrame:
    """One row ``rising``: pairs of rows of one group of which one is less than the other in both columns."""
    by = list(keys) or ["__all"]
    rows = points if keys else points.withColumn("__all", F.lit(0))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    fan = -(-largest // SLAB)
    if fan <= 1:
        return _total([_merged(rows.withColumn("__slab", F.lit(0)), [*by, "__slab"], v, w)])
    shares = ", ".join(f"{k / fan!r}D" for k in range(1, fan))
    cuts = rows.join(sizes.where(F.col("__n") > SLAB).select(*by), by, "left_semi").groupBy(*by).agg(
        *[F.expr(f"percentile_approx({c}, array({shares}), {100 * fan})").alias(name) for c, name in ((v, "__pc"), (w, "__qc"))])

    def slab(c: str, at: str) -> str:
        return f"coalesce(size(filter({at}, x -> x < {c})) + size(filter({at}, x -> x <= {c})), 0)"

    cut = staged(rows.join(cuts, by, "left").selectExpr(*by, v, w, "c", f"{slab(v, '__pc')} AS __p", f"{slab(w, '__qc')} AS __q", "__pc IS NOT NULL AS __big",
                                                        f"coalesce(array_contains(__pc, {v}), false) AS __one_v", f"coalesce(array_contains(__qc, {w}), false) AS __one_w"))
    return _total([_between(cut.where("__big"), by), _merged(cut.where("NOT __one_v"), [*by, "__p"], v, w),
                   _merged(cut.where("__big AND NOT __one_w"), [*by, "__q"], "__p", w)])


def _total(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.agg(F.expr(f"CAST(coalesce(sum(n), 0) AS {_BIG}) AS rising"))


def _between(cut: DataFrame, by: list[str]) -> DataFrame:
    """Pairs in different slabs of both columns, from a histogram over the slabs with its gaps filled in."""
    held = cut.groupBy(*by, "__p", "__q").agg(F.expr(f"CAST(sum(c) AS {_BIG}) AS n"))
    grid = held.select(*by, "__p").distinct().join(held.select(*by, "__q").distinct(), by)       # at most a few SLAB-th parts squared
    full = grid.join(held, [*by, "__p", "__q"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast(_BIG)))
    row = Window.partitionBy(*by, "__p").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    column = Window.partitionBy(*by, "__q").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return (full.withColumn("left", F.sum("n").over(row)).withColumn("below", F.sum("left").over(column))
            .where("n > 0 AND below > 0").select((F.col("n") * F.col("below")).cast(_BIG).alias("n")))


def _merged(rows: DataFrame, by: list[str], v: str, w: str) -> DataFrame:
    """Rising pairs within each group, counted where its rows meet; tasks take whole groups of bounded size together."""
    names = list(dict.fromkeys([*by, v, w, "c"]))
    at_v, at_w, at_c = (names.index(c) for c in (v, w, "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for group, rows in whole_groups(batches, len(by), MERGED):
            total += _counted(group, *(rows.column(k).to_numpy() for k in (at_v, at_w, at_c)))
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(total)], pa.decimal128(38, 0))], names=["n"])

    return rows.select(*names).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"n {_BIG}")


def _counted(g: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> int:
    """Weighted rising pairs within groups, whose rows lie together."""
    lo, hi = bounds(g)
    few = hi - lo <= FEW
    return _paired(hi[few] - np.flatnonzero(few), v[few], w[few], c[few]) + _sorted(g[~few], v[~few], w[~few], c[~few])


def _paired(left: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> int:
    """For small groups: each row meets the next, then the one after that, while its group has ``left`` that many."""
    total, step, i = 0, 1, np.arange(len(v))
    while len(i := i[left[i] > step]):
        j = i + step
        rises = ((v[i] < v[j]) & (w[i] < w[j])) | ((v[i] > v[j]) & (w[i] > w[j]))
        total += _dot(c[i[rises]], c[j[rises]])
        step += 1
    return total


def _sorted(g: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> int:
    if not len(g):
        return 0
    # Later groups rank lower in the second column, so no pair of two groups rises; nor do equal values of the first.
    g = np.unique(g, return_inverse=True)[1].astype(np.int64)
    rank = np.unique(w, return_inverse=True)[1].astype(np.int64)
    rank = np.unique((g.max() - g) * (rank.max() + 1) + rank, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((-rank, v, g))
    return ascents(rank[order], c[order])


def ascents(rank: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs i < j with rank[i] < rank[j]: halves of blocks of doubling size are merged by rank."""
    n, span, total, size = len(rank), int(rank.max()) + 1 if len(rank) else 1, 0, 1
    place = np.arange(n)
    while size < n:
        key = place // (2 * size) * span + rank
        order = np.argsort(key, kind="stable")
        key, late, own = key[order], (place[order] // size) % 2 == 1, weight[order]
        sums = np.concatenate([[0], np.cumsum(np.where(late, 0, own))])
        at = np.flatnonzero(late)
        less = sums[np.searchsorted(key, key[at])] - sums[np.searchsorted(key, key[at] // span * span)]
        total += _dot(own[at], less)
        size *= 2
    return total


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a):
        return 0
    if float(a.max()) * float(b.max()) * len(a) < 2.0 ** 62:
        return int(a @ b)
    return sum(int(x) * int(y) for x, y in zip(a, b))
