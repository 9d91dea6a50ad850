"""Batches of random ordered row pairs, and the values of both rows."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainsay.functions.draws import below_sql, stream_keys, word_sql
from gainsay.operators.rows import RowSet, value_name
from gainsay.shared import local_table

# Fixed values (must equal the published sampling schedule).
FIRST_BATCH = 100
DOUBLINGS = 20
PAIR_SHARE = 0.0325

# Largest side that is ever broadcast, in bytes of payload.
BROADCAST_BYTES = 128 << 20
_DRAW_BYTES = 48
# Broadcasts of draws, each met by one scan, that are preferred to shuffling every row.
_SLICES = 16
_PAIRS_PER_TASK = 1 << 20
_SMALL_TASK = 1 << 15


def batch_size(batch: int) -> int:
    return FIRST_BATCH << min(batch, DOUBLINGS)


def batch_start(batch: int) -> int:
    """Index of the first draw of a batch = pairs in all batches before it."""
    full = min(batch, DOUBLINGS)
    return FIRST_BATCH * ((1 << full) - 1) + (batch - full) * batch_size(DOUBLINGS)


def batch_count(n: int) -> int:
    """Batches needed to reach the share of all ordered pairs of ``n`` rows."""
    return batch_reaching(math.ceil(PAIR_SHARE * n * n)) if n > 1 else 0


def batch_reaching(pairs: int) -> int:
    """Least number of batches that hold at least so many pairs; batches beyond the doublings are of one size."""
    if pairs <= batch_start(DOUBLINGS):
        return next(b for b in range(DOUBLINGS + 1) if batch_start(b) >= pairs)
    return DOUBLINGS - (batch_start(DOUBLINGS) - pairs) // batch_size(DOUBLINGS)


def batch_sql(i: str, first: int, end: int) -> str:
    """Batch of a draw index that lies in the batches ``first`` to ``end - 1``."""
    steps = "".join(f" WHEN {i} < {batch_start(b + 1)}L THEN {b}" for b in range(first, end - 1))
    return f"CASE{steps} ELSE {end - 1} END" if steps else str(first)


def sample_pairs(spark: SparkSession, n: int, end: int, first: int = 0, seed: int = 42) -> DataFrame:
    """Pairs ``(batch, i, x, y)`` of the batches ``first`` to ``end - 1``, uniform over x <> y."""
    if n < 2 or end <= first:
        return local_table(spark, [], "batch int, i long, x long, y long")
    lo, hi = batch_start(first), batch_start(end)
    tasks = max(min(-(-(hi - lo) // _SMALL_TASK), spark.sparkContext.defaultParallelism),
                (hi - lo) // _PAIRS_PER_TASK)
    keys = stream_keys(seed)
    return (spark.range(lo, hi, 1, tasks)
                 .selectExpr("id AS i", *[f"{word_sql('id', k)} AS {s}" for s, k in keys.items()])
                 .selectExpr("i", f"{below_sql('x_hi', 'x_lo', n)} AS x", f"{below_sql('y_hi', 'y_lo', n - 1)} AS skipped")
                 .selectExpr(f"{batch_sql('i', first, end)} AS batch", "i", "x",
                             "skipped + CASE WHEN skipped >= x THEN 1L ELSE 0L END AS y"))


def side(which: str, col_id: int) -> str:
    return f"{which}_{value_name(col_id)}"


def pair_values(rows: RowSet, pairs: DataFrame, n_pairs: int,
                col_ids: Sequence[int] | None = None) -> DataFrame:
    """``pairs`` with the values of both rows, as ``x_c0, y_c0, x_c1, ...``.

    Both sizes are known, so the plan is chosen by them: few draws go to the rows (the table is
    read once and never moved), more draws do so in slices, few rows go to the draws, and two large sides
    meet in sort-merge joins, which spill.
    """
    ids = [c.col_id for c in rows.columns] if col_ids is None else list(col_ids)
    names = [value_name(c) for c in ids]
    slices = -(-2 * n_pairs * _DRAW_BYTES // max(1, BROADCAST_BYTES))
    rows_fit = rows.n * rows.width(ids) <= BROADCAST_BYTES
    if 1 < slices <= _SLICES and not rows_fit:
        # Every draw goes to the rows, a part of the draws at a time: rows are scanned again but never moved.
        parts = [pair_values(rows, pairs.where(f"pmod(i, {slices}) = {k}"), -(-n_pairs // slices), ids) for k in range(slices)]
        return functools.reduce(DataFrame.unionByName, parts)
    if slices <= 1 and (2 * n_pairs <= rows.n or not rows_fit):
        draws = pairs.selectExpr("batch", "i", "x", "y",
                                 "inline(array(struct(true AS is_x, x AS rid), struct(false AS is_x, y AS rid)))")
        met = (rows.df.select("rid", *names).join(F.broadcast(draws), "rid")
               .selectExpr("batch", "i", "x", "y", "is_x", *[f"{rows.encoded(c)} AS {value_name(c)}" for c in ids]))
        picks = [F.expr(f"max(CASE WHEN {test} THEN {value_name(c)} END) AS {side(w, c)}")
                 for c in ids for w, test in (("x", "is_x"), ("y", "NOT is_x"))]
        return met.groupBy("batch", "i", "x", "y").agg(*picks)
    out, values = pairs, rows.values(ids)
    for w in ("x", "y"):
        part = values.selectExpr(f"rid AS {w}", *[f"{value_name(c)} AS {side(w, c)}" for c in ids])
        out = out.join(F.broadcast(part) if rows_fit else part, w)
    return out.select("batch", "i", "x", "y", *[side(w, c) for c in ids for w in ("x", "y")])
