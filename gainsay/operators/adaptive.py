"""Running Beta counts per predicate, the adaptive stop, and the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.functions import beta
from gainsay.operators.pairs import DOUBLINGS, FIRST_BATCH

# Fixed values (must equal the published behaviour).
THRESHOLD_SCALE = 0.01
CONSTANT_PENALTY = 1_000_000_000

BATCH_PAIRS = f"shiftleft({FIRST_BATCH}L, least(batch, {DOUBLINGS}))"
_STATS = ("a", "b", "mean", "mean_log", "spread_log", "grad")


def running_beta(counts: DataFrame) -> DataFrame:
    """``(pred_id, batch, a, b, ...)``: Beta parameters after each batch, starting from (1, 1)."""
    over = "OVER (PARTITION BY pred_id ORDER BY batch ROWS UNBOUNDED PRECEDING)"
    return (counts.selectExpr("pred_id", "batch", f"1 + sum(hits) {over} AS a",
                              f"1 + sum({BATCH_PAIRS} - hits) {over} AS b")
                  .selectExpr("*", *beta.beta_columns()))


def adaptive_stop(counts: DataFrame, min_grad: float) -> DataFrame:
    """Per predicate its state at the first batch whose gradient is at most ``min_grad``.

    ``active`` says that no batch reached it; the state is then that of the last batch.
    """
    row = f"struct(batch, {', '.join(_STATS)})"
    return (running_beta(counts).groupBy("pred_id")
            .agg(F.expr(f"min(CASE WHEN grad <= {min_grad!r}D THEN {row} END) AS stop"),
                 F.expr(f"max({row}) AS final"))
            .selectExpr("pred_id", "stop IS NULL AS active", "coalesce(stop, final) AS state")
            .selectExpr("pred_id", "state.batch AS last_batch", "active", *[f"state.{c} AS {c}" for c in _STATS]))


def penalised(stats: DataFrame) -> DataFrame:
    """Applies the penalty for comparisons that a constant column cannot satisfy.

    ``stats`` holds ``(op, is_constant, a, b, ...)``.
    """
    hit = "is_constant AND op IN ('!=', '>', '<')"
    return (stats.withColumn("b", F.expr(f"CASE WHEN {hit} THEN {1 + CONSTANT_PENALTY}L ELSE b END"))
                 .withColumn("a", F.expr(f"CASE WHEN {hit} THEN 1L ELSE a END")))


def rank_predicates(stats: DataFrame) -> DataFrame:
    """Adds ``rank``: 0 is the most frequent predicate; ties go by ``pred_id``.

    There are at most six rows per column of the input table, so one window is fine.
    """
    return stats.selectExpr("*", "row_number() OVER (PARTITION BY 0 ORDER BY round(mean_log, 9) DESC, pred_id) - 1 AS rank")
