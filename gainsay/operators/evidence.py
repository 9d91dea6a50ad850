"""From pair values to a small multiset of comparison patterns.

Every column contributes four bits, exactly one of which is set for a pair: equal, less, greater,
or unordered (strings that differ, reals with a NaN).  Fifteen columns fill one bigint ``w0``, the
next fifteen ``w1`` and so on.  A predicate allows some of the states of its column; a set of
predicates holds for a pattern when no forbidden bit is set.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.operators.pairs import pair_values, side
from gainsay.operators.rows import RowSet
from gainsay.operators.schema_model import REAL, STRING, Predicate
from gainsay.shared import staged

EQUAL, LESS, GREATER, UNORDERED = 1, 2, 4, 8
STATES = EQUAL | LESS | GREATER | UNORDERED
COLUMNS_PER_WORD = 15
ALLOWED = {"==": EQUAL, "!=": LESS | GREATER | UNORDERED, ">": GREATER,
           "<=": EQUAL | LESS, "<": LESS, ">=": EQUAL | GREATER}


def word_count(n_columns: int) -> int:
    return max(1, -(-n_columns // COLUMNS_PER_WORD))


def words(n_columns: int) -> list[str]:
    return [f"w{k}" for k in range(word_count(n_columns))]


def _place(col_id: int) -> tuple[int, int]:
    return col_id // COLUMNS_PER_WORD, 4 * (col_id % COLUMNS_PER_WORD)


def allowed_bits(p: Predicate) -> tuple[int, int]:
    """(word, bits) a pattern must meet for the predicate to hold."""
    word, shift = _place(p.col_id)
    return word, ALLOWED[p.op] << shift


def forbidden_bits(p: Predicate) -> tuple[int, int]:
    """(word, bits) that must all be unset for the predicate to hold."""
    word, shift = _place(p.col_id)
    return word, (STATES & ~ALLOWED[p.op]) << shift


def state_sql(x: str, y: str, type_class: str) -> str:
    """State of one column for a pair; NaN follows IEEE rules, which Spark's own operators do not."""
    if type_class == STRING:
        return f"CASE WHEN {x} = {y} THEN {EQUAL}L ELSE {UNORDERED}L END"
    ordered = f"WHEN {x} < {y} THEN {LESS}L WHEN {x} > {y} THEN {GREATER}L ELSE {EQUAL}L END"
    if type_class == REAL:
        return f"CASE WHEN isnan({x}) OR isnan({y}) THEN {UNORDERED}L {ordered}"
    return f"CASE {ordered}"


def predicate_sql(x: str, y: str, op: str, type_class: str) -> str:
    """Truth of ``x op y`` with IEEE NaN rules; orderings of strings are refused."""
    if op not in ALLOWED:
        raise ValueError(f"unknown operator {op!r}")
    if type_class == STRING and op not in ("==", "!="):
        raise ValueError(f"{op} is not defined for {STRING} columns")
    return f"({state_sql(x, y, type_class)} & {ALLOWED[op]}L) <> 0"


def pair_patterns(rows: RowSet, pairs: DataFrame, n_pairs: int,
                  col_ids: Sequence[int] | None = None) -> DataFrame:
    """``(batch, i, x, y, w0, ...)``: the pattern of every pair over the chosen columns."""
    ids = [c.col_id for c in rows.columns] if col_ids is None else list(col_ids)
    values = pair_values(rows, pairs, n_pairs, ids)
    parts = {w: ["0L"] for w in words(len(rows.columns))}
    for c in ids:
        word, shift = _place(c)
        state = state_sql(side("x", c), side("y", c), rows.columns[c].type_class)
        parts[f"w{word}"].append(f"shiftleft({state}, {shift})")
    return values.selectExpr("batch", "i", "x", "y", *[f"{' | '.join(p)} AS {w}" for w, p in parts.items()])


def evidence(patterns: DataFrame) -> DataFrame:
    """``(batch, w0, ..., cnt)``: patterns with their number of pairs, combined before the shuffle."""
    keys = [c for c in patterns.columns if c == "batch" or c[0] == "w"]
    return patterns.groupBy(*keys).agg(F.expr("count(1) AS cnt"))


def holds_sql(p: Predicate) -> str:
    word, bits = allowed_bits(p)
    return f"(w{word} & {bits}L) <> 0"


def any_holds(preds: Iterable[Predicate]) -> str:
    """One test per word: some predicate of the list holds."""
    masks: dict[int, int] = {}
    for p in preds:
        word, bits = allowed_bits(p)
        masks[word] = masks.get(word, 0) | bits
    return " OR ".join(f"(w{w} & {m}L) <> 0" for w, m in sorted(masks.items())) or "false"


def satisfied(preds: Sequence[Predicate], last_batch: dict[int, int] | None = None,
              number: dict[int, int] | None = None) -> str:
    """Array of the predicates that hold (and were still sampled in this batch), by id or number."""
    entries = []
    for p in preds:
        still = "" if last_batch is None else f" AND batch <= {last_batch[p.pred_id]}"
        entries.append(f"CASE WHEN {holds_sql(p)}{still} THEN {(number or {}).get(p.pred_id, p.pred_id)} END")
    return f"array_compact(array({', '.join(entries)}))"


def predicate_counts(ev: DataFrame, preds: Sequence[Predicate], first: int, end: int) -> DataFrame:
    """``(batch, pred_id, hits)`` for every predicate and batch, zeros included."""
    hits = ev.selectExpr("batch", "cnt", f"explode({satisfied(preds)}) AS pred_id")
    ids = ", ".join(str(p.pred_id) for p in preds)
    grid = ev.sparkSession.range(first, end, 1, 1).selectExpr(
        "CAST(id AS INT) AS batch", "0L AS cnt", f"explode(array({ids})) AS pred_id")
    return hits.unionByName(grid).groupBy("batch", "pred_id").agg(F.expr("sum(cnt) AS hits"))


CHUNK = 64          # patterns of a chunk: one bigint holds a bit for each


def vertical_index(anchored: DataFrame, n_columns: int, most: int) -> DataFrame:
    """The patterns of every anchor as weighted bitmaps: ``(anchor, chunk, states, planes)``, stored once.

    A chunk is up to 64 patterns.  ``states[4 * column + state]`` has a bit for each that shows that state; ``planes[j]`` has a bit for each
    whose count has bit ``j``, so the pairs behind any selection of patterns are a sum of bit counts.  ``most`` bounds the counts.
    """
    names = words(n_columns)
    placed = staged(anchored.where("cnt > 0").repartitionByRange("anchor", *names).sortWithinPartitions("anchor", *names)
                    .withColumn("place", F.monotonically_increasing_id()))
    bit = f"shiftleft(1L, CAST(pmod(place, {CHUNK}) AS INT))"
    tests = [f"(w{w} & {1 << (shift + k)}L) <> 0" for w, shift in map(_place, range(n_columns)) for k in range(4)]
    planes = [f"(shiftright(cnt, {j}) & 1L) = 1" for j in range(max(1, most.bit_length()))]
    sums = [F.expr(f"bit_or(CASE WHEN {t} THEN {bit} ELSE 0L END)").alias(f"b{k}") for k, t in enumerate([*tests, *planes])]
    flat = placed.groupBy("anchor", F.expr(f"place DIV {CHUNK}").alias("chunk")).agg(*sums)
    states, weights = (", ".join(f"b{k}" for k in part) for part in (range(len(tests)), range(len(tests), len(sums))))
    return staged(flat.selectExpr("anchor", "chunk", f"array({states}) AS states", f"array({weights}) AS planes"))


def all_patterns(index: DataFrame) -> DataFrame:
    """``(anchor, chunk, mask)`` with every pattern selected."""
    return index.selectExpr("anchor", "chunk", "aggregate(planes, 0L, (x, y) -> x | y) AS mask")


def narrowed(candidates: DataFrame, selected: DataFrame, index: DataFrame, preds: Sequence[Predicate]) -> DataFrame:
    """``(members, chunk, mask, hits)``: the patterns of a parent that satisfy the added predicate, and their pairs.

    ``candidates`` holds ``(members, parent, anchor, last)``, ``last`` being the position of the added predicate in ``preds``; ``selected``
    holds the ``(members, chunk, mask)`` that are left of the parents.  Only those are looked at, so work falls with them.
    """
    columns = ", ".join(str(4 * p.col_id) for p in preds)
    allowed = ", ".join(str(ALLOWED[p.op]) for p in preds)
    states = " | ".join(f"CASE WHEN (allowed & {1 << k}) <> 0 THEN states[first + {k}] ELSE 0L END" for k in range(4))
    hits = "aggregate(transform(planes, (x, j) -> shiftleft(CAST(bit_count(x & mask) AS BIGINT), j)), 0L, (x, y) -> x + y)"
    return (candidates.select("members", "parent", "anchor", "last").join(selected.select(F.col("members").alias("parent"), "chunk", F.col("mask").alias("held")), "parent")
            .join(index, ["anchor", "chunk"])
            .selectExpr("members", "chunk", "held", "states", "planes", f"element_at(array({columns}), last + 1) AS first", f"element_at(array({allowed}), last + 1) AS allowed")
            .selectExpr("members", "chunk", "planes", f"held & ({states}) AS mask").where("mask <> 0")
            .selectExpr("members", "chunk", "mask", f"{hits} AS hits"))


def counted_hits(candidates: DataFrame, masks: DataFrame) -> DataFrame:
    """``candidates`` with ``hits``; a set without any pattern left has none."""
    sums = masks.groupBy("members").agg(F.sum("hits").alias("hits"))
    return candidates.join(sums, "members", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
