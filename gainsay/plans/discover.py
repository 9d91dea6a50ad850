"""Approximate discovery of denial constraints.

The driver holds the level loop and the per-predicate statistics (at most six rows per column of
the table).  Pairs, patterns, supports and candidate sets stay in DataFrames.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainsay.functions import beta
from gainsay.functions.text import dc_text, dependency_text
from gainsay.operators import pairs as P
from gainsay.operators.adaptive import CONSTANT_PENALTY, THRESHOLD_SCALE, adaptive_stop
from gainsay.operators.evidence import (all_patterns, any_holds, counted_hits, evidence, forbidden_bits, narrowed, pair_patterns,
                                        predicate_counts, satisfied, vertical_index, word_count, words)
from gainsay.operators.rows import RowSet, index_rows, is_unique
from gainsay.operators.schema_model import Predicate
from gainsay.shared import checkpointed, local_table
from gainsay.sources.tables import read_input

DEFAULT_THRESHOLD = 1e-7
RESULT_SCHEMA = ("denial_constraint string, predicates array<struct<col:string,op:string>>, size int, "
                 "score double, sampled_pairs bigint, anchor string")

_LOWER = "struct(edge_log AS log, edge_spread AS spread)"
_FIRST_WAVE = 25_500        # pairs of the first look at the table
_NODE_BYTES = 256           # bound for one row of a level without its set
_CUT = 4                    # levels between checkpoints
_WAVE_GROWTH = 64           # how far a never-seen predicate may stretch the next look


@dataclass
class PredicateState:
    """What the sample says about one predicate."""

    pred: Predicate
    rank: int
    a: int
    b: int
    mean_log: float
    spread_log: float
    last_batch: int

    @property
    def sampled_pairs(self) -> int:
        return P.batch_start(self.last_batch + 1)


@dataclass
class Sample:
    rows: RowSet
    states: list[PredicateState]    # by rank
    anchored: DataFrame             # (anchor rank, w0, ..., cnt), persisted
    cached: list[DataFrame]

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def batch_limit(n: int, min_grad: float) -> int:
    """Batches after which every predicate has stopped, whatever the data.

    The slowest gradient is that of a predicate never satisfied, ``(m + 1) / (m + 2)**2`` after
    ``m`` pairs.
    """
    limit = P.batch_count(n)
    if limit == 0 or min_grad <= 0:
        return limit
    # (m + 1) / (m + 2)**2 <= g from m + 2 >= (1 + sqrt(1 - 4 g)) / (2 g) on.
    first = max(1, P.batch_reaching(int((1 + math.sqrt(max(0.0, 1 - 4 * min_grad))) / (2 * min_grad)) - 3))
    if first >= limit:
        return limit

    def stopped(batch: int) -> bool:
        m = P.batch_start(batch)
        return (m + 1) / (m + 2) ** 2 <= min_grad

    while first > 1 and stopped(first - 1):
        first -= 1
    while first < limit and not stopped(first):
        first += 1
    return first


def _pairs_needed(a: int, b: int, min_grad: float) -> float:
    ahead = (a + b) * _WAVE_GROWTH
    if min_grad <= 0:
        return ahead
    if a == 1:
        return min(1 / min_grad, ahead)
    p = a / (a + b)
    return math.sqrt((1 - p) / (p * min_grad))


def _wave_end(first: int, limit: int, want: float) -> int:
    return min(max(first + 1, P.batch_reaching(math.ceil(want))), limit)


def _wave(rows: RowSet, active: list[Predicate], first: int, end: int, seed: int,
          cached: list[DataFrame]) -> DataFrame:
    """Evidence of some batches, restricted to pairs that satisfy an active predicate.

    Later looks read only the columns of the predicates still active, then fetch the other columns
    for the few pairs that satisfy one of them.
    """
    spark = rows.df.sparkSession
    drawn = P.sample_pairs(spark, rows.n, end, first, seed)
    n_pairs = P.batch_start(end) - P.batch_start(first)
    wanted = sorted({p.col_id for p in active})
    if len(wanted) == len(rows.columns):
        patterns = pair_patterns(rows, drawn, n_pairs).where(any_holds(active))
    else:
        kept = (pair_patterns(rows, drawn, n_pairs, wanted).where(any_holds(active))
                .select("batch", "i", "x", "y").persist())
        cached.append(kept)
        patterns = pair_patterns(rows, kept, max(1, kept.count()))
    ev = evidence(patterns).persist()
    cached.append(ev)
    return ev


def _never_met(spark: SparkSession, limit: int) -> tuple:
    """State of a predicate that no pair satisfies, after all batches that are ever drawn."""
    a, b = "1L", f"{1 + P.batch_start(limit)}L"
    return (1, 1 + P.batch_start(limit), *spark.range(1).selectExpr(beta.mean_log_sql(a, b), beta.spread_log_sql(a, b)).first(), limit - 1)


def sample_table(rows: RowSet, threshold: float, seed: int = 42) -> Sample:
    """Draw pairs in growing looks until every predicate's estimate has settled."""
    spark = rows.df.sparkSession
    min_grad = threshold * THRESHOLD_SCALE
    preds = rows.predicates
    barred = {p.pred_id for p in preds if rows.constant[p.col_id] and p.op in ("!=", ">", "<")}
    active = [p for p in preds if p.pred_id not in barred]
    limit = batch_limit(rows.n, min_grad)
    cached: list[DataFrame] = []
    waves: list[DataFrame] = []
    counts: list[DataFrame] = []
    known: dict[int, tuple] = {}
    proven: set[int] = set()
    tested: set[int] = set()
    first, end = 0, _wave_end(0, limit, _FIRST_WAVE)
    while active and first < end:
        ev = _wave(rows, active, first, end, seed, cached)
        waves.append(ev)
        counts.append(predicate_counts(ev, active, first, end))
        stopped = adaptive_stop(functools.reduce(DataFrame.unionByName, counts), min_grad)
        found = {r.pred_id: r for r in stopped.collect()}
        active = [p for p in active if found[p.pred_id].active and p.pred_id not in proven]
        known.update({k: (r.a, r.b, r.mean_log, r.spread_log, r.last_batch) for k, r in found.items() if k not in proven})
        first = end
        if not active or first >= limit:
            break
        end = _wave_end(first, limit, max(_pairs_needed(*known[p.pred_id][:2], min_grad) for p in active))
        if P.batch_start(end) - P.batch_start(first) > rows.n:
            # A key column's "==" holds for no pair at all: that is proven at the cost of one grouping instead of drawing on.  It
            # gets the state that the draws would have led to, so when it is proven changes no result.
            tried = [p for p in active if p.op == "==" and p.pred_id not in tested and known[p.pred_id][0] == 1]
            tested |= {p.pred_id for p in tried}
            proven |= {p.pred_id for p in tried if is_unique(rows, p.col_id)}
            known.update(dict.fromkeys(proven, _never_met(spark, limit)))
            active = [p for p in active if p.pred_id not in proven]
            if active:
                end = _wave_end(first, limit,
                                max(_pairs_needed(*known[p.pred_id][:2], min_grad) for p in active))
    for pred_id in barred:
        known[pred_id] = (1, 1 + CONSTANT_PENALTY, -math.inf, 0.0, -1)
    order = sorted(preds, key=lambda p: (-round(known[p.pred_id][2], 9), p.pred_id))
    states = [PredicateState(p, k, *known[p.pred_id]) for k, p in enumerate(order)]
    names = words(len(rows.columns))
    useful = [s.pred for s in states if s.a > 1]
    if waves and useful:
        rank = {s.pred.pred_id: s.rank for s in states}
        last = {s.pred.pred_id: s.last_batch for s in states}
        seen = functools.reduce(DataFrame.unionByName, waves)
        # An empty pattern per anchor violates nothing: it keeps sets without any pair in the counts.
        blank = local_table(spark, [(s.rank, *[0] * (len(names) + 1)) for s in states if s.a > 1],
                            "anchor int, " + ", ".join(f"{w} long" for w in [*names, "cnt"]))
        anchored = (seen.selectExpr(f"explode({satisfied(useful, last, rank)}) AS anchor", *names, "cnt")
                        .unionByName(blank).groupBy("anchor", *names).agg(F.expr("sum(cnt) AS cnt")).persist())
    else:
        anchored = local_table(spark, [], "anchor int, " + "".join(f"{w} long, " for w in names) + "cnt long")
    cached.append(anchored)
    return Sample(rows, states, anchored, cached)


def _state_table(spark: SparkSession, sample: Sample) -> DataFrame:
    """Level one: every predicate as a set of its own, ``members`` holding ranks."""
    n_words = word_count(len(sample.rows.columns))
    data = []
    for s in sample.states:
        f = [0] * n_words
        word, bits = forbidden_bits(s.pred)
        f[word] = bits
        data.append(([s.rank], s.rank, s.pred.col_id, s.rank, s.pred.col_id, s.a, s.mean_log, s.spread_log,
                     True, *f))
    return local_table(spark, data, "members array<int>, anchor int, anchor_col int, last int, last_col int, "
                                    "a long, edge_log double, edge_spread double, sound boolean" +
                       "".join(f", f{k} long" for k in range(n_words)))


def _joined_bits(n_words: int) -> list[str]:
    return [f"f{k} | p_f{k} AS f{k}" for k in range(n_words)]


def _second_level(nodes: DataFrame, n_words: int) -> DataFrame:
    """Candidates {S, p}: p ranked before S, on another column, both satisfied in the sample."""
    alive = nodes.where("a > 1")
    p = alive.selectExpr("last AS p", "last_col AS p_col", f"{_LOWER} AS low",
                         *[f"f{k} AS p_f{k}" for k in range(n_words)])
    s = alive.where("anchor > 0").selectExpr("*", "explode(sequence(0, anchor - 1)) AS p")
    return (s.join(p, "p").where("p_col <> last_col")
             .selectExpr("concat(members, array(p)) AS members", "anchor", "anchor_col", "p AS last",
                         "p_col AS last_col", "a AS from_a", "array(low) AS lower", *_joined_bits(n_words)))


def _next_level(nodes: DataFrame, size: int, n_words: int, small: bool) -> DataFrame:
    """Candidates of ``size`` predicates from the nodes of ``size - 1``.

    S + p is tried when S is satisfied in the sample and, for every member c of S, the set
    S - c + p was tried, was sound and is satisfied too.  Joining S without its anchor to U without
    its last member finds S + p together with the first of these sets; the others are matched one
    by one and must all be there.  A level counted to be ``small`` is broadcast, others are shuffled.
    The result is spread by set over all cores: the supports are then counted without another
    shuffle, and small sets of candidates do not end up in one task.
    """
    tasks = nodes.sparkSession.sparkContext.defaultParallelism
    side = F.broadcast if small else (lambda df: df)
    inner = size - 2
    bits = [f"f{k}" for k in range(n_words)]
    alive = nodes.where("a > 1")
    sound = alive.where("sound")
    s = alive.selectExpr("members AS parent", "anchor", "anchor_col", "a AS from_a", *bits,
                         f"slice(members, 2, {inner}) AS shared")
    u = sound.selectExpr(f"slice(members, 1, {inner}) AS shared", "last AS p", "last_col AS p_col",
                         f"{_LOWER} AS first_lower", *[f"f{k} AS p_f{k}" for k in range(n_words)])
    rest = ["anchor", "anchor_col", "last", "last_col", "from_a", "first_lower", *bits]
    tried = (s.join(side(u), "shared").where("p_col <> anchor_col")
              .selectExpr("parent", "concat(parent, array(p)) AS members", "anchor", "anchor_col", "p AS last",
                          "p_col AS last_col", "from_a", "first_lower", *_joined_bits(n_words)))
    known = sound.selectExpr("members AS subset", f"{_LOWER} AS got")
    return (tried.selectExpr("members", *rest, f"explode(transform(slice(parent, 2, {inner}), "
                                               "c -> array_remove(members, c))) AS subset")
                 .join(side(known), "subset").repartition(tasks, "members").groupBy("members", *rest).agg(F.expr("collect_list(got) AS others"))
                 .where(f"size(others) = {inner}")
                 .selectExpr("members", *[c for c in rest if c != "first_lower"],
                             "concat(array(first_lower), others) AS lower"))


def _judge(counted: DataFrame, n_words: int) -> DataFrame:
    """Whether each member of a candidate with known ``hits`` clearly lowers the added predicate."""
    kept = ["members", "anchor", "anchor_col", "last", "last_col", *[f"f{k}" for k in range(n_words)], "a"]
    a, b = "a", "(1L + from_a - a)"
    gap = beta.distance_sql("lo.log", "lo.spread", "edge_log", "edge_spread", "edge_mean")
    return (counted.selectExpr("*", "1L + hits AS a")
            .selectExpr(*kept, "lower", f"{beta.mean_log_sql(a, b)} AS edge_log",
                        f"{beta.spread_log_sql(a, b)} AS edge_spread", f"{beta.mean_sql(a, b)} AS edge_mean")
            .selectExpr(*kept, "edge_log", "edge_spread", f"array_min(transform(lower, lo -> {gap})) AS score")
            .selectExpr("*", f"score >= {beta.SOUND_DISTANCE}D AS sound"))


def lattice_levels(sample: Sample, max_size: int | None = None) -> Iterable[DataFrame]:
    """The judged predicate sets, level by level.

    What a level leaves behind is read by several joins of the next one and kept; every ``_CUT`` levels it is checkpointed,
    so that plans do not grow with the number of levels.
    """
    spark = sample.rows.df.sparkSession
    n_words = word_count(len(sample.rows.columns))
    nodes, size, n_nodes = _state_table(spark, sample), 1, 0
    index = _index(sample)
    preds = [s.pred for s in sample.states]
    left = all_patterns(index).selectExpr("array(anchor) AS members", "chunk", "mask")
    while max_size is None or size < max_size:
        size += 1
        if size == 2:
            candidates = _second_level(nodes, n_words)
        else:
            row_bytes = _NODE_BYTES + 16 * size + 8 * n_words
            candidates = _next_level(nodes, size, n_words, n_nodes * row_bytes <= P.BROADCAST_BYTES)
        candidates = candidates.persist()
        masks = narrowed(candidates.withColumn("parent", F.expr(f"slice(members, 1, {size - 1})")), left, index, preds)
        masks = checkpointed(masks) if size % _CUT == 0 else masks.persist()
        nodes = _judge(counted_hits(candidates, masks), n_words)
        nodes = checkpointed(nodes) if size % _CUT == 0 else nodes.persist()
        sample.cached += [candidates, masks, nodes]
        n_nodes, live = nodes.selectExpr("count(1)", "count_if(sound AND a > 1)").first()
        if n_nodes == 0:
            return
        yield nodes
        if live == 0:
            return          # every set of the next level would need one of these
        left = masks.select("members", "chunk", "mask")


def _index(sample: Sample) -> DataFrame:
    """Weighted bitmaps of the sample; no count exceeds the pairs drawn."""
    drawn = max((s.sampled_pairs for s in sample.states), default=0)
    return vertical_index(sample.anchored, len(sample.rows.columns), drawn)


def _rendered(found: DataFrame, sample: Sample) -> DataFrame:
    entries = local_table(sample.rows.df.sparkSession, [(s.rank, s.pred.col, s.pred.op, s.sampled_pairs)
                                                        for s in sample.states],
                          "rank int, col string, op string, pairs long")
    # At most six rows per column of the table.
    parts = (found.selectExpr("members", "anchor", "score", "explode(members) AS rank")
                  .join(F.broadcast(entries), "rank").groupBy("members", "score")
                  .agg(F.expr("array_sort(collect_list(struct(rank, col, op))) AS parts"),
                       F.expr("max(CASE WHEN rank = anchor THEN struct(pairs, col, op) END) AS first"))
                  .selectExpr("transform(parts, p -> struct(p.col AS col, p.op AS op)) AS predicates",
                              "score", "first"))
    return parts.select(dc_text(F.col("predicates")).alias("denial_constraint"), "predicates",
                        F.size("predicates").alias("size"), "score", F.col("first.pairs").alias("sampled_pairs"),
                        F.concat_ws(" ", "first.col", "first.op").alias("anchor"))


def discover(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, num_lines: int = -1,
             max_size: int | None = None, seed: int = 42, order_by: Sequence[str] | None = None,
             parity: bool = False, order_temporal: bool = False) -> DataFrame:
    """Denial constraints that no sampled pair violates and whose every predicate matters.

    ``order_by`` (unique columns) makes the sample independent of how the table is stored; without
    it rows are numbered in scan order and never sorted.
    """
    spark = df.sparkSession
    rows = index_rows(df, order_by, num_lines, parity, order_temporal)
    if rows.n < 2 or not rows.columns:
        return local_table(spark, [], RESULT_SCHEMA)
    sample = sample_table(rows, threshold, seed)
    found = [level.where("sound AND a = 1").select("members", "anchor", "score")
             for level in lattice_levels(sample, max_size)]
    if found:
        result = checkpointed(_rendered(functools.reduce(DataFrame.unionByName, found), sample))
    else:
        result = local_table(spark, [], RESULT_SCHEMA)
    sample.release()
    return result


def discover_table(spark: SparkSession, name_or_path: str, num_lines: int = -1,
                   threshold: float = DEFAULT_THRESHOLD, **options) -> DataFrame:
    """The table-function form: a table or CSV name in, one column ``denial_constraint`` out."""
    return discover(read_input(spark, name_or_path), threshold, num_lines, **options).select("denial_constraint")


def discover_many(tables: Mapping[str, DataFrame], threshold: float = DEFAULT_THRESHOLD,
                  order_by: Mapping[str, Sequence[str]] | None = None, **options) -> DataFrame:
    """Discovery over several tables, each constraint labelled with its ``section``."""
    parts = [discover(df, threshold, order_by=(order_by or {}).get(name), **options)
             .select(F.lit(name).alias("section"), "*") for name, df in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def dependency_scores(df: DataFrame, target: str | None = None, threshold: float = DEFAULT_THRESHOLD,
                      num_lines: int = -1, seed: int = 42, order_by: Sequence[str] | None = None) -> DataFrame:
    """How strongly each column lowers the chance of some comparison of the target column.

    ``(column_id, target_id, col, target, score, line)``; the score is the largest normalised
    distance over the pairs (comparison of the column, comparison of the target), at least 0.
    """
    spark = df.sparkSession
    rows = index_rows(df, order_by, num_lines)
    goal = rows.columns[0] if target is None else next(c for c in rows.columns if c.name == target)
    out = local_table(spark, [(c.col_id, goal.col_id, c.name, goal.name) for c in rows.columns],
                      "column_id int, target_id int, col string, target string")
    if rows.n < 2:
        scored = out.withColumn("score", F.lit(0.0))
        return scored.withColumn("line", dependency_text(F.col("column_id"), F.col("target_id"), F.col("score")))
    sample = sample_table(rows, threshold, seed)
    # The target's comparisons are always the added side, whatever their frequency.
    sample.states.sort(key=lambda s: s.pred.col_id != goal.col_id)
    moved = {s.rank: k for k, s in enumerate(sample.states)}
    renumber = "element_at(array({}), anchor + 1)".format(", ".join(str(moved[k]) for k in range(len(moved))))
    anchored = sample.anchored.withColumn("anchor", F.expr(renumber))
    for k, s in enumerate(sample.states):
        s.rank = k
    n_words = word_count(len(rows.columns))
    candidates = (_second_level(_state_table(spark, sample), n_words)
                  .where((F.col("last_col") == goal.col_id) & (F.col("anchor_col") != goal.col_id)))
    index = _index(Sample(rows, sample.states, anchored, []))
    masks = narrowed(candidates.withColumn("parent", F.expr("slice(members, 1, 1)")), all_patterns(index).selectExpr("array(anchor) AS members", "chunk", "mask"),
                     index, [s.pred for s in sample.states])
    best = (_judge(counted_hits(candidates, masks), n_words).groupBy(F.col("anchor_col").alias("column_id"))
            .agg(F.max("score").alias("score")))
    scored = checkpointed(
        out.join(best, "column_id", "left")
           .withColumn("score", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)))
           .withColumn("line", dependency_text(F.col("column_id"), F.col("target_id"), F.col("score"))))
    sample.release()
    return scored
