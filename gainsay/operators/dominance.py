"""Which rows take part in a violation under any number of orderings and inequalities, without pairing rows up.

Distinct combinations of the compared values are points.  Groups of up to a piece are decided whole, many in a task, in both roles
at once.  Larger groups are cut into tiles by quantiles of one column after
another, and points of a tile are dealt to pieces of bounded size with bounding boxes.  Pairs of boxes are judged before any point is
looked at, first those of coarse tiles, then those of pieces: a pair whose boxes admit no violation is dropped, and a box whose
every point is beaten by every point of another is settled as a whole.  Only what is left compares points, piece against
piece, and keeps one answer per point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.operators.grouped import bounds, codes, whole_groups
from gainsay.shared import staged

#: Points of a piece, tiles along a column that make a coarse one, and pieces that meet one other within a task.
PIECE, COARSE, SPREAD = 1_024, 8, 64
#: Points of small groups that a task takes up at once, neighbours each meets before what is left of a group
#: is compared whole, and rows handed back at once.
TAKEN, NEAR, BATCH = 1 << 16, 16, 1 << 13
#: Points of pieces that a task reads at once; an Arrow batch may hold thousands of pieces.
SLICE = 1 << 15
MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
_FUNCTION = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}
_HITS = pa.schema([("id", pa.int64()), ("at", pa.list_(pa.int32()))])


def either(groups: DataFrame, keys: Sequence[str], orders: Sequence[tuple[str, str]], differ: Sequence[str], real: Sequence[str]) -> DataFrame:
    """The points with a partner in either role, each once; the arguments are those of :func:`hits`."""
    names = [*keys, *[c for c, _ in orders], *differ]
    sizes = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = staged(sizes.where(F.col("__n") > PIECE).drop("__n")) if keys else None
    if large is None:
        parts = (groups, None) if sizes.first()[0] <= PIECE else (None, groups)
    elif large.isEmpty():
        parts = groups, None
    else:
        parts = groups.join(large, list(keys), "left_anti"), staged(groups.join(large, list(keys), "left_semi"))
    small, rest = parts
    out = _small(small, keys, orders, differ, real) if small is not None else None
    if rest is None:
        return out
    roles = [hits(rest, keys, [(c, o if role == "x" else MIRROR[o]) for c, o in orders], differ, real).select(*names) for role in "xy"]
    both = roles[0].unionByName(roles[1]).distinct()
    return both if out is None else out.unionByName(both)


def _small(groups: DataFrame, keys, orders, differ, real) -> DataFrame:
    """As :func:`either`, for groups of at most ``PIECE`` points."""
    names = [*keys, *[c for c, _ in orders], *differ]
    own = F.expr(_alike(orders, differ, real)).alias("__own")
    rows = groups.select(*names, own)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys) if keys else rows.repartition(1)      # without keys at most one piece
    at, schema = len(keys), groups.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, held in whole_groups(batches, at, TAKEN):
            dims = [held.column(at + i).to_numpy() for i in range(len(orders))]
            apart = [held.column(k).to_numpy() if pa.types.is_floating(held.schema.types[k]) else codes(held.column(k))      # NaN differs from all
                     for k in range(at + len(orders), len(names))]
            met = _met(group, held.column(len(names)).to_numpy(zero_copy_only=False), dims, [o for _, o in orders], apart)
            found = held.select(list(range(len(names)))).filter(pa.array(met))
            for lo in range(0, len(found), BATCH):
                yield found.slice(lo, BATCH)

    return rows.mapInArrow(run, schema)


def _met(group: np.ndarray, own: np.ndarray, dims: list[np.ndarray], ops: list[str], apart: list[np.ndarray]) -> np.ndarray:
    """Which points meet a partner of their group in either role, besides those that are their ``own`` partner."""
    lo, hi = bounds(group)
    met = own.copy()

    def violates(i, j):
        either = np.zeros(np.broadcast(i, j).shape, dtype=bool)
        for side in (ops, [MIRROR[o] for o in ops]):
            one = np.ones(either.shape, dtype=bool)
            for o, d in zip(side, dims):
                one &= _FUNCTION[o](d[i], d[j])
            either |= one
        for d in apart:
            either &= d[i] != d[j]
        return either

    # Most points that violate find a partner among their neighbours, so few are left for the rest of the group.
    for step in range(1, NEAR + 1):
        left = np.flatnonzero(~met)
        left = left[hi[left] - lo[left] > step]
        if not len(left):
            return met
        for i, j in ((left[left + step < hi[left]], step), (left[left - step >= lo[left]], -step)):
            bad = i[violates(i, i + j)]
            met[bad] = met[bad + j] = True
    left = np.flatnonzero(~met & (hi - lo > NEAR + 1))
    cuts = np.flatnonzero(np.diff(lo[left], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        i, others = left[a:b], np.arange(lo[left[a]], hi[left[a]])
        bad = violates(i[:, None], others[None, :])
        bad &= i[:, None] != others[None, :]
        met[i[bad.any(axis=1)]] = True
    return met


def _alike(orders, differ, real) -> str:
    """Rows of one point are partners of each other where nothing has to differ, or all that has to is NaN."""
    weak = all(op in ("<=", ">=") for _, op in orders)
    return " AND ".join(["c > 1", *[f"isnan({c})" if c in real else "false" for c in differ]]) if weak else "false"


def hits(groups: DataFrame, keys: Sequence[str], orders: Sequence[tuple[str, str]], differ: Sequence[str], real: Sequence[str]) -> DataFrame:
    """The points that have a partner: equal keys, ``point op partner`` for every ordering, other values in all of ``differ``.

    ``groups`` holds distinct points (keys, ordered and differing columns) with their number of rows ``c`` and no NaN among keys
    and orderings.  Columns of ``differ`` listed in ``real`` follow IEEE rules: NaN differs from all.
    """
    names = [*keys, *[c for c, _ in orders], *differ]
    weak = all(op in ("<=", ">=") for _, op in orders)
    by = list(keys) or ["__all"]
    points = groups if keys else groups.withColumn("__all", F.lit(0))
    pieces = _pieces(points, by, orders, differ, real)
    boxes = pieces.drop("points")
    coarse = boxes.groupBy(*by, "coarse").agg(*_extremes(len(orders), len(differ), "min(lo{})", "max(hi{})", "min(ul{})", "max(uh{})"))
    possible, covers = _possible(orders, differ, real), _covers(orders, differ)
    same = "false" if differ or not weak else "{0}"

    a, b = (coarse.select(*by, *[F.col(c).alias(f"{s}_{c}") for c in coarse.columns if c not in by]) for s in "ab")
    tiles = staged(a.join(b, by).where(possible).selectExpr(*by, "a_coarse", "b_coarse", f"{covers} AND NOT ({same.format('a_coarse = b_coarse')}) AS whole"))
    settled = tiles.where("whole").select(*by, F.col("a_coarse").alias("coarse")).distinct()
    # Coarse tiles that are not settled: their pieces meet the pieces of the tiles that may hold partners.
    open_ = tiles.join(settled.withColumnRenamed("coarse", "a_coarse"), [*by, "a_coarse"], "left_anti").drop("whole")
    sides = {s: boxes.select(*by, *[F.col(c).alias(f"{s}_{c}") for c in boxes.columns if c not in by]) for s in "ab"}
    pairs = staged(open_.join(sides["a"], [*by, "a_coarse"]).join(sides["b"], [*by, "b_coarse"]).where(possible)
                   .selectExpr("a_id AS a", "b_id AS b", f"{covers} AND NOT ({same.format('a_id = b_id')}) AS whole"))
    done = pairs.where("whole").select("a").distinct()
    left = pairs.join(done, "a", "left_anti").select("a", "b")

    whole = boxes.join(settled, [*by, "coarse"], "left_semi").select("id").unionByName(done.withColumnRenamed("a", "id"))
    own = pieces.join(left.where("a = b").select(F.col("a").alias("id")), "id", "left_semi")
    found = staged(_within(own, orders, differ, real).unionByName(_across(left.where("a <> b"), pieces, orders, differ, real))
                   .unionByName(whole.select("id", F.lit(None).cast("array<int>").alias("at"))))
    at = found.select("id", F.explode_outer("at").alias("at")).distinct().groupBy("id").agg(
        F.max(F.col("at").isNull()).alias("all"), F.collect_list("at").alias("at"))
    hit = pieces.select("id", *keys, "points").join(at, "id").select(*keys, F.explode(F.when(F.col("all"), F.col("points")).otherwise(
        F.transform("at", lambda i: F.get("points", i)))).alias("p"))
    out = hit.select(*keys, *[F.col(f"p.{c}").alias(c) for c in names if c not in keys])
    if weak:
        out = out.unionByName(groups.where(_alike(orders, differ, real)).select(*names))
    return out


def _tests(orders, names: dict[str, str]) -> list[str]:
    return [names[op].format(i=i) for i, (_, op) in enumerate(orders)]


def _possible(orders, differ, real) -> str:
    """Two boxes may hold a point and its partner."""
    tests = _tests(orders, {"<": "a_lo{i} < b_hi{i}", "<=": "a_lo{i} <= b_hi{i}", ">": "a_hi{i} > b_lo{i}", ">=": "a_hi{i} >= b_lo{i}"})
    for j, c in enumerate(differ):
        nan = f" AND a_ul{j} <> 'NaN'" if c in real else ""
        tests.append(f"NOT (a_ul{j} = a_uh{j} AND b_ul{j} = b_uh{j} AND a_ul{j} = b_ul{j}{nan})")
    return " AND ".join(tests)


def _covers(orders, differ) -> str:
    """Every point of the one box surely has a partner in the other."""
    tests = _tests(orders, {"<": "a_hi{i} < b_lo{i}", "<=": "a_hi{i} <= b_lo{i}", ">": "a_lo{i} > b_hi{i}", ">=": "a_lo{i} >= b_hi{i}"})
    apart = [f"(a_uh{j} < b_ul{j} OR a_ul{j} > b_uh{j})" for j in range(len(differ))]
    # Of two values in a column one differs from any third.
    choices = [" AND ".join(apart)] + [" AND ".join([*apart[:j], f"b_ul{j} <> b_uh{j}", *apart[j + 1:]]) for j in range(len(differ))]
    return " AND ".join([*tests, "(" + " OR ".join(f"({c})" for c in choices) + ")"] if differ else tests)


def _extremes(n_orders: int, n_differ: int, lo: str, hi: str, ul: str, uh: str) -> list:
    out = []
    for i in range(n_orders):
        out += [F.expr(lo.format(i)).alias(f"lo{i}"), F.expr(hi.format(i)).alias(f"hi{i}")]
    for j in range(n_differ):
        out += [F.expr(ul.format(j)).alias(f"ul{j}"), F.expr(uh.format(j)).alias(f"uh{j}")]
    return out


def _pieces(points: DataFrame, by: list[str], orders, differ, real) -> DataFrame:
    """``id``, keys, ``coarse`` tile, box (``lo``, ``hi`` per ordering, ``ul``, ``uh`` per differing column) and ``points``, stored once."""
    dims = [c for c, _ in orders]
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    fan = 1
    while fan ** len(dims) * PIECE < largest:
        fan += 1
    tiles = [f"__t{i}" for i in range(len(dims))]
    if fan == 1:
        rows = points.select("*", *[F.lit(0).alias(t) for t in tiles])
    else:
        rows = points.join(sizes.where(F.col("__n") > PIECE).select(*by, F.lit(True).alias("__big")), by, "left")
        shares = ", ".join(f"{k / fan!r}D" for k in range(1, fan))
        for i, c in enumerate(dims):
            cuts = rows.where("__big").groupBy(*by, *tiles[:i]).agg(F.expr(f"percentile_approx({c}, array({shares}), {100 * fan})").alias("__cuts"))
            rows = rows.join(cuts, [*by, *tiles[:i]], "left").withColumn(tiles[i], F.expr(f"coalesce(size(filter(__cuts, x -> x < {c})), 0)")).drop("__cuts")
        rows = staged(rows.drop("__big"))
    counts = rows.groupBy(*by, *tiles).agg(F.count(F.lit(1)).alias("__m"))
    code = [F.expr(f"CAST({c} + 0.0D AS STRING)" if c in real else f"CAST({c} AS STRING)").alias(f"u{j}") for j, c in enumerate(differ)]
    dealt = rows.join(counts, [*by, *tiles]).withColumn("__s", F.pmod(F.xxhash64(*dims, *differ), F.ceil(F.col("__m") / PIECE)))
    point = F.struct(*dims, *differ, *[f"u{j}" for j in range(len(differ))])
    boxes = dealt.select("*", *code).groupBy(*by, *tiles, "__s").agg(
        *[x for i, c in enumerate(dims) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))],
        *[x for j in range(len(differ)) for x in (F.min(f"u{j}").alias(f"ul{j}"), F.max(f"u{j}").alias(f"uh{j}"))],
        F.collect_list(point).alias("points"))                   # about PIECE of them
    coarse = F.concat_ws(",", *[F.floor(F.col(t) / COARSE).cast("string") for t in tiles])
    return staged(boxes.withColumn("coarse", coarse).withColumn("id", F.monotonically_increasing_id()).drop(*tiles, "__s"))


def _beats(a: list[np.ndarray], b: list[np.ndarray], orders, differ, real) -> np.ndarray:
    """Which points of ``a`` (rows) have which of ``b`` as partners."""
    met = np.ones((len(a[0]), len(b[0])), dtype=bool)
    for i, (_, op) in enumerate(orders):
        met &= _FUNCTION[op](a[i][:, None], b[i][None, :])
    for j, c in enumerate(differ):
        left, right = a[len(orders) + j], b[len(orders) + j]
        codes = np.unique(np.concatenate([left, right]), return_inverse=True)[1]
        one, two = codes[:len(left)].copy(), codes[len(left):].copy()
        if c in real:
            one[left == "NaN"], two[right == "NaN"] = -1, -2
        met &= one[:, None] != two[None, :]
    return met


def _lists(column: pa.Array, orders, differ) -> list[list[np.ndarray]]:
    """Per row of an Arrow column of points the values of its columns."""
    flat, ends = column.flatten(), column.offsets.to_numpy()
    ends = ends - ends[0]
    fields = [c for c, _ in orders] + [f"u{j}" for j in range(len(differ))]
    values = [pc.struct_field(flat, [f]).to_numpy(zero_copy_only=False) for f in fields]
    return [[v[lo:hi] for v in values] for lo, hi in zip(ends[:-1], ends[1:])]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``SLICE`` points in this column of lists."""
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _batch(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([at.tolist() for _, at in rows], pa.list_(pa.int32()))], schema=_HITS)


def _within(pieces: DataFrame, orders, differ, real) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            rows = []
            for i, own in zip(batch.column(0).to_pylist(), _lists(batch.column(1), orders, differ)):
                met = _beats(own, own, orders, differ, real)
                np.fill_diagonal(met, False)
                at = np.flatnonzero(met.any(axis=1))
                if len(at):
                    rows.append((i, at))
            if rows:
                yield _batch(rows)

    return pieces.select("id", "points").mapInArrow(run, "id long, at array<int>")


def _across(pairs: DataFrame, pieces: DataFrame, orders, differ, real) -> DataFrame:
    """Points of ``a`` with a partner in ``b``; the ``b`` of one ``a`` pass by its points, at most about ``SPREAD`` in a task."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("id"))
    owners = parts.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    rows = owners.unionByName(dealt).join(pieces.select("id", "points"), "id").select("a", "part", "b", "points")
    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, own, open_ = None, [], np.empty(0, dtype=np.int64)
        for batch in _slices(batches, 3):
            rows = []
            for a, part, b, other in zip(*(batch.column(k).to_pylist() for k in range(3)), _lists(batch.column(3), orders, differ)):
                if b is None:
                    owner, own, open_ = (a, part), other, np.arange(len(other[0]))
                elif owner == (a, part) and len(open_):
                    met = _beats([v[open_] for v in own], other, orders, differ, real).any(axis=1)
                    if met.any():
                        rows.append((a, open_[met]))
                        open_ = open_[~met]
            if rows:
                yield _batch(rows)

    return ordered.mapInArrow(run, "id long, at array<int>")

