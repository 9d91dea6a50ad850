"""Hard negatives by threshold joins over truncated inverted indexes with suffix-norm bounds.

Scores are inner products of vectors rounded down to integers.  Rows are never moved: each task indexes its rows batch by
batch and joins a bounded slice of the anchors with them.  Columns of a batch go by falling energy, in blocks.  A row is posted in
the first blocks only: what is left of it, from the block on where its suffix norm can't lift any anchor to its threshold
alone, is not indexed.  Products are accumulated block by block; after each a pair goes when its partial score and the
norms of both suffixes stay below the anchor's threshold.  Pairs that remain are verified on all columns in 64-bit integers.

Thresholds fall until windows are full.  The nearest rows of an anchor's own label are sought above the best of a sample
first, then above as many of the sample as are wanted, then among all.  Its negatives lie in windows below fractions of those positives' scores,
and are sought in the upper part of the windows first; only anchors with a window that is not full go on with a lower
threshold.  Within a task thresholds rise again as lists fill.  All thresholds keep whatever could rank: results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsay.llm.common import quoted, sampled
from gainsay.shared import staged

#: Bytes of anchors in a slice, rows of the sample that sets first thresholds, columns of a block, pairs judged at once.
SLICE_BYTES, SAMPLE, BLOCK, PAIRS = 32 << 20, 4_096, 16, 2_000_000
#: Percentages of a positive's score at which the lower end of a window is set in turn, before the window's own end.
STEPS = (75, 55)
NONE = -(1 << 62)

_FOUND = pa.schema([("anchor", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Anchors:
    """A slice of the anchors; ``windows`` are (low, high) score ranges, ``floor`` the least score of interest."""

    ids: np.ndarray
    labels: np.ndarray
    w: np.ndarray
    floor: np.ndarray
    windows: list[list[tuple[int, int]]] = field(default_factory=list)

    def some(self, at: np.ndarray, floor: np.ndarray, windows: list | None = None) -> Anchors:
        return Anchors(self.ids[at], self.labels[at], self.w[at], floor, windows or [])


def norms(x: np.ndarray, block: int) -> np.ndarray:
    """Norms of the columns from each block on, and zero after the last; a little too large, so bounds stay safe."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], block), axis=1) if x.shape[1] else np.zeros((len(x), 0))
    rest = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
    return np.hstack([rest, np.zeros((len(x), 1))])


class Index:
    """Rows of a batch with their leading column blocks posted, as far as thresholds over anchor norms ask for."""

    def __init__(self, x: np.ndarray, least: float, block: int = BLOCK):
        self.order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.block, self.x = block, x.astype(np.float64)[:, self.order]
        self.rest = norms(self.x, block)
        #: Blocks in which a row is posted: the first with a suffix too short to reach the threshold ends them.
        self.posted = (self.rest[:, :-1] >= least).sum(axis=1)

    def pairs(self, w: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Anchor and row numbers of all pairs that may reach the anchor's floor, and of few others."""
        q = w.astype(np.float64)[:, self.order]
        rest, blocks = norms(q, self.block), self.rest.shape[1] - 1
        rows = np.flatnonzero(self.posted > 0)
        step = max(1, PAIRS // max(1, len(rows)))
        safe = floor - 1e-6 * (1 + np.abs(floor))
        for lo in range(0, len(q), step):
            some = slice(lo, lo + step)
            part = q[some, :self.block] @ self.x[rows, :self.block].T
            qi, at = np.nonzero(part + rest[some, 1:2] * self.rest[None, rows, 1] >= safe[some, None])
            part, qi, xi = part[qi, at], qi + lo, rows[at]
            for b in range(1, blocks):
                more = self.posted[xi] > b
                if not more.any():
                    break
                columns = slice(b * self.block, (b + 1) * self.block)
                gain = np.zeros(len(xi))
                gain[more] = np.einsum("ij,ij->i", q[qi[more], columns], self.x[xi[more], columns])
                part = part + gain
                seen = np.minimum(self.posted[xi], b + 1)
                stay = part + rest[qi, seen] * self.rest[xi, seen] >= safe[qi]
                qi, xi, part = qi[stay], xi[stay], part[stay]
            yield qi, xi


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``vec_id``, ``label`` and ``w`` (components times the scale, rounded down) of the rows that take part."""
    v = vectors[quoted(vector_col)].cast("array<double>")
    rows = vectors.select(vectors[quoted(id_col)].cast("long").alias("vec_id"), vectors[quoted(label_col)].cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
            .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("w")))


def nearest(rows: DataFrame, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """``anchor`` (its position), ``vec_id``, ``score``: of each task the rows that may rank, at or above the anchors' floors.

    With ``same`` the first ``k`` rows of the anchor's label but not its id, else the first ``k`` of other labels in each of its windows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = shared.value
        if not len(asking.ids):
            return
        floor, length = asking.floor.astype(np.float64), np.maximum(np.sqrt((asking.w.astype(np.float64) ** 2).sum(axis=1)), 1e-300)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for label in np.unique(labels).tolist() if same else [None]:
                rows_at = np.flatnonzero(labels == label) if same else np.arange(len(ids))
                who = np.flatnonzero(asking.labels == label) if same else np.arange(len(asking.ids))
                if not len(who):
                    continue
                ratio = floor[who] / length[who]
                index = Index(x[rows_at], float(ratio.min()) * (1 - 1e-9) if ratio.min() > 0 else -1.0)
                for qi, xi in index.pairs(asking.w[who], floor[who]):
                    qi, xi = who[qi], rows_at[xi]
                    fits = asking.ids[qi] != ids[xi] if same else asking.labels[qi] != labels[xi]
                    qi, xi = qi[fits], xi[fits]
                    score = (asking.w[qi] * x[xi]).sum(axis=1)
                    fits = score >= floor[qi]
                    qi, xi, score = qi[fits], xi[fits], score[fits]
                    cut = np.flatnonzero(np.diff(qi)) + 1
                    for a, i, s in zip(qi[np.append(0, cut)] if len(qi) else (), np.split(ids[xi], cut), np.split(score, cut)):
                        old = held.get(a, (np.empty(0, np.int64),) * 2)
                        i, s = np.concatenate([old[0], i]), np.concatenate([old[1], s])
                        order = np.lexsort((i, -s))
                        i, s = i[order], s[order]
                        keep = np.zeros(len(s), dtype=bool)
                        least = []
                        for lo, hi in asking.windows[a] if asking.windows else [(NONE, 1 << 62)]:
                            first = np.flatnonzero((s >= lo) & (s <= hi))[:k]
                            keep[first] = True
                            least.append(int(s[first[-1]]) if len(first) == k else lo)
                        held[a] = i[keep], s[keep]
                        floor[a] = max(floor[a], min(least))
        for a, (i, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), a, np.int32)), pa.array(i), pa.array(s)], schema=_FOUND)

    return rows.mapInArrow(run, "anchor int, vec_id long, score long")


def positives_of(rows: DataFrame, slice_: Anchors, first: np.ndarray, k: int) -> dict[int, list[tuple[int, int]]]:
    """Per anchor its ``k`` nearest rows of the same label, as (id, score): one slice's worth.

    ``first`` holds per anchor the thresholds to try, falling; the last one admits every row.
    """
    out: dict[int, list[tuple[int, int]]] = {}
    left = np.arange(len(slice_.ids))
    for step in range(first.shape[1]):
        floor = first[left, step]
        got = nearest(rows, slice_.some(left, floor), k, True)
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
        best = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).orderBy("anchor", "rank").collect()
        found: dict[int, list[tuple[int, int]]] = {}
        for r in best:
            found.setdefault(r["anchor"], []).append((r["vec_id"], r["score"]))
        full = np.array([len(found.get(j, ())) == k or floor[j] == NONE for j in range(len(left))], dtype=bool)
        out.update({int(left[j]): found.get(j, []) for j in np.flatnonzero(full).tolist()})
        left = left[~full]
        if not len(left):
            break
    return out


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    For each of an anchor's first ``positives`` rows of its own label, the first ``negatives`` rows of other labels whose score lies in
    the window, in percent of the positive's score.  Higher scores come first, ties by the smaller id.  Rows with a null id, label or
    vector, with a null or non-finite component, or of another length than most take no part.  Rows of the anchor's id are not its
    positives; of several rows of an anchor's id the one of the least label and vector asks; other repeated rows are
    rows of their own.  A zero or negative positive score leaves no window but, for zero, scores of zero.  Scores are 64-bit integers.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = staged(quantised(vectors, id_col, vector_col, label_col, scale))
    sizes = rows.groupBy(F.size("w").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None or not sizes["d"]:
        return none
    dims, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("w") == dims)
    flag = vectors.select(vectors[quoted(id_col)].cast("long").alias("vec_id"), is_anchor.alias("asks")).where("asks").select("vec_id").distinct()
    asking = staged(rows.join(flag, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "w")).alias("r")).select("vec_id", "r.label", "r.w"))
    sample = rows.where(sampled(F.struct("vec_id", "w"), SAMPLE, n)).select("label", "w", "vec_id").distinct().collect()     # about SAMPLE rows
    shared = spark.sparkContext.broadcast((np.array([r[0] for r in sample]), np.array([r[1] for r in sample], dtype=np.int64).reshape(-1, dims),
                                           np.array([r[2] for r in sample])))
    slices = -(-asking.count() * dims * 8 // SLICE_BYTES)
    out = none
    for k in range(slices):
        part = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == k)
        held = _thresholds(part, shared, positives).collect()                                   # about SLICE_BYTES
        if held:
            out = out.unionByName(_sliced(rows, held, dims, positives, negatives, window))
    return out


def _thresholds(part: DataFrame, sample, k: int) -> DataFrame:
    """Anchors with the scores of the best and the k-th best sample row of their label; null where there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, w, ids = sample.value
        for batch in batches:
            best, kth = [], []
            for i, label, own in zip(*(batch.column(c).to_pylist() for c in range(3))):
                scores = np.sort(w[(labels == label) & (ids != i)] @ np.array(own, dtype=np.int64)) if len(ids) else []
                best.append(int(scores[-1]) if len(scores) else None)
                kth.append(int(scores[-k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int64()), pa.array(kth, pa.int64())],
                                             names=[*batch.schema.names, "best", "kth"])

    return part.mapInArrow(run, "vec_id long, label long, w array<long>, best long, kth long")


def _sliced(rows: DataFrame, held: list, dims: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    spark = rows.sparkSession
    slice_ = Anchors(np.array([r["vec_id"] for r in held]), np.array([r["label"] for r in held]),
                     np.array([r["w"] for r in held], dtype=np.int64).reshape(-1, dims), np.empty(0))
    first = np.array([[NONE if r[c] is None else r[c] for c in ("best", "kth")] + [NONE] for r in held], dtype=np.int64)
    near = positives_of(rows, slice_, first, positives)
    low, high = window
    ranges = {(a, p): (-(-low * s // 100), high * s // 100) for a, own in near.items() for p, (_, s) in enumerate(own)}
    open_ = {key: r for key, r in ranges.items() if r[0] <= r[1]}
    parts = []
    for percent in (*[s for s in STEPS if low < s < high], low):
        if not open_:
            break
        tried = {(a, p): (max(r[0], -(-percent * near[a][p][1] // 100)), r[1]) for (a, p), r in open_.items()}
        who = sorted({a for a, _ in tried})
        at = {a: j for j, a in enumerate(who)}
        windows: list[list[tuple[int, int]]] = [[] for _ in who]
        for (a, _), r in sorted(tried.items()):
            windows[at[a]].append(r)
        some = slice_.some(np.array(who), np.array([min(r[0] for r in w) for w in windows], dtype=np.int64), windows)
        shape = spark.createDataFrame([(at[a], p, lo, hi, int(slice_.ids[a]), *near[a][p]) for (a, p), (lo, hi) in tried.items()],
                                      "anchor int, p int, lo long, hi long, anchor_id long, positive_id long, positive_score long")
        order = Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "vec_id")
        ranked = staged(nearest(rows, some, negatives, False).join(F.broadcast(shape), "anchor").where("score BETWEEN lo AND hi")    # bounded by the slice
                        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives))
        full = {(who[r["anchor"]], r["p"]) for r in ranked.groupBy("anchor", "p").count().where(F.col("count") == negatives).collect()}
        done = set(open_) if percent == low else full
        final = spark.createDataFrame([(at[a], p) for a, p in done], "anchor int, p int")
        parts.append(ranked.join(F.broadcast(final), ["anchor", "p"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
                                                                              "positive_score", F.col("score").alias("negative_score")))
        open_ = {key: r for key, r in open_.items() if key not in done}
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for part in parts:
        out = out.unionByName(part)
    return out
