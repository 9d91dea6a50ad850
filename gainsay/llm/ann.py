"""Approximate nearest neighbours by largest inner product, with an adaptive scan of dimensions.

Vectors are dealt to the lists of the nearest centroids; centroids and a random rotation are fitted on a bounded sample, but every
row is indexed.  A query looks at the lists nearest to it.  Within a list the rotated vectors are scanned in blocks of
columns: after each block a test asks whether the partial product could still belong to a vector that beats the query's
current k-th best, and drops the candidate where that is unlikely.  The rotation makes a prefix of columns a random sample of
the dimensions, which is what the test rests on.  Survivors are scored on the original vectors in double precision.

Lists are cut into parts of bounded size and so are the queries of a list; each pair of parts is a task's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsay.llm.common import mapped, quoted, sampled
from gainsay.shared import staged

#: Rows that centroids are fitted on, most lists, and rounds of k-means.
SAMPLE, LISTS, ROUNDS = 20_000, 2_048, 12
#: Share of near sample rows that the probed lists must hold, the sample queries that set it, and the fewest lists.
TARGET, TRIALS, LEAST_PROBED = 0.96, 256, 8
#: Of the mean squared distance of rows, the share within which two are near copies.
NEAR = 0.05
#: Rows and queries of a group, columns of a block, fully scored rows that set the first bound, and the test's quantile.
PART, QUERIES, BLOCK, SEED_ROWS, QUANTILE = 4_096, 256, 16, 256, 3.0


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(vectors: DataFrame, n: int, k: int, target: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroids, an orthogonal rotation and the lists to probe, from about ``SAMPLE`` distinct rows chosen by a hash.

    As many lists are probed as hold the target share of the k nearest sample rows of sample queries, which are drawn at
    random and are no copies of each other.  Nearest rows of the whole table are nearer, so this errs on the side of more.
    """
    rows = vectors.where(sampled(F.struct("vec_id", "v"), SAMPLE, n)).select("vec_id", "v").distinct().orderBy("vec_id", "v").toPandas()["v"]
    rows = rows if len(rows) else vectors.agg(F.min("v").alias("v")).toPandas()["v"]        # where all rows are copies, or few
    x = np.stack(rows.to_numpy()).astype(np.float64)
    rng = np.random.default_rng(7)
    lists = int(min(LISTS, max(1, np.sqrt(n)), len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=lists)[:, None]
        centres = np.where(size > 0, total / np.maximum(size, 1), x[rng.choice(len(x), lists)])
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    asked = apart(x, rng)
    trials = len(asked)
    products = x[asked] @ x.T
    products[np.arange(trials), asked] = -np.inf
    top = np.argsort(-products, axis=1, kind="stable")[:, :k]
    order = nearest(x[asked], centres, lists) if lists > 1 else np.zeros((trials, 1), dtype=int)
    needed = np.argsort(order, axis=1)[np.arange(trials)[:, None], nearest(x, centres, 1)[:, 0][top]] + 1
    return centres, rotation, max(LEAST_PROBED, int(np.quantile(needed, target, method="higher")))


def apart(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of at most ``TRIALS`` random rows that are no copies or near copies of each other.

    Rows count as near copies where their squared distance is below ``NEAR`` of its mean over all pairs.
    """
    least = NEAR * 2 * x.var(axis=0).sum()
    drawn: list[int] = []
    held = np.empty((TRIALS, x.shape[1]))
    for i in rng.permutation(len(x)).tolist():
        if not drawn or ((held[:len(drawn)] - x[i]) ** 2).sum(axis=1).min() > least:
            held[len(drawn)] = x[i]
            drawn.append(i)
            if len(drawn) == TRIALS:
                break
    return np.array(drawn)


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    distance = (centres ** 2).sum(axis=1) - 2 * x @ centres.T
    if k == 1:
        return distance.argmin(axis=1)[:, None]
    return np.argsort(distance, axis=1, kind="stable")[:, :k]


def scan(queries: np.ndarray, rows: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query and row numbers of the pairs that survive the scan of one group."""
    q, x = queries @ rotation, rows @ rotation
    dims = q.shape[1]
    norms_q, norms_x = np.sqrt((q ** 2).sum(axis=1)), np.sqrt((x ** 2).sum(axis=1))
    seeds = min(len(x), max(SEED_ROWS, 2 * k))
    full = q @ x[:seeds].T
    bound = np.partition(full, seeds - k - 1, axis=1)[:, seeds - k - 1] if seeds > k else np.full(len(q), -np.inf)
    bound = bound - 1e-9 * (1 + np.abs(bound))
    qi, xi = np.nonzero(full >= bound[:, None])
    yield qi, xi
    step = max(1, 100_000 // max(1, len(x)))       # all pairs of a step may survive where many rows are alike
    for lo in range(0, len(q) if seeds < len(x) else 0, step):
        some = slice(lo, lo + step)
        partial = q[some, :BLOCK] @ x[seeds:, :BLOCK].T
        qi, xi = np.nonzero(np.ones_like(partial, dtype=bool) if dims <= BLOCK else passes(partial, q[some], norms_q[some], norms_x[seeds:], bound[some], BLOCK))
        part, qi, xi = partial[qi, xi], qi + lo, xi + seeds
        for at in range(BLOCK, dims, BLOCK):
            part = part + (q[qi, at:at + BLOCK] * x[xi, at:at + BLOCK]).sum(axis=1)
            seen = min(at + BLOCK, dims)
            share = (q[qi, :seen] ** 2).sum(axis=1) / norms_q[qi] ** 2 if seen < dims else np.ones(len(qi))
            slack = QUANTILE * norms_q[qi] * norms_x[xi] * np.sqrt(np.maximum(share * (1 - share), 0) / dims)
            stay = part >= bound[qi] * share - slack
            qi, xi, part = qi[stay], xi[stay], part[stay]
        yield qi, xi


def passes(partial: np.ndarray, q: np.ndarray, norms_q: np.ndarray, norms_x: np.ndarray, bound: np.ndarray, seen: int) -> np.ndarray:
    """Whether a pair may reach the query's bound, given its product over the first ``seen`` columns.

    Of a product p over all columns, a share is expected in the columns seen: that of the query's squared length.  The rest of the
    partial product has a spread set by both lengths.  Pairs below expectation by more than the quantile are dropped.
    """
    share = (q[:, :seen] ** 2).sum(axis=1) / norms_q ** 2
    spread = QUANTILE * (norms_q * np.sqrt(share * (1 - share) / q.shape[1]))[:, None] * norms_x
    return partial >= (bound * share)[:, None] - spread


def search(embeddings: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           target: float = TARGET) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k nearest rows found for each query.

    Rows without an id or a usable vector, or of another length than most, take no part.  A query's own id is no candidate.
    Ties go to the smaller id.  Of a query id with several vectors the least one is searched; repeated candidates are all listed.
    A query looks at further lists until they hold more than k rows, so it gets k rows wherever there are as many.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(embeddings[quoted(id_col)].cast("long").alias("vec_id"), embeddings[quoted(vector_col)].cast("array<double>").alias("v"),
                             is_query.alias("asked")).where("vec_id IS NOT NULL").where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes["d"])
    shared = spark.sparkContext.broadcast(fit(rows, sizes["count"], k, target))     # at most LISTS centroids

    def assign(cols: dict[str, list]) -> Iterator[tuple]:
        where = nearest(np.array(cols["v"]), shared.value[0], 1)[:, 0].tolist()
        yield from zip(where, cols["vec_id"], cols["v"])

    placed = staged(mapped(rows.select("vec_id", "v"), assign, "list int, vec_id long, v array<double>"))
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}     # at most LISTS rows
    held = np.array([counts.get(i, 0) for i in range(len(shared.value[0]))])
    least = shared.value[2]
    parts = spark.sparkContext.broadcast(-(-held // PART))

    def probe(cols: dict[str, list]) -> Iterator[tuple]:
        order = nearest(np.array(cols["v"]), shared.value[0], len(held)) if len(held) > 1 else np.zeros((len(cols["v"]), 1), dtype=int)
        reached = np.cumsum(held[order], axis=1)
        for query, v, lists, sums in zip(cols["query_id"], cols["v"], order, reached):
            for which in lists[:max(least, int(np.searchsorted(sums, k + 1)) + 1)].tolist():
                if held[which]:
                    yield which, query, v

    queries = rows.where("asked").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    probes = staged(mapped(queries, probe, "list int, query_id long, v array<double>"))
    asked = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}       # at most LISTS rows
    shape = spark.createDataFrame([(i, int(parts.value[i]), -(-n // QUERIES)) for i, n in asked.items()], "list int, parts int, qparts int")
    shape = F.broadcast(shape)
    left = (probes.join(shape, "list").withColumn("qpart", F.pmod(F.xxhash64("query_id"), F.col("qparts")).cast("int"))
            .select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qpart", "query_id", F.lit(None).cast("long").alias("vec_id"), "v"))
    right = (placed.join(shape, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
             .select("list", "part", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)).alias("qpart"), F.lit(None).cast("long").alias("query_id"), "vec_id", "v"))

    def group(part: pd.DataFrame) -> pd.DataFrame:
        asking, offered = part[part["vec_id"].isna()], part[part["query_id"].isna()]
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(asking) or not len(offered):
            return none
        q, x = np.stack(asking["v"].to_numpy()), np.stack(offered["v"].to_numpy())
        ids_q, ids_x = asking["query_id"].to_numpy(np.int64), offered["vec_id"].to_numpy(np.int64)
        best = [none]
        for qi, xi in scan(q, x, shared.value[1], k):
            other = ids_q[qi] != ids_x[xi]
            qi, xi = qi[other], xi[other]
            found = pd.DataFrame({"query_id": ids_q[qi], "vec_id": ids_x[xi], "score": (q[qi] * x[xi]).sum(axis=1)})
            best.append(found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k))
        return pd.concat(best)

    found = left.unionByName(right).groupBy("list", "part", "qpart").applyInPandas(group, "query_id long, vec_id long, score double")
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
