"""Near-duplicate vectors by NN-descent.

Every distinct vector of a label is a node with a short list of neighbours.  Lists start from leaves of random hyperplane trees and are
refined by neighbours of neighbours: the members around each node, those in its list and those whose list holds it, are compared
with each other and every node keeps the nearest it has met.  A list that holds links only is saturated: its node may have more.
Saturated nodes that lie within half the link angle of their component's mean all link with each other, so they are contracted
into one node, a ball with a centre and a radius, and no pair of them is listed; where that does not help, lists are doubled until
they hold something that is no link.  An audit compares a bounded random sample of nodes with all others
and has further rounds run while too many of its links are missing.

Refinement works on vectors rounded to bytes, with bounds on their error; candidates are checked by cosine in double precision on the vectors.
A pair of balls is linked as a whole, dropped as a whole, or looked into where the angle between the centres leaves it open.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsay.llm.common import quoted, sampled
from gainsay.llm.components import components
from gainsay.shared import staged

#: Neighbours of a list to begin with, members compared with each other at once, nodes a leaf is meant to hold, and trees.
NEIGHBOURS, GROUP, LEAF, TREES = 8, 256, 64, 6
#: Rounds between audits, nodes of an audit, share of their links that must be known, and audits at most.
ROUNDS, AUDIT, RECALL, AUDITS = 8, 1_024, 0.97, 4
#: Contractions at most, and the fewest nodes of a ball.
CONTRACTIONS, BALL = 3, 4
#: Angles this close to a bound are looked into.
MARGIN = 1e-7

_NODE = "node long, label string, v array<double>, q binary, s float, e float, radius double, k int"
_EDGE = "u long, v long, gap double, low double, fresh boolean, k int"
_CANDIDATE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("gap", pa.float64()), ("low", pa.float64()), ("fresh", pa.bool_()), ("k", pa.int32())])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def angle(cos: Column) -> Column:
    return F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))


def rounded(nodes: DataFrame) -> DataFrame:
    """Adds the unit vector in bytes ``q``, its scale ``s`` and error ``e`` (a norm) to ``node, label, v, radius, k``."""
    names = ["node", "label", "v", "q", "s", "e", "radius", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, s, e = [], [], []
            for own in batch.column(2):
                x = np.array(own.values.to_numpy())
                x = x / np.abs(x).max()
                x /= np.sqrt((x * x).sum())
                scale = np.float32(np.abs(x).max() / 127)
                near = np.clip(np.rint(x / scale), -127, 127).astype(np.int8)
                q.append(near.tobytes())
                s.append(scale)
                e.append(np.sqrt(((x - near * np.float64(scale)) ** 2).sum()) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(q, pa.binary()), pa.array(s, pa.float32()),
                                              pa.array(e, pa.float32()), batch.column(3), batch.column(4)], names=names)

    return nodes.select("node", "label", "v", "radius", "k").mapInArrow(run, _NODE)


def dealt(nodes: DataFrame, seed: int) -> DataFrame:
    """``g``, ``m``, ``fresh``: every node in a leaf of each of some random trees over the nodes of its label."""
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.select("node", "label", "q").join(sizes, "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids, vectors, n = (batch.column(c).to_pylist() for c in ("label", "node", "q", "n"))
            g, m = [], []
            for label, node, own, size in zip(labels, ids, vectors, n):
                x = np.frombuffer(own, dtype=np.int8).astype(np.float32)
                bits = max(0, math.ceil(math.log2(max(1, size / LEAF))))
                trees = 1 if not bits else TREES + bits // 4
                side = x @ _planes(len(x), trees * bits, seed) > 0 if bits else np.zeros(0, dtype=bool)
                for t in range(trees):
                    g.append(f"{t}:{np.packbits(side[t * bits:(t + 1) * bits]).tobytes().hex()}:{label}")
                    m.append(node)
            if g:
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(m, pa.int64()), pa.array(np.ones(len(g), dtype=bool))], names=["g", "m", "fresh"])

    return rows.mapInArrow(run, "g string, m long, fresh boolean")


@functools.lru_cache(maxsize=8)
def _planes(dims: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, n)).astype(np.float32)


def compared(groups: DataFrame, nodes: DataFrame, worst: DataFrame | None, seed: int) -> DataFrame:
    """New neighbours among the members of each group: pairs with a fresh end that are nearer than what the list of ``u`` ends with.

    Groups are cut at random into parts of about ``GROUP`` members, so a node around which very many lie is no burden on one task.
    """
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    parts = groups.join(sizes, "g").select("m", "fresh", F.concat_ws("/", "g", F.pmod(F.xxhash64(F.lit(seed), "m"), F.ceil(F.col("n") / GROUP)).cast("string")).alias("g"))
    held = nodes.select(F.col("node").alias("m"), "q", "s", "e", "radius", "k")
    held = held.withColumn("need", F.lit(None).cast("double")) if worst is None else held.join(worst, "m", "left")
    rows = parts.join(held, "m").select("g", "m", "fresh", "q", "s", "e", "radius", "k", F.coalesce("need", F.lit(10.0)).alias("need"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_pylist()
            fresh, m, s, e, radius, k, need = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fresh", "m", "s", "e", "radius", "k", "need"))
            q = batch.column("q").to_pylist()
            found, lo = [], 0
            while lo < len(g):
                hi = lo + 1
                while hi < len(g) and hi - lo < 2 * GROUP and g[hi] == g[lo]:
                    hi += 1
                at = slice(lo, hi)
                if hi - lo > 1 and fresh[at].any():
                    found.append(_best(m[at], fresh[at], np.frombuffer(b"".join(q[at]), dtype=np.int8).reshape(hi - lo, -1), s[at], e[at], radius[at], k[at], need[at]))
                lo = hi
            if found:
                u, v, gap, low, ks = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(gap), pa.array(low), pa.array(np.ones(len(u), dtype=bool)),
                                                  pa.array(ks.astype(np.int32))], schema=_CANDIDATE)

    return rows.repartition("g").sortWithinPartitions("g", "m").mapInArrow(run, _EDGE)


def _best(m, fresh, q, s, e, radius, k, need) -> tuple:
    x = q.astype(np.float32 if q.shape[1] <= 1024 else np.float64)      # sums of products of bytes stay exact
    near = (x @ x.T).astype(np.float64) * (s[:, None].astype(np.float64) * s[None, :])
    reach = radius[:, None] + radius[None, :]
    gap = np.arccos(np.clip(near, -1, 1)) - reach
    off = (m[:, None] == m[None, :]) | ~(fresh[:, None] | fresh[None, :]) | (gap >= need[:, None])
    gap[off] = np.inf
    most = min(int(k.max()), gap.shape[1])
    order = np.argpartition(gap, most - 1, axis=1)[:, :most] if most < gap.shape[1] else np.tile(np.arange(gap.shape[1]), (len(gap), 1))
    rows = np.repeat(np.arange(len(gap)), order.shape[1])
    cols = order.ravel()
    keep = np.isfinite(gap[rows, cols])
    rows, cols = rows[keep], cols[keep]
    slack = e[rows].astype(np.float64) + e[cols] + e[rows].astype(np.float64) * e[cols]
    low = np.arccos(np.clip(near[rows, cols] + slack, -1, 1)) - reach[rows, cols]
    return m[rows], m[cols], gap[rows, cols], low, k[rows]


def merged(graph: DataFrame | None, new: DataFrame, most: int) -> DataFrame:
    """The lists after new neighbours: the nearest ``k`` of each node.  What was there is no longer fresh."""
    both = new if graph is None else graph.withColumn("fresh", F.lit(False)).unionByName(new)
    order = Window.partitionBy("u").orderBy("gap", "v")
    once = (both.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= most)
            .groupBy("u", "v").agg(F.min("gap").alias("gap"), F.min("low").alias("low"), F.min("fresh").alias("fresh"), F.max("k").alias("k")))
    return staged(once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("k")).select("u", "v", "gap", "low", "fresh", "k"))


@dataclass
class Graph:
    """Nodes with their lists; ``most`` is the length of the longest list."""

    nodes: DataFrame
    edges: DataFrame
    most: int
    theta: float
    seed: int = 0

    def refined(self, rounds: int) -> Graph:
        """Rounds of neighbours-of-neighbours joins, until one finds no new link and hardly any neighbour."""
        edges = self.edges
        for k in range(rounds):
            around = (edges.select(F.col("u").cast("string").alias("g"), F.col("v").alias("m"), "fresh")
                      .unionByName(edges.select(F.col("v").cast("string").alias("g"), F.col("u").alias("m"), "fresh")))
            worst = edges.groupBy(F.col("u").alias("m")).agg(F.when(F.count(F.lit(1)) >= F.max("k"), F.max("gap")).alias("need"))
            edges = merged(edges, compared(around, self.nodes, worst, self.seed + k), self.most)
            fresh, links, total = edges.agg(F.count_if("fresh"), F.count_if(F.col("fresh") & (F.col("low") <= self.theta)), F.count(F.lit(1))).first()
            if not links and fresh <= total / 20:
                break
        return Graph(self.nodes, edges, self.most, self.theta, self.seed + rounds)

    def rooted(self) -> Graph:
        """New leaves of other random trees, compared and merged into the lists."""
        new = compared(dealt(self.nodes, self.seed), self.nodes, None, self.seed)
        return Graph(self.nodes, merged(self.edges, new, self.most), self.most, self.theta, self.seed + 1)

    def saturated(self) -> DataFrame:
        """``u`` of the nodes whose list is full of what may link."""
        full = self.edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("low").alias("far"), F.max("k").alias("k"))
        return full.where((F.col("n") >= F.col("k")) & (F.col("far") <= self.theta)).select("u")

    def enlarged(self, which: DataFrame) -> Graph:
        """Lists of these nodes may be twice as long; their members are compared anew."""
        marked = which.select("u", F.lit(True).alias("longer"))
        edges = self.edges.join(marked, "u", "left").select("u", "v", "gap", "low", F.coalesce("longer", F.lit(False)).alias("fresh"),
                                                            F.when(F.col("longer"), 2 * F.col("k")).otherwise(F.col("k")).alias("k"))
        nodes = self.nodes.join(marked.withColumnRenamed("u", "node"), "node", "left").withColumn(
            "k", F.when(F.col("longer"), 2 * F.col("k")).otherwise(F.col("k"))).drop("longer")
        return Graph(staged(nodes), staged(edges), 2 * self.most, self.theta, self.seed)

    def audited(self, seed: int) -> tuple[float, DataFrame]:
        """Share of the links of a random sample of nodes that their lists hold, and all their links as neighbours."""
        n = self.nodes.count()
        spark = self.nodes.sparkSession
        some = self.nodes.where(sampled(F.struct(F.lit(seed), F.col("node")), AUDIT, n)).collect()      # about AUDIT nodes
        by: dict[tuple, list] = {}
        for r in some:
            by.setdefault((r["label"], len(r["q"])), []).append(r)
        shared = spark.sparkContext.broadcast({key: (np.array([r["node"] for r in rows]), np.stack([np.frombuffer(r["q"], dtype=np.int8) for r in rows]).astype(np.float32),
                                                     *(np.array([r[c] for r in rows], dtype=np.float64) for c in ("s", "e", "radius")), np.array([r["k"] for r in rows]))
                                               for key, rows in by.items()})
        theta = self.theta

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels, ids, q, s, e, radius = (batch.column(c).to_pylist() for c in ("label", "node", "q", "s", "e", "radius"))
                rows = []
                for label, node, own, sc, er, ra in zip(labels, ids, q, s, e, radius):
                    key = (label, len(own))
                    if key in shared.value:
                        m, x, ss, ee, rr, ks = shared.value[key]
                        near = (x @ np.frombuffer(own, dtype=np.int8).astype(np.float32)) * (ss * sc)
                        low = np.arccos(np.clip(near + ee + er + ee * er, -1, 1)) - rr - ra
                        for j in np.flatnonzero((low <= theta) & (m != node)).tolist():
                            rows.append((int(m[j]), node, float(np.arccos(np.clip(near[j], -1, 1)) - rr[j] - ra), float(low[j]), True, int(ks[j])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CANDIDATE)], schema=_CANDIDATE)

        links = staged(self.nodes.mapInArrow(run, _EDGE))
        known = self.edges.select("u", "v").withColumn("known", F.lit(True))
        total, met = links.join(known, ["u", "v"], "left").agg(F.count(F.lit(1)), F.count("known")).first()
        return (met / total if total else 1.0), links

    def contracted(self, number: int, members: DataFrame, which: DataFrame) -> tuple[Graph, DataFrame] | None:
        """Saturated nodes in balls, with ``members`` (node, ball, off) extended; None where no ball forms."""
        single = self.nodes.where("radius = 0")
        may = which.join(single.select(F.col("node").alias("u")), "u")
        near = self.edges.where(F.col("low") <= self.theta).join(may, "u").join(may.select(F.col("u").alias("v")), "v").select(F.col("u").alias("a"), F.col("v").alias("b"))
        groups = components(near)
        at = staged(single.join(groups, "node").select("node", "label", "component", "v", "k"))
        mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("v")), 1 / F.sqrt(dot(F.col("v"), F.col("v")))))     # of unit vectors, but for its length
        centres = at.groupBy("component").agg(mean.alias("c"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= BALL) & F.exists("c", lambda x: x != 0)).select("component", "c")
        inside = (at.join(centres, "component").withColumn("off", angle(cosine(F.col("v"), F.col("c")))).where(F.col("off") <= self.theta / 2 - MARGIN)
                  .select("node", "label", "k", "c", "off", (-(F.col("component") * 8 + number + 1)).alias("ball")))
        inside = staged(inside)
        balls = (inside.groupBy("ball").agg(F.first("label").alias("label"), F.first("c").alias("v"), F.max("off").alias("radius"), F.count(F.lit(1)).alias("n"))
                 .where(F.col("n") >= BALL))
        balls = staged(balls.select(F.col("ball").alias("node"), "label", "v", (F.col("radius") + MARGIN).alias("radius"), F.lit(NEIGHBOURS).alias("k")))
        if balls.isEmpty():
            return None
        gone = staged(inside.join(balls.select(F.col("node").alias("ball")), "ball").select("node", "ball", "off"))
        left = self.nodes.join(gone.select("node"), "node", "left_anti")
        nodes = staged(left.unionByName(rounded(balls)))
        edges = self.edges
        for end in "uv":
            edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
        return Graph(nodes, staged(edges.select("u", "v", "gap", "low", "fresh", "k")), self.most, self.theta, self.seed), members.unionByName(gone)


def neighbour_graph(nodes: DataFrame, theta: float) -> tuple[Graph, DataFrame]:
    """A graph whose lists hold all links found between nodes and balls, and ``members`` (node, ball, off) of the balls."""
    spark = nodes.sparkSession
    empty = spark.createDataFrame([], _EDGE)
    graph = Graph(staged(rounded(nodes)), empty, NEIGHBOURS, theta).rooted().refined(ROUNDS)
    members = spark.createDataFrame([], "node long, ball long, off double")
    for number in range(CONTRACTIONS):
        which = staged(graph.saturated())
        if which.isEmpty():
            break
        smaller = graph.contracted(number, members, which)
        if smaller is None:
            break
        graph, members = smaller
        graph = graph.rooted().refined(ROUNDS)
    for seed in range(AUDITS):
        while not (which := staged(graph.saturated())).isEmpty():
            graph = graph.enlarged(which).refined(ROUNDS)
        recall, links = graph.audited(seed)
        graph = Graph(graph.nodes, merged(graph.edges, links, graph.most), graph.most, theta, graph.seed)
        if recall >= RECALL:
            break
        graph = graph.rooted().refined(ROUNDS)
    while not (which := staged(graph.saturated())).isEmpty():
        graph = graph.enlarged(which).refined(ROUNDS)
    return graph, members


def linked(graph: Graph, members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``p`` and ``q`` (nodes or balls): everything in the one links with everything in the other, by cosine in double precision."""
    theta = graph.theta
    ends = graph.nodes.select("node", "v", "radius")
    a, b = (ends.select(F.col("node").alias(x), F.col("v").alias(f"v_{x}"), F.col("radius").alias(f"r_{x}")) for x in "ab")
    pairs = (graph.edges.where(F.col("low") <= theta).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
             .join(a, "a").join(b, "b").withColumn("cos", cosine(F.col("v_a"), F.col("v_b"))))
    plain = pairs.where("r_a = 0 AND r_b = 0").where(F.col("cos") >= threshold).select(F.col("a").alias("p"), F.col("b").alias("q"))
    inside = members.join(sets.select("node", "v"), "node").select(F.col("ball"), F.col("node").alias("m"), F.col("v").alias("v_m"))

    def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (p, q, r, cos) whose q all links, and those to be looked into."""
        far = angle(F.col("cos"))
        return rows.where(far + F.col("r") <= theta - MARGIN), rows.where((far + F.col("r") > theta - MARGIN) & (far - F.col("r") <= theta + MARGIN))

    # The smaller number is a ball's wherever there is one.
    whole, open_ = settled(staged(pairs.where("r_a > 0 OR r_b > 0").selectExpr("a", "b", "v_a", "v_b", "r_a", "r_b", "r_a + r_b AS r", "cos")))
    opened = (open_.join(inside, inside["ball"] == open_["a"]).select(F.col("m").alias("a"), "b", F.col("v_m").alias("v_a"), "v_b", "r_b", F.col("r_b").alias("r"))
              .withColumn("cos", cosine(F.col("v_a"), F.col("v_b"))))
    opened = staged(opened)
    single = opened.where("r_b = 0").where(F.col("cos") >= threshold)
    half, doubtful = settled(opened.where("r_b > 0"))
    pair = (doubtful.join(inside, inside["ball"] == doubtful["b"]).select("a", F.col("m").alias("b"), "v_a", F.col("v_m").alias("v_b"))
            .where(cosine(F.col("v_a"), F.col("v_b")) >= threshold))
    found = [x.select(F.col("a").alias("p"), F.col("b").alias("q")) for x in (whole, single, half, pair)]
    return staged(functools.reduce(DataFrame.unionByName, [plain, *found]))


def dedup(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows link when their labels are equal and not null, their vectors are of one length, and their cosine in double precision reaches the
    threshold (which must be positive).  Null or zero vectors and those with null or non-finite components link with nothing, nor do rows without
    an id, whose component is null.  Equal vectors of a label are one node; repeated rows and ids count as rows of their own.
    ``component_id`` is the least id reachable by links.  Other columns are ignored.
    """
    theta = math.acos(threshold)
    v = vectors[quoted(vector_col)].cast("array<double>")
    label = F.concat_ws(":", F.size(v).cast("string"), vectors[quoted(label_col)].cast("string"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors[quoted(id_col)].isNotNull() & vectors[quoted(label_col)].isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    known = vectors.select(vectors[quoted(id_col)].cast("long").alias("vec_id"), label.alias("label"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    # Very large and very small vectors are scaled by a power of two, which leaves cosines as they are.
    largest = F.array_max(F.transform("v", F.abs))
    scaled = F.when(largest.between(1e-60, 1e60), F.col("v")).otherwise(F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(largest)))))
    key = [F.when(F.col("usable"), F.xxhash64(F.lit(side), "label", "v")).alias(f"h{side}") for side in (1, 2)]
    rows = staged(known.select("vec_id", F.when(F.col("usable"), F.col("label")).alias("label"), F.when(F.col("usable"), scaled).alias("v"), *key))
    sets = staged(rows.where("h1 IS NOT NULL").groupBy("h1", "h2", "label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
                  .withColumn("node", F.monotonically_increasing_id()))
    graph, members = neighbour_graph(sets.select("node", "label", "v", F.lit(0.0).alias("radius"), F.lit(NEIGHBOURS).alias("k")), theta)
    members = staged(members)
    links = linked(graph, members, sets, threshold)
    weight = members.join(sets.select("node", "times"), "node").groupBy("ball").agg(F.sum("times").alias("w"))
    weights = sets.select(F.col("node").alias("q"), F.col("times").alias("w")).unionByName(weight.select(F.col("ball").alias("q"), "w"))
    both = links.unionByName(links.select(F.col("q").alias("p"), F.col("p").alias("q")))
    gained = staged(both.join(weights, "q").groupBy("p").agg(F.sum("w").alias("gain")))
    joined = components(links.select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(members.select(F.col("node").alias("a"), F.col("ball").alias("b"))))
    placed = (sets.select("node", "h1", "h2", "least", "times").join(members.select("node", "ball"), "node", "left")
              .join(weight, "ball", "left")
              .join(gained.select(F.col("p").alias("node"), F.col("gain").alias("own")), "node", "left")
              .join(gained.select(F.col("p").alias("ball"), F.col("gain").alias("shared")), "ball", "left")
              .join(joined, "node", "left")
              .select("h1", "h2", "least", F.coalesce("component", "node").alias("component"),
                      (F.coalesce(F.col("w"), F.col("times")) - 1 + F.coalesce("own", F.lit(0)) + F.coalesce("shared", F.lit(0))).alias("n_links")))
    placed = staged(placed)
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(first, "component").select("h1", "h2", "n_links", "component_id")
    return (rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
