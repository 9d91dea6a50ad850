"""N-gram Jaccard join over count vectors in packed R-trees.

Every set of shingles is a point: its shingles are hashed into groups and the group counts are the coordinates.
The sum of coordinate minima of two points is at least their overlap, so a pair whose sum stays below the overlap
that the similarity asks for cannot link; the same holds of two tree nodes, with the largest counts below each.

Points of equal size lie close together whatever their texts, so one tree over all documents would
compare each with all others of its size.  Points are therefore first dealt out by the rarest of their shingles: of
two sets that link, the rarest fifth of each has a shingle in common.  Rarity is a count over the whole corpus in
hashed groups.  The points that share a shingle form a tree.  They are compared in two rounds:

1. every point with the centre of each of its trees; links found so far make components;
2. in trees that still hold several components, the points of each component are packed into leaves, leaf
   pairs of different components are joined by the bound of their boxes, point pairs by their minima.

Copies of one set are one point.  Pairs that survive are verified on their shingles.  So no tree of near copies is
expanded into all pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsay.llm.common import MEMORIES, annotated, forget, id_text, in_arrow, mapped, quoted, slices
from gainsay.llm.components import components
from gainsay.shared import staged

WORDS, SIMILARITY = 5, 0.8
#: Coordinates of a point, and bits of the groups in which the rarity of shingles is counted.
GROUPS, RARITY_BITS = 256, 22
#: Points of a leaf, and points that are verified against one other within a task.
LEAF, SPREAD = 16, 2_000
#: Points of a tree that are packed into leaves together.
DEALT = 4_096
#: Bits of the filter that keeps texts of candidates before they are shuffled; it only saves work.
FILTER_BITS, SLOT_BITS = 1 << 25, 1 << 14
MEMORY = 100_000
#: Rarity groups in a row of counts, which are compressed: most groups are empty or small within a task.
_SLOT = 1 << 16

_TO_GROUP = np.uint64(64 - (GROUPS - 1).bit_length())
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Hashes(dict):
    """64-bit hashes of words; a full memory starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value


_HASHES = Hashes()
MEMORIES.append(_HASHES)


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = text.encode().lower().split()      # of bytes, only A-Z are lowered and ASCII white space splits
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for j in range(1, size):
        out *= _FACTOR
        out += h[j:n + j]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(values: np.ndarray) -> int:
    """One number per set, from a cryptographic digest of its shingles."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(values: np.ndarray, rarity: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles, as many as make it certain that a linked set has one of them among its own rarest."""
    keep = len(values) - int(np.ceil(similarity * len(values) - 1e-9)) + 1
    group = (values >> np.uint64(64 - RARITY_BITS)).astype(np.int64)
    order = np.lexsort((values, rarity[group]))
    return values[order[:keep]]


def points(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n``, ``node`` and ``vec`` of every row, and rows without a node that count shingles by rarity group."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("vec", pa.list_(pa.int32())), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, dtype=np.int32)
        for batch in batches:
            for part in slices(batch):
                n, node, vec = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text or "", size)
                    n.append(len(s))
                    node.append(node_of(s) if len(s) else None)
                    vec.append(np.bincount((s >> _TO_GROUP).astype(np.int64), minlength=GROUPS).astype(np.int32))
                    np.add.at(counts, (s >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
                k = len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                                                  pa.array(vec, pa.list_(pa.int32())), pa.nulls(k, pa.binary())], schema=schema)
        forget()
        for lo in range(0, len(counts), _SLOT):
            if counts[lo:lo + _SLOT].any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1 - lo], pa.int64()), pa.nulls(1, pa.int64()),
                                                  pa.nulls(1, pa.list_(pa.int32())), pa.array([zlib.compress(counts[lo:lo + _SLOT].tobytes(), 1)], pa.binary())], schema=schema)

    return in_arrow(docs, run, "doc_id long, n long, node long, vec array<int>, counts binary")


def rarity_of(marked: DataFrame) -> np.ndarray:
    """Shingles per rarity group over all documents: a vector of fixed length."""
    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(_SLOT, 1 << RARITY_BITS), dtype=np.int32)
        for c in part["counts"]:
            total = np.minimum(total.astype(np.int64) + np.frombuffer(zlib.decompress(c), dtype=np.int32), 2**31 - 1).astype(np.int32)
        return pd.DataFrame({"slot": [part["n"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    slots = marked.where("counts IS NOT NULL").select("n", "counts")
    spread = slots.groupBy("n", F.spark_partition_id().alias("p")).applyInPandas(
        lambda part: add(part).rename(columns={"slot": "n"}), "n long, counts binary")
    out = np.zeros(1 << RARITY_BITS, dtype=np.int32)
    for slot, counts in spread.groupBy("n").applyInPandas(add, "slot long, counts binary").collect():
        out[-1 - slot:_SLOT - 1 - slot] = np.frombuffer(zlib.decompress(counts), dtype=np.int32)
    return out


def bound(a: Column, b: Column) -> Column:
    """Sum of coordinate minima."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)


def may_link(n_a: Column, n_b: Column, overlap: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity with at most this overlap."""
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * overlap >= percent * (n_a + n_b))


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``: nodes, ``doc_a``, ``doc_b``: documents that hold them) that link, by their shingles.

    Texts of candidates are fetched by node.  The texts of all ``b`` of one ``a`` pass by its own, which is kept;
    an ``a`` with very many ``b`` is dealt to several groups.
    """
    marks = filter_bits(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")))

    def nodes(cols: dict[str, list]) -> Iterator[tuple]:
        for h, text in zip(cols["h"], cols["text"]):
            if h is None or marked(marks.value, np.int64(h % FILTER_BITS)):
                yield node_of(shingles(text or "", size)), text

    hashed = docs.select(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("h"), "text")
    texts = mapped(hashed, nodes, "node long, text string").dropDuplicates(["node"])
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).alias("parts"))
    dealt = pairs.select("a", "b").join(groups, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    owners = groups.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"),
                           F.col("a").alias("node"))
    rows = owners.unionByName(dealt.select("a", "part", "b", F.col("b").alias("node"))).join(texts, "node")
    ordered = rows.select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    return in_arrow(ordered, lambda batches: linked(batches, size, percent), "a long, b long")


def linked(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The links (``a``, ``b``) among rows ``a``, ``part``, ``b``, ``text``, where the text of ``a`` comes first, without ``b``."""
    owner, own = None, np.empty(0, dtype=np.uint64)
    for batch in batches:
        for rows in slices(batch):
            links = []
            for a, part, b, text in zip(*(rows.column(i).to_pylist() for i in range(4))):
                values = shingles(text or "", size)
                if b is None:
                    owner, own = (a, part), values
                elif owner == (a, part):
                    both = len(np.intersect1d(own, values, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(values) - both):
                        links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
    forget()


def filter_bits(ids: DataFrame) -> Broadcast:
    """A bit vector of fixed size, filled by Spark, in which these ids and few others are marked."""
    def fill(cols: dict[str, list]) -> Iterator[tuple]:
        for b in set((np.array(cols["h"], dtype=np.int64) % FILTER_BITS).tolist()):
            yield (b,)

    slots = (mapped(ids.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("h")), fill, "bit long").distinct()
             .groupBy(F.shiftright("bit", 14).alias("slot")).agg(F.collect_set(F.pmod("bit", F.lit(1 << 14)).cast("int")).alias("bits")))

    def pack(cols: dict[str, list]) -> Iterator[tuple]:
        for slot, bits in zip(cols["slot"], cols["bits"]):
            flags = np.zeros(1 << 14, dtype=bool)
            flags[bits] = True
            yield slot, np.packbits(flags).tobytes()

    packed = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for slot, part in mapped(slots, pack, "slot long, part binary").toLocalIterator():      # 2 KB a row, FILTER_BITS in all
        packed[slot << 11:(slot + 1) << 11] = np.frombuffer(part, dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(packed)


def marked(packed: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (packed[bit >> 3] >> (7 - (bit & 7))) & 1 == 1


def maybe_among(rows: DataFrame, row_id: Column, ids: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``, which holds where the id is one of ``ids`` or null, and of few others.

    The ids are bits of a vector of fixed size, in slots of words; it is filled by Spark and broadcast (``FILTER_BITS`` in all).
    """
    def fill(cols: dict[str, list]) -> Iterator[tuple]:
        for b in set((np.array(cols["h"], dtype=np.int64) % FILTER_BITS).tolist()):
            yield (b,)

    def pack(cols: dict[str, list]) -> Iterator[tuple]:
        for slot, bits in zip(cols["slot"], cols["bits"]):
            flags = np.zeros(SLOT_BITS, dtype=bool)
            flags[bits] = True
            yield slot, np.packbits(flags, bitorder="little").view("<i8")

    bits = mapped(ids.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("h")), fill, "bit long").distinct()
    slots = bits.groupBy(F.floor(F.col("bit") / SLOT_BITS).alias("slot")).agg(F.collect_set(F.pmod("bit", F.lit(SLOT_BITS)).cast("int")).alias("bits"))
    words = F.broadcast(staged(mapped(slots, pack, "slot long, words array<long>")).withColumnRenamed("slot", "__slot"))
    placed = rows.withColumn("__bit", F.when(row_id.isNotNull(), F.pmod(F.xxhash64(row_id), F.lit(FILTER_BITS))))
    met = placed.join(words, F.floor(F.col("__bit") / SLOT_BITS) == F.col("__slot"), "left")
    word = F.get("words", (F.pmod("__bit", F.lit(SLOT_BITS)) / 64).cast("int"))
    hit = F.expr("(shiftright(__word, CAST(pmod(__bit, 64) AS INT)) & 1) = 1")
    return met.withColumn("__word", word).withColumn("maybe", F.col("__bit").isNull() | F.coalesce(hit, F.lit(False))).drop("__bit", "__slot", "words", "__word")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the least id reachable by links) of every row.

    Null texts and texts without words have an empty set: they link with nothing and are their own component.
    Rows with equal sets are in one component.  Repeated ids give a row each.  Other columns are ignored.
    """
    return _grouped(docs, id_col, text_col, size, similarity).select("doc_id", "n_shingles", "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                      similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row, of the least id, of each component; rows without words all stay.

    Rows that a filter on the ids of the others lets pass certainly stay and are not moved.
    """
    rows = staged(_grouped(docs, id_col, text_col, size, similarity).where("node IS NOT NULL"))
    judged = rows.groupBy("component", "node", "doc_id").agg(F.count("*").alias("times"))
    least = judged.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("least")).select(
        "component", F.col("least.node").alias("least_node"), F.col("least.doc_id").alias("least_id"))
    judged = judged.join(least, "component").withColumn(
        "stays", (F.col("node") == F.col("least_node")) & F.col("doc_id").eqNullSafe(F.col("least_id")))
    doubtful = staged(judged.where("NOT stays OR times > 1").select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"), "stays"))
    # The columns of ``docs`` pass under numbers, so that none meets a name used here.
    numbers = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    known = docs.select(*[docs[quoted(c)].alias(n) for c, n in numbers.items()], docs[quoted(id_col)].cast("long").alias("__id"))
    known = maybe_among(known, F.col("__id"), doubtful.select(F.col("__id").alias("doc_id")))
    suspect = annotated(known.where("maybe"), numbers[text_col], lambda texts: [[
        node_of(v) if len(v) else None for v in (shingles(t, size) for t in texts)]], "__node long")
    told = suspect.join(doubtful, (suspect["__node"] == doubtful["__node"]) & suspect["__id"].eqNullSafe(doubtful["__id"]), "left").drop(
        doubtful["__node"], doubtful["__id"])
    one = told.where("stays").dropDuplicates(["__node", "__id"])      # only rows that came several times
    shown = [F.col(n).alias(c) for c, n in numbers.items()]
    return known.where("NOT maybe").select(shown).unionByName(told.where("stays IS NULL").select(shown)).unionByName(one.select(shown))


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """The columns of :func:`join`, and ``node`` and ``component`` in nodes."""
    percent = round(100 * similarity)
    texts = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    marked = staged(points(texts, size))
    rarity = spark.sparkContext.broadcast(rarity_of(marked))
    rows = marked.where("counts IS NULL").select("doc_id", "n", "node", "vec")
    sets = staged(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("vec").alias("vec")))

    def keys(cols: dict[str, list]) -> Iterator[tuple]:
        for text in cols["text"]:
            s = shingles(text or "", size)
            if len(s):
                yield node_of(s), len(s), prefix(s, rarity.value, similarity).view(np.int64)

    rarest = (mapped(texts.select("text"), keys, "node long, n int, keys array<long>").groupBy("node")
              .agg(F.first("n").alias("n"), F.first("keys").alias("keys")))
    # Counts are aggregates joined back, so that no shingle of very many points passes through one task.
    dealt = staged(rarest.select("node", "n", F.explode("keys").alias("key")))
    shared = dealt.groupBy("key").agg(F.count("*").alias("points")).where("points > 1")
    trees = staged(dealt.join(shared, "key").select("key", "node", "n", "points"))
    # The point that shares its shingles most often is the centre of a tree: near copies mostly link with it.
    met = trees.groupBy("node").agg(F.sum("points").alias("met"))
    weighed = trees.join(met, "node")
    centres = weighed.groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"))
    near_size = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    side = {s: sets.select(F.col("node").alias(s), F.col("doc").alias(f"doc_{s}"), F.col("n").alias(f"n_{s}"), F.col("vec").alias(f"vec_{s}")) for s in "ab"}

    def candidates(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side["a"], "a").join(side["b"], "b")
        return staged(both.where(may_link(F.col("n_a"), F.col("n_b"), bound(F.col("vec_a"), F.col("vec_b")), percent)).select("a", "b", "doc_a", "doc_b"))

    stars = candidates(trees.join(centres, "key").where((F.col("node") != F.col("centre")) & near_size)
                       .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    links = staged(verified(stars, texts, size, percent))
    first = staged(components(links))
    rest = candidates(between_components(trees.join(centres, "key").where("node <> centre"), first, sets, percent))
    more = verified(rest, texts, size, percent)
    own = first.select("node", "component")
    merged = components(staged(labelled(more, own)))
    final = (own.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
             .select("node", F.coalesce("top", "component").alias("component"))
             .unionByName(merged.join(own, "node", "left_anti")))
    least = sets.join(final, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    smallest = least.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = least.join(smallest, "component").select("node", "component", "component_id")
    return (rows.select("doc_id", "n", "node").join(named, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    "node", "component"))


def labelled(links: DataFrame, own: DataFrame) -> DataFrame:
    """Links between nodes as links between their components."""
    for end in "ab":
        links = links.join(own.select(F.col("node").alias(end), F.col("component").alias("of")), end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    return links.select("a", "b")


def between_components(trees: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of points of one tree and different components whose leaves' boxes allow a link.

    The centre of a tree has met all its points before and is left out.  A component with several points in a tree has leaves of its own,
    whose points need not meet; points that are alone there are packed together, and meet within their leaf too.
    """
    at = trees.join(known, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    held = at.groupBy("key", "component").agg(F.count("*").alias("m"))
    owners = held.select("key", "component", F.when(F.col("m") > 1, F.col("component")).alias("bin"), "m")
    # Trees with several components; very full bins are dealt to several, each packed by itself.
    mixed = held.groupBy("key").agg(F.count("*").alias("components")).where("components > 1").select("key")
    bins = owners.groupBy("key", "bin").agg(F.ceil(F.sum("m") / DEALT).alias("parts"))
    binned = at.join(owners.join(mixed, "key"), ["key", "component"]).select("key", "node", "n", "bin")
    # Under names of their own: "key" of both sides is one column by descent, and dropping one side's dropped the other's.
    shares = bins.select(F.col("key").alias("tree"), F.col("bin").alias("of"), "parts").where("parts > 1")
    dealt = (binned.join(shares, (F.col("key") == F.col("tree")) & F.col("bin").eqNullSafe(F.col("of")), "left")
             .select("key", "node", "n", "bin", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).alias("part")))
    placed = dealt.join(sets.select("node", "vec"), "node")
    packing = Window.partitionBy("key", "bin", "part").orderBy("n", "vec", "node")
    leaves = placed.withColumn("leaf", F.floor((F.row_number().over(packing) - 1) / LEAF))
    largest = F.aggregate(F.slice("points", 2, LEAF), F.col("points")[0]["vec"], lambda x, p: F.zip_with(x, p["vec"], lambda u, v: F.greatest(u, v)))
    box = staged(leaves.groupBy("key", "bin", "part", "leaf")                                # at most LEAF points each
                 .agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.collect_list(F.struct("node", "n", "vec")).alias("points"))
                 .select("key", "bin", "lo", "hi", largest.alias("box"), "points").withColumn("id", F.monotonically_increasing_id()))
    a, b = (box.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "bin", "lo", "hi", "box", "points")]) for s in "ab")
    sizes_meet = (100 * F.col("hi_a") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo_a"))
    apart = F.coalesce(F.col("bin_a") != F.col("bin_b"), F.lit(True)) & (F.col("id_a") < F.col("id_b"))
    near = a.join(b, "key").where((apart | ((F.col("id_a") == F.col("id_b")) & F.col("bin_a").isNull() & (F.size("points_a") > 1))) & sizes_meet & (
        (100 + percent) * bound(F.col("box_a"), F.col("box_b")) >= percent * (F.col("lo_a") + F.col("lo_b"))))
    # The points of two leaves are compared where the leaves meet: only pairs that may link become rows.
    met = F.flatten(F.transform("points_a", lambda p: F.transform(
        F.filter("points_b", lambda q: ((F.col("id_a") != F.col("id_b")) | (p["node"] < q["node"])) & may_link(p["n"], q["n"], bound(p["vec"], q["vec"]), percent)),
        lambda q: F.struct(F.least(p["node"], q["node"]).alias("a"), F.greatest(p["node"], q["node"]).alias("b")))))
    return near.select(F.explode(met).alias("pair")).select("pair.a", "pair.b").distinct()
