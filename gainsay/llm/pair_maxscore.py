"""Ranked lexical search with MaxScore bounds over pairs of terms.

Documents are kept as rows of term numbers and frequencies, restricted to the terms that are asked for.  Blocks of documents
become an inverted index: postings of impacts per term with the largest impact, and for the pairs of terms that an
item asks for together the intersection of their postings with the largest joint impact.  A document that holds both terms of a
pair adds at most the joint maximum, one that holds a single one at most that term's; so a pair is bounded by the largest
of the three, which is mostly far less than the sum of both maxima.

An item is answered block by block.  Its pairs are put in order of their bounds; those whose bounds together stay below the score
that the item already has at its last rank need not be read to find candidates, and candidates are dropped as soon as what
is left cannot lift them to that score.  A first pass over a bounded sample of documents sets scores to begin with; every document
is then judged, and results are exact whatever the sample.

Documents are never moved: each task hands on its best per item, which one window ranks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gainsay.llm.common import id_text, quoted, sampled
from gainsay.shared import staged

#: Ranks returned, documents of the sample that sets the first scores, and distinct item terms of a pass over the documents.
RANKS, SAMPLE, TERMS = 20, 20_000, 200_000
#: Texts that a task tokenises before it hands rows on.
TEXTS = 512

_SPLIT = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_TABLE = bytes(_LOWER[_SPLIT[b]] for b in range(256))
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Asked:
    """The items of one pass: term numbers, and per item its weighted terms in pairs."""

    ids: list[int]
    number: dict[bytes, int]
    units: list[list[tuple[tuple[int, int], ...]]]      # per item: pairs, or one term, of (term, times)
    weights: np.ndarray | None = None

    @property
    def pairs(self) -> list[tuple]:
        return sorted({u for units in self.units for u in units if len(u) == 2})


def asked(rows: list[tuple[int, str]]) -> Asked:
    """Items with their terms numbered; ``units`` are formed once weights are known."""
    number: dict[bytes, int] = {}
    units = []
    for _, text in rows:
        counts = Counter(terms_of(text))
        units.append([((number.setdefault(t, len(number)), c),) for t, c in sorted(counts.items())])
    return Asked([i for i, _ in rows], number, units)


def paired(what: Asked, weights: np.ndarray) -> Asked:
    """Terms of an item in pairs of like weight; what documents can't score is left out."""
    units = []
    for single in what.units:
        order = sorted((u[0] for u in single if weights[u[0][0]] > 0), key=lambda tc: (weights[tc[0]] * tc[1], tc[0]))
        units.append([tuple(order[k:k + 2]) for k in range(0, len(order), 2)])
    return Asked(what.ids, what.number, units, weights)


def forward(docs: DataFrame, number: Broadcast) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), and numbers and frequencies of the asked terms, of documents with any term."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value.get
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                rows: list[tuple] = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = terms_of(text.as_py())
                    if words:
                        held = Counter(map(known, words))
                        held.pop(None, None)
                        rows.append((i, len(words), list(held), list(held.values())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Block:
    """Inverted index of some documents, with the lists of the pairs asked for."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, pairs: list[tuple]):
        order = np.lexsort((doc, term))
        self.ids, self.docs, self.impacts = ids, doc[order], impact[order]
        present, starts = np.unique(term[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        self.place = {t: (a, b) for t, a, b in zip(present.tolist(), starts.tolist(), ends.tolist())}
        best = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.empty(0, np.int64)
        self.best = dict(zip(present.tolist(), best.tolist()))
        self.joint = {p: self._joint(*p) for p in pairs if p[0][0] in self.place and p[1][0] in self.place}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.place.get(term, (0, 0))
        return self.docs[a:b], self.impacts[a:b]

    def _joint(self, one: tuple[int, int], two: tuple[int, int]) -> tuple[int, np.ndarray, np.ndarray]:
        """Largest joint impact of the documents that hold both terms, and those documents with their joint impacts."""
        (da, ia), (db, ib) = self.postings(one[0]), self.postings(two[0])
        both, at, bt = np.intersect1d(da, db, assume_unique=True, return_indices=True)
        sums = one[1] * ia[at] + two[1] * ib[bt]
        return int(sums.max()) if len(sums) else 0, both, sums

    def bound(self, unit: tuple) -> int:
        alone = max(c * self.best.get(t, 0) for t, c in unit)
        return max(alone, self.joint[unit][0]) if unit in self.joint else alone

    def add(self, unit: tuple, score: np.ndarray) -> None:
        """Adds what every document of the block gets from the unit."""
        for t, c in unit:
            docs, impacts = self.postings(t)
            score[docs] += c * impacts

    def gain(self, unit: tuple, some: np.ndarray) -> np.ndarray:
        """What some documents get from the unit: from the pair's list where both terms are held, else from one of them."""
        out = np.zeros(len(some), dtype=np.int64)
        for t, c in unit:
            docs, impacts = self.postings(t)
            if len(docs):
                at = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
                out += np.where(docs[at] == some, c * impacts[at], 0)
        if unit in self.joint and len(self.joint[unit][1]):
            _, docs, sums = self.joint[unit]
            at = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            out = np.where(docs[at] == some, sums[at], out)
        return out

    def best_of(self, units: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block (by position) with a score of at least ``least`` (1 or more), and their scores."""
        bounds = {u: self.bound(u) for u in units}
        order = sorted((u for u in units if bounds[u]), key=bounds.__getitem__)
        below = np.cumsum([0, *(bounds[u] for u in order)])
        needless = int(np.searchsorted(below, least, side="left")) - 1      # the first so many together stay below
        if needless >= len(order):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        score = np.zeros(len(self.ids), dtype=np.int64)
        for u in order[needless:]:
            self.add(u, score)
        some = np.flatnonzero((score > 0) & (score + below[needless] >= least))
        mine = score[some]
        for k in range(needless - 1, -1, -1):
            if not len(some):
                break
            mine = mine + self.gain(order[k], some)
            stay = mine + below[k] >= least
            some, mine = some[stay], mine[stay]
        return some, mine


def found(index: DataFrame, what: Broadcast, mean: tuple[int, int], least: Broadcast, ranks: int) -> DataFrame:
    """``item`` (its position), ``doc_id`` and ``score``: per task the best documents of every item that reach its least score."""
    docs_all, terms_all = mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, need = what.value, dict(least.value)
        pairs = asking.pairs
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            m = 75 + (25 * n * docs_all) // terms_all
            impact = asking.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            block = Block(ids, doc, term, impact, pairs)
            for item, units in enumerate(asking.units):
                some, score = block.best_of(units, need.get(item, 1))
                if len(some):
                    ids_, scores = (np.concatenate(x) for x in zip(top.get(item, (np.empty(0, np.int64),) * 2), (ids[some], score)))
                    first = np.lexsort((ids_, -scores))[:ranks]
                    top[item] = ids_[first], scores[first]
                    if len(first) == ranks:
                        need[item] = max(need.get(item, 1), int(scores[first[-1]]))
        for item, (ids_, scores) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids_), item, np.int32)), pa.array(ids_), pa.array(scores)], schema=_FOUND)

    return index.mapInArrow(run, "item int, doc_id long, score long")


def ranked(scores: DataFrame, ranks: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)


def search(docs: DataFrame, items: DataFrame, ranks: int = RANKS, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the best documents of each item, ties by the smaller id.

    Null and empty texts have no terms.  Documents without an id take no part, repeated ids are documents of their own.  Items
    without an id are not asked; of items with one id that of the least text is.  Items without known terms get no row.  Other columns
    are ignored.  Items go in passes of about ``TERMS`` terms, so what a pass broadcasts is bounded, save for the terms of one item.
    """
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    asking = (items.select(items[quoted(item_col)].alias("item_id"), items[quoted(item_text)].cast("string").alias("text"))
              .where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text")))
    kind = asking.schema["item_id"].dataType.simpleString()
    total = asking.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    passes = -(-total // TERMS)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for k in range(passes):
        rows = asking.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()      # about TERMS terms
        out = out.unionByName(_passed(texts, [(r["item_id"], r["text"]) for r in rows], kind, ranks, sample))
    return out


def _passed(texts: DataFrame, rows: list[tuple], kind: str, ranks: int, sample: int) -> DataFrame:
    spark = texts.sparkSession
    context = spark.sparkContext
    what = asked(rows)
    index = staged(forward(texts, context.broadcast(what.number)))
    docs_all, terms_all = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    names = spark.createDataFrame(list(enumerate(what.ids)), f"item int, item_id {kind}")
    if not docs_all or not what.number:
        return names.selectExpr("item_id", "1 AS rank", "0L AS doc_id", "0L AS score").where("false")
    df = np.zeros(len(what.number), dtype=np.int64)
    for term, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():     # the asked terms
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * docs_all + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
    weights[df == 0] = 0
    shared = context.broadcast(paired(what, weights))
    mean = (docs_all, terms_all)
    some = found(index.where(sampled(F.col("doc_id"), sample, docs_all)), shared, mean, context.broadcast({}), ranks)
    last = ranked(some, ranks).where(F.col("rank") == ranks).select("item", "score").collect()      # one number an item
    best = ranked(found(index, shared, mean, context.broadcast({r["item"]: r["score"] for r in last}), ranks), ranks)
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
