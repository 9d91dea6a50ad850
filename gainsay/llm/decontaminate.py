"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton holds every run of words of every item.  A document's words are streamed through it while the
length of the longest run that ends at each word is tracked.  A window occurs where that length reaches the
window size, or where a whole item that is shorter ends.  An automaton is built from a bounded number of words:
larger benchmarks are dealt to several, which the documents pass one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsay.llm.common import annotated, digest_of, id_text, in_arrow
from gainsay.shared import staged

WINDOW = 10
#: Item words per automaton, which every Python worker holds (about 60 MB).
SHARD_WORDS = 100_000
#: Share of hit words from which a document is dropped instead of cut.
MAX_COVERAGE = 0.5

#: The characters between words; all are ASCII, so UTF-8 bytes can be split as well.
_BETWEEN = "\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_WORD = re.compile(f"[^{_BETWEEN}]+")
_TO_WORDS = bytes(32 if re.match(f"[{_BETWEEN}]", chr(b)) else ord(chr(b).lower()) if b < 128 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words as UTF-8 bytes."""
    return text.encode().translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows and short items that states stand for."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        nexts: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        held = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, seq in held:
            last = 0
            for word in seq:
                last = self._extend(nexts, last, word)
        self.next = nexts
        self._mark(held)

    def _extend(self, nexts: list[dict[int, int]], last: int, word: int) -> int:
        link, length = self.link, self.length
        if word in nexts[last]:
            known = nexts[last][word]
            return known if length[known] == length[last] + 1 else self._split(nexts, last, word, known)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = new
            at = link[at]
        if at >= 0:
            known = nexts[at][word]
            link[new] = known if length[known] == length[at] + 1 else self._split(nexts, at, word, known)
        return new

    def _split(self, nexts: list[dict[int, int]], at: int, word: int, known: int) -> int:
        copy = len(nexts)
        nexts.append(dict(nexts[known]))
        self.link.append(self.link[known])
        self.length.append(self.length[at] + 1)
        while at >= 0 and nexts[at].get(word) == known:
            nexts[at][word] = copy
            at = self.link[at]
        self.link[known] = copy
        return copy

    def _mark(self, held: list[tuple[int | None, list[int]]]) -> None:
        """``items``: of states, the items that hold their last window.  ``short``: of states, the short items that end there."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, set]]] = {}
        top = list(range(len(self.link)))     # the state whose runs begin where the last window begins
        for state in order:
            if self.length[self.link[state]] >= self.window:
                top[state] = top[self.link[state]]
        own: dict[int, dict[int, set]] = {}
        for item, seq in held:
            state, n = 0, len(seq)
            for k, word in enumerate(seq):
                state = self.next[state][word]
                if k + 1 >= self.window:
                    self.items.setdefault(top[state], set()).add(item)
            if n < self.window:
                own.setdefault(state, {}).setdefault(n, set()).add(item)
        for state in order:
            ending = self.short.get(self.link[state], []) + sorted(own.get(state, {}).items())
            if ending:
                self.short[state] = ending
        self.top = top

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words (end exclusive), and the items whose windows occur."""
        nexts, link, length, short, window, get = self.next, self.link, self.length, self.short, self.window, self.vocabulary.get
        spans: list[tuple[int, int]] = []
        found: set = set()
        state = run = 0
        for i, word in enumerate(words):
            number = get(word)
            if number is None:
                state = run = 0
                continue
            after = nexts[state].get(number)
            while after is None and state:
                state = link[state]
                run = length[state]
                after = nexts[state].get(number)
            if after is None:
                run = 0
                continue
            state = after
            run += 1
            if run >= window:
                # The run may be shorter than the window's own state: go up to the state that holds the last window.
                found |= self.items.get(self.top[state], set())
                add(spans, i - run + 1, i + 1)
            if state in short:
                for size, items in short[state]:
                    if size <= run:
                        found |= items
                        add(spans, i - size + 1, i + 1)
        return spans, found


def add(spans: list[tuple[int, int]], lo: int, hi: int) -> None:
    """Append a span whose end is the largest so far, merging those it meets."""
    while spans and spans[-1][1] >= lo:
        lo = min(lo, spans.pop()[0])
    spans.append((lo, hi))


def shards(items: DataFrame, shard_words: int) -> list[DataFrame]:
    """The items' texts in groups of a bounded number of words (or one item), each group fit for one automaton.

    Groups are fetched one at a time; the number of groups doubles until every one is within the bound.
    """
    sized = items.withColumn("size", F.greatest(F.lit(1), F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))))
    n, total = 1, sized.agg(F.sum("size")).first()[0] or 0
    while n * shard_words < total:
        n *= 2
    while True:
        dealt = sized.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        over = dealt.groupBy("shard").agg(F.sum("size").alias("words"), F.countDistinct("text").alias("texts"))
        if not over.where((F.col("words") > 2 * shard_words) & (F.col("texts") > 1)).take(1):
            break
        n *= 2
    return [dealt.where(F.col("shard") == s).select("item_id", "text").distinct() for s in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (array of word spans) and ``hit_items`` (array of item ids).

    Null and empty texts have no words; null and empty items have no windows; an item without an id hits words but is
    not listed.  Repeated rows and items change nothing else.  Columns of ``docs`` with these names are replaced.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    span, item = "array<struct<start: int, end: int>>", "array<long>"
    out = docs
    groups = shards(items, shard_words)
    for k, group in enumerate(groups):
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton([(i, words_of(t)) for i, t in group.collect()], window))

        def hits(texts: list[str], automaton=automaton) -> list[list]:
            held = automaton.value
            n, spans, found = [], [], []
            for text in texts:
                words = words_of(text)
                where, which = held.hits(words)
                n.append(len(words))
                spans.append([{"start": lo, "end": hi} for lo, hi in where])
                found.append(sorted(i for i in which if i is not None))
            return [n, spans, found]

        if k == 0:
            out = annotated(out, text_col, hits, f"n_words long, hit_spans {span}, hit_items {item}")
            continue
        more = annotated(staged(out), text_col, hits, f"_n long, _spans {span}, _items {item}")
        out = (more.withColumn("hit_items", F.array_sort(F.array_union("hit_items", "_items")))
               .withColumn("hit_spans", merged(F.concat("hit_spans", "_spans"))).drop("_n", "_spans", "_items"))
    return out


def merged(spans: Column) -> Column:
    """Sorted spans without overlaps."""
    return F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<start: int, end: int>>"),
        lambda a, s: F.when(F.size(a) == 0, F.array(s)).when(
            F.element_at(a, -1)["end"] >= s["start"],
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(s))))


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def cleaned(hit: DataFrame, text_col: str = "text", max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents of :func:`contaminated` without their hit spans; those covered beyond ``max_coverage`` are dropped.

    A cut takes the characters from the first to the last word of a span; what stands around it stays.
    """
    kept = hit.where((n_hit() == 0) | (n_hit() < max_coverage * F.col("n_words")))
    free, cut = kept.where(F.size("hit_spans") == 0), kept.where(F.size("hit_spans") > 0)

    def remove(text: str, spans: list) -> str:
        at = [m.span() for m in _WORD.finditer(text)]
        out, done = [], 0
        for s in spans:
            out.append(text[done:at[s["start"]][0]])
            done = at[s["end"] - 1][1]
        return "".join([*out, text[done:]])

    schema = cut.schema
    where = cut.columns.index(text_col), cut.columns.index("hit_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [remove(t, s) for t, s in zip(batch.column(where[0]).to_pylist(), batch.column(where[1]).to_pylist())]
            columns = [pa.array(texts, type=pa.string()) if i == where[0] else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.set(where[0], pa.field(text_col, pa.string())))

    return free.unionByName(in_arrow(cut, run, schema))


def digests(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Counts and digests of the hits of every row."""
    hit = contaminated(id_text(docs, id_col, text_col), benchmark, window=window)
    return hit.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                      digest_of(F.col("hit_items")).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))
