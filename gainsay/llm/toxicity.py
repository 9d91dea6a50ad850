"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, clause end, other; stems carry the weights of insults and threats.
Two transducers are composed into one: negation marks the insults and threats within its reach, reported speech marks what
follows a reporting verb.  Whether somebody is addressed is noted per clause.  Together they name the pattern of every
matched word: "insult", "negated insult to target", ....
A document's score combines the weights of its matched words: 1 minus the product of their complements.

Weights are learned.  Stems (words and their beginnings) come from labelled documents by covering: the stem that
marks most of the toxic documents not yet explained is taken first, so words that merely repeat with copies of a
toxic document add nothing.  The weight of a stem is its precision among the labelled documents, and so is that
of a pattern.  Fixed English words give the grammar its start where labels are few.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsay.llm.common import annotated, id_text, mapped, sampled
from gainsay.shared import staged

# Starting words of the symbols.
INSULTS = ("clown", "disgusting", "dumb", "garbage", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "morons", "pathetic",
           "scum", "stupid", "trash", "vermin", "worthless")
THREATS = ("destroy", "hurt", "kill", "murder", "shoot", "stab", "strangle")
TARGETS = ("du", "ellos", "euch", "he", "her", "him", "ihr", "she", "sie", "te", "their", "them", "they", "toi", "tu", "ustedes", "vous", "you", "your")
NEGATIONS = ("aren't", "isn't", "jamais", "kein", "keine", "never", "nicht", "not", "nunca", "pas", "without")
REPORTS = ("called", "claimed", "dijo", "quoted", "reported", "said", "sagte", "says", "wrote")

#: Labelled documents of each class that a model is fitted on, and the most stems it weighs.
SAMPLE, CANDIDATES = 10_000, 5_000
#: Lengths of word beginnings that may become stems.
BEGINNINGS = (4, 5, 6)
#: Documents a stem must explain, and the share of clean documents among those with it.
SUPPORT, IMPURITY = 3, 0.02
#: Words that a negation reaches.
REACH = 3
THRESHOLD = 0.3
#: Weight of a fixed word, and of patterns without labelled evidence, with the evidence each counts for.
PRIOR = {"insult": 0.7, "threat": 0.05, "threat to target": 0.6, "negated": 0.35, "reported": 0.35}
PRIOR_COUNT = 2.0

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;\n]")
_MARKS = {**{w: "Y" for w in TARGETS}, **{w: "N" for w in NEGATIONS}, **{w: "R" for w in REPORTS}, **{c: "." for c in ".!?;\n"}}


@dataclass(frozen=True)
class Transducer:
    """States from ``start``; ``arcs`` give (next state, output) by (state, input); other inputs loop unchanged."""

    start: object
    arcs: dict = field(hash=False)

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, symbols: Iterable[str]) -> Transducer:
        """Composition: the other one reads this one's output."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            at = todo.pop()
            for symbol in symbols:
                first, middle = self.step(at[0], symbol)
                second, out = other.step(at[1], middle)
                arcs[at, symbol] = (first, second), out
                if (first, second) not in seen:
                    seen.add((first, second))
                    todo.append((first, second))
        return Transducer(start, arcs)


SYMBOLS = ("I", "T", "Y", "N", "R", ".", "o")


def grammar() -> Transducer:
    """Negation, then reported speech, composed.  "-" before a symbol marks it negated, '"' reported."""
    inner = [s for s in SYMBOLS if s not in "N."]
    negation = {(k, "N"): (REACH, "N") for k in range(REACH + 1)} | {(k, "."): (0, ".") for k in range(REACH + 1)}
    negation |= {(k, s): (k - 1, ("-" + s) if s in "IT" else s) for k, s in product(range(1, REACH + 1), inner)}
    marked = [m + s for m, s in product(("", "-"), ("I", "T"))]
    report = {(0, "R"): (1, "R"), (1, "."): (0, ".")} | {(1, s): (1, '"' + s) for s in marked}
    return Transducer(0, negation).then(Transducer(0, report), SYMBOLS)


_GRAMMAR = grammar()
_NAMES = {"I": "insult", "T": "threat"}


@dataclass
class Model:
    """Stem weights (whole words, and beginnings by length), pattern weights and the score without a match."""

    words: dict[str, tuple[str, float]]
    starts: dict[str, tuple[str, float]]
    patterns: dict[str, float] = field(default_factory=dict)
    base: float = 0.01

    def symbol(self, word: str) -> tuple[str, float] | None:
        if known := self.words.get(word):
            return known
        return next((self.starts[word[:n]] for n in BEGINNINGS if len(word) > n and word[:n] in self.starts), None)

    def matches(self, text: str) -> list[tuple[str, float]]:
        """(pattern, stem weight) of every matched word in clauses of the text."""
        low = text.lower()
        words = _WORD.findall(low)
        known = {w: s for w in set(words) if (s := self.symbol(w))}
        if not known:
            return []
        out, state, clause, addressed = [], _GRAMMAR.start, [], False
        for word in [*words, "."]:
            symbol = known[word][0] if word in known else _MARKS.get(word, "o")
            state, mark = _GRAMMAR.step(state, symbol)
            if symbol == "Y":
                addressed = True
            elif symbol in "IT":
                clause.append((mark, known[word][1]))
            elif symbol == ".":
                out += [(named(m, addressed), w) for m, w in clause]
                clause, addressed = [], False
        return out

    def score(self, matches: list[tuple[str, float]]) -> float:
        rest = 1 - self.base
        for pattern, weight in matches:
            rest *= 1 - weight * self.patterns.get(pattern, prior_of(pattern))
        return 1 - rest


def named(mark: str, addressed: bool) -> str:
    return f"{'reported ' * ('"' in mark)}{'negated ' * ('-' in mark)}{_NAMES[mark[-1]]}{' to target' * addressed}"


def prior_of(pattern: str) -> float:
    plain = pattern.removeprefix("reported ").removeprefix("negated ")
    weight = PRIOR.get(plain, PRIOR["insult"])
    return weight * (PRIOR["negated"] if "negated" in pattern else 1) * (PRIOR["reported"] if "reported" in pattern else 1)


def stems_of(text: str) -> set[str]:
    """Words, and beginnings of longer words written with a trailing dash."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) > n}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """Texts and labels of about ``size`` training rows of each class (all, if fewer), chosen by a hash of the id, and for each
    class how many labelled rows a sampled one stands for."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    taken = rows.where(F.when(F.col("toxic") == 1, sampled(F.col("doc_id"), size, counts.get(1, 0))).otherwise(sampled(F.col("doc_id"), size, counts.get(0, 0))))
    held = {r["toxic"]: r["count"] for r in taken.groupBy("toxic").count().collect()}
    each = {c: counts[c] / held[c] if held.get(c) else 1.0 for c in (0, 1)}
    joined = id_text(docs).join(F.broadcast(taken), "doc_id")        # about 2 * size rows of two numbers
    return staged(joined.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.max("text").alias("text"))), each


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, candidates: int = CANDIDATES) -> Model:
    """A model from the training labels among ``labels`` (``doc_id``, ``toxic``).

    The sample bounds what reaches the driver: at most ``candidates`` stems, and for each sampled toxic document those
    among them that it holds.  Without labels the fixed words and their prior weights remain.
    Weights are those of all labelled documents: a sampled one counts for all that it stands for.
    """
    sample, each = sample_of(docs, labels, size)

    def stems(cols: dict[str, list]) -> Iterator[tuple]:
        for label, text in zip(cols["toxic"], cols["text"]):
            for stem in stems_of(text or ""):
                yield stem, label

    counted = (mapped(sample.select("toxic", "text"), stems, "stem string, toxic int").groupBy("stem")
               .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    rows = (counted.where((F.col("bad") >= SUPPORT) & (each[0] * F.col("good") <= IMPURITY * each[1] * F.col("bad")))
            .orderBy(F.desc("bad"), F.length("stem"), "stem").limit(candidates).collect())
    precision = {r["stem"]: (each[1] * r["bad"] + 0.5) / (each[1] * r["bad"] + each[0] * r["good"] + 1) for r in rows}
    names = frozenset(precision)

    def present(cols: dict[str, list]) -> Iterator[tuple]:
        for doc, text in zip(cols["doc_id"], cols["text"]):
            yield doc, sorted(names & stems_of(text or ""))

    held = mapped(sample.where("toxic = 1").select("doc_id", "text"), present, "doc_id long, stems array<string>").orderBy("doc_id").collect()
    chosen = cover([r["stems"] for r in held], {r["stem"]: (r["bad"], r["stem"]) for r in rows})
    model = Model({w: ("I", PRIOR["insult"]) for w in INSULTS} | {w: ("T", 1.0) for w in THREATS}, {})
    for stem in chosen:
        (model.starts if stem.endswith("-") else model.words)[stem.removesuffix("-")] = "I", precision[stem]
    weigh(model, sample, each)
    return model


def cover(docs: list[list[str]], order: dict[str, tuple]) -> list[str]:
    """Stems that explain the documents: most of the unexplained first, while they explain ``SUPPORT`` at least."""
    where: dict[str, set[int]] = {}
    for i, stems in enumerate(docs):
        for stem in stems:
            where.setdefault(stem, set()).add(i)
    left, chosen = set(range(len(docs))), []
    while where:
        best = max(where, key=lambda s: (len(where[s] & left), *order[s]))
        gain = where.pop(best) & left
        if len(gain) < SUPPORT:
            break
        chosen.append(best)
        left -= gain
        where = {s: w for s, w in where.items() if len(w & left) >= SUPPORT}
    return chosen


def weigh(model: Model, sample: DataFrame, each: dict[int, float]) -> None:
    """Pattern weights and the score without a match, from the sample, whose rows count ``each`` by class."""
    def patterns(cols: dict[str, list]) -> Iterator[tuple]:
        for label, text in zip(cols["toxic"], cols["text"]):
            for pattern in {p for p, _ in model.matches(text or "")} or {""}:
                yield pattern, label

    seen: dict[str, Counter] = {}
    for r in mapped(sample.select("toxic", "text"), patterns, "pattern string, toxic int").groupBy("pattern", "toxic").count().collect():
        seen.setdefault(r["pattern"], Counter())[r["toxic"]] = each[r["toxic"]] * r["count"]
    none = seen.pop("", Counter())
    model.base = (none[1] + 0.5) / (none[0] + none[1] + 50)
    model.patterns = {p: (c[1] + PRIOR_COUNT * prior_of(p)) / (c[0] + c[1] + PRIOR_COUNT) for p, c in seen.items()}


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1 and ``toxic_patterns``, the distinct patterns matched.

    Null and empty texts get the model's score without a match; repeated rows score alike.  Columns with
    these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # bounded by the number of candidate stems

    def run(texts: list[str]) -> list[list]:
        held = shared.value
        found = [held.matches(t) for t in texts]
        return [[held.score(m) for m in found], [sorted({p for p, _ in m}) for m in found]]

    return annotated(docs, text_col, run, "toxicity double, toxic_patterns array<string>")


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row, from a model of the labels outside the held-out quarter."""
    rated = scored(id_text(docs), fit(docs, labels))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "toxic_patterns")
