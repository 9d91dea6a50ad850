"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document; they overlap and err.  Expectation-maximisation finds the share
of good documents and how often each labeller votes which way on good and bad ones, from the counts of vote patterns over
the whole corpus.  The posterior of a document's pattern is its label.  A hashed linear scorer is trained on posterior labels and
judges every document by its tokens, so it also decides where labellers abstain.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.llm.common import MEMORIES, annotated, id_text, mapped, sampled

#: Rows that the scorer is trained on (about; chosen by a hash), its features, rounds, step and decay.
SAMPLE, FEATURES, ROUNDS, STEP, DECAY = 10_000, 1 << 16, 60, 0.5, 1e-4
#: Tokens, or classes of their characters, that a worker remembers; a full memory starts anew.
MEMORY = 300_000
#: Most rounds of expectation-maximisation.
ITERATIONS = 200

# Frequent words of the corpus languages.
FREQUENT = frozenset("the of and to in is that for a an on with as was it by die der und das den ist von mit zu ein sich auf für im nicht "
                     "le la les de des et un une est en que qui pour dans el los las y que se del por con para una su".split())
LABELLERS = ("letters", "capitals", "marks", "tables", "repeats", "frequent", "variety", "sentences")

_END = re.compile(r"[.!?](?=\s|\Z)")
_MARK = re.compile(r"[^\w\s.,;:!?'\"()-]{2,}|!!")
_HIGH, _ASCII_UPPER = bytes(range(128, 256)), bytes(range(65, 91))
_ASCII_LETTERS = _ASCII_UPPER + bytes(range(97, 123))
_BEYOND = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"(.)\1+")


def votes_of(text: str) -> str:
    """One of "+", "-" and "0" (abstain) per labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return "0" * len(LABELLERS)
    chars = max(1, sum(map(len, words)))
    raw = text.encode()
    high = len(text) - len(raw.translate(None, _HIGH))         # characters beyond ASCII count as letters
    letters = len(raw) - len(raw.translate(None, _ASCII_LETTERS)) + high
    upper = len(raw) - len(raw.translate(None, _ASCII_UPPER)) + (sum(map(str.isupper, _BEYOND.findall(text))) if high else 0)
    marks = len(_MARK.findall(text)) / n
    bars = text.count("|") / n
    repeats = sum(map(operator.eq, words, words[1:])) / n
    common = sum(map(FREQUENT.__contains__, text.lower().split())) / n
    pairs = len(set(zip(words, words[1:]))) / n
    ends = len(_END.findall(text)) / n
    return "".join((
        vote(letters / chars, 0.9, 0.8), vote(-upper / max(1, letters), -0.2, -0.5), vote(-marks, -0.02, -0.2), vote(-bars, -0.02, -0.15),
        vote(-repeats, -0.02, -0.2) if n >= 5 else "0", vote(common, 0.15, 0.03) if n >= 10 else "0",
        vote(pairs, 0.6, 0.4) if n >= 10 else "0", vote(-abs(ends - 0.08), -0.07, -0.3) if n >= 20 else "0"))


def vote(value: float, good: float, bad: float) -> str:
    return "+" if value >= good else "-" if value <= bad else "0"


def estimate(patterns: list[tuple[str, int]]) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good for every vote pattern, and P(vote | class) by labeller, class (bad, good) and vote (-, 0, +)."""
    votes = np.array([["-0+".index(v) for v in p] for p, _ in patterns])
    count = np.array([c for _, c in patterns], dtype=float)
    one_hot = np.eye(3)[votes] * (votes != 1)[..., None]        # an abstention says nothing
    # Labellers are taken to be better than chance, and a vote against to say more than one in favour: these start the labels.
    good = 1 / (1 + np.exp(-2.0 - 0.5 * (votes == 2).sum(axis=1) + 3.0 * (votes == 0).sum(axis=1)))
    for _ in range(ITERATIONS):
        weight = np.stack([count * (1 - good), count * good])
        table = (np.einsum("ci,ilv->lcv", weight, one_hot) + 0.1)
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (count.sum() + 2)
        logs = np.einsum("ilv,lcv->ic", one_hot, np.log(table)) + np.log(prior)
        before, good = good, 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if np.abs(before - good).max() < 1e-9:
            break
    return {p: float(g) for (p, _), g in zip(patterns, good)}, table


class Classes(dict):
    """What ``str.translate`` puts for characters: one letter for each class, others stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "X" if c.isupper() else "x" if c.isalpha() else "0" if c in "0123456789" else c
        return kind


class Shapes(dict):
    """Feature numbers of shapes, by the classes of a token's characters; a run of one counts as two."""

    def __missing__(self, classes: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        slot = xxhash.xxh3_64_intdigest("s" + _RUN.sub(r"\1\1", classes)) % FEATURES
        if len(classes) < 64:
            self[classes] = slot
        return slot


_CLASSES, _SHAPES = Classes(), Shapes()
MEMORIES.extend((_CLASSES, _SHAPES))


class Slots(dict):
    """Feature numbers of tokens: the word itself and its shape."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= MEMORY:
            self.clear()
        slots = slots_for(token)
        if len(token) < 64:
            self[token] = slots
        return slots


def slots_for(token: str) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest("w" + token.lower()) % FEATURES, _SHAPES[token.translate(_CLASSES)]


@lru_cache(maxsize=1)
def slots_of() -> Slots:
    held = Slots()
    MEMORIES.append(held)
    return held


def features_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values; values of a document add up to 1, a repeated neighbour counts as a token of its own."""
    words, slots = text.split(), slots_of()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    same = sum(map(operator.eq, words, words[1:]))
    found = np.array([slots[w] for w in words], dtype=np.int64).ravel()
    where, count = np.unique(found, return_counts=True)
    value = count / (2 * len(words))
    return np.append(where, slots["\0same"][0]), np.append(value, same / len(words))


class Weights(dict):
    """Sum of the weights of a token's features."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights.tolist(), bias
        self.same = self.weights[slots_for("\0same")[0]]

    def __missing__(self, token: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        word, shape = slots_for(token)
        value = self.weights[word] + self.weights[shape]
        if len(token) < 64:
            self[token] = value
        return value

    def score(self, text: str) -> float:
        """The scorer's judgement, without forming the features."""
        words = text.split()
        margin = self.bias
        if words:
            same = sum(map(operator.eq, words, words[1:])) * self.same
            margin += (sum(map(self.__getitem__, words)) / 2 + same) / len(words)
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, margin))))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], times: list[int] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels, by full gradients with per-feature steps; a row counts ``times`` over."""
    index = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int64)
    value = np.concatenate([r[1] for r in rows]) if rows else np.empty(0)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    label = np.array([r[2] for r in rows])
    share = np.array(times or [1] * len(rows), dtype=float)
    share /= max(1.0, share.sum())
    weights, bias, squares, bias_square = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-8), 1e-8
    for _ in range(ROUNDS if len(rows) else 0):
        margin = np.bincount(owner, value * weights[index], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - label) * share
        gradient = np.bincount(index, value * error[owner], minlength=FEATURES) + DECAY * weights / len(rows)
        squares += gradient ** 2
        weights -= STEP * gradient / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= STEP * error.sum() / np.sqrt(bias_square)
    return weights, bias


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``votes``, ``posterior``, ``score`` and ``keep`` of every row.

    ``posterior`` is the weak label (share of good given the votes), ``score`` the linear scorer's, both from 0 to 1.  Null
    and empty texts have no votes and get the prior and the bias.  Repeated rows score alike.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    voted = annotated(texts, "text", lambda batch: [[votes_of(t) for t in batch]], "votes string")
    patterns = voted.groupBy("votes").count().collect()       # at most 3 ** 8 rows
    posterior, _ = estimate([(r["votes"], r["count"]) for r in patterns]) if patterns else ({}, None)
    # Copies of a text are one training row that counts as often as they come, so the sample is bounded whatever repeats.
    some = (texts.select(F.coalesce("text", F.lit("")).alias("text")).where(sampled(F.col("text"), sample, sum(r["count"] for r in patterns)))
            .groupBy("text").agg(F.count(F.lit(1)).alias("times")))

    def vectors(cols: dict[str, list]) -> Iterator[tuple]:
        for text, times in zip(cols["text"], cols["times"]):
            where, value = features_of(text)
            yield votes_of(text), times, where.tolist(), value.tolist()

    held = sorted(mapped(some, vectors, "votes string, times long, where array<int>, value array<double>").collect())      # about ``sample`` rows
    rows = [(np.array(w, np.int64), np.array(v), posterior[p]) for p, _, w, v in held]
    model = spark.sparkContext.broadcast(train(rows, [r["times"] for r in held]))
    labels = spark.sparkContext.broadcast(posterior)

    known: list[Weights] = []

    def judge(batch: list[str]) -> list[list]:
        if not known:
            known.append(Weights(*model.value))
        votes = [votes_of(t) for t in batch]
        return [votes, [labels.value[v] for v in votes], [known[0].score(t) for t in batch]]

    rated = annotated(texts, "text", judge, "votes string, posterior double, score double")
    return rated.select("doc_id", "votes", "posterior", "score", (F.col("score") >= threshold).alias("keep"))
