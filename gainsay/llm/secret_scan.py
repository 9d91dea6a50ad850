"""Secret scans: fixed patterns, and a battery of randomness tests on code-like strings.

A code-like string is a long run of characters that encodings use.  Its encoding is inferred from its
characters.  Four tests ask whether it looks like uniform draws from that alphabet: chi-squared over the
symbols, chi-squared over the character classes, a runs test about the middle of the alphabet and the serial
correlation.  Their p-values are combined.  Words look random too when they are short, so the level a string
must reach is set per length class: the weakest at which the expected share of words among the strings found is at
most ``rate``, and no weaker than uniform strings need.  The null distribution is drawn from the letter statistics of
the whole corpus, so a class needs no words of its own length; plain words of that length add to it where they exist.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsay.llm.common import annotated, id_text

# The kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of [0-9a-f]+ that are long enough; a run starts where no such character stands before.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets by size; a string gets the first that holds it.
ENCODINGS = {"dec": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": LETTERS.upper() + "234567",
             "base36": LETTERS + DIGITS, "BASE36": LETTERS.upper() + DIGITS, "base64": LETTERS.upper() + LETTERS + DIGITS + "+/",
             "base64url": LETTERS.upper() + LETTERS + DIGITS + "-_"}
CODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Lower ends of the length classes, and levels per class (tenths of -log10 of the combined p-value).
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96, 128, 256)
LEVELS = 120
RATE = 0.05
#: Strings drawn per length class, the plain words of a class that they weigh as much as, and the weakest level of a limit:
#: about one uniform string in a thousand lies beyond it.
DRAWS, EVIDENCE, WEAKEST = 10_000, 100, 40
#: Shares of a to z in English, and the letters they count for beside those of the corpus.
ENGLISH = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
ENGLISH_COUNT = 50

# Marks of texts that may hold a match, found by plain search over their bytes.
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_HEX_MARK = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_CODED_MARK = bytes(120 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_-") else 32 for b in range(256))

#: Letters as 1 to 26 whatever their case, and cases as 1 (lower) and 2 (upper); 0 for all other bytes.
_LETTER = bytes((chr(b).lower().encode()[0] - 96) if b < 128 and chr(b).isalpha() else 0 for b in range(256))
_CASE = bytes((1 if chr(b).islower() else 2) if b < 128 and chr(b).isalpha() else 0 for b in range(256))

_CLASSES = (frozenset(LETTERS), frozenset(LETTERS.upper()), frozenset(DIGITS))
_SETS = {name: frozenset(chars) for name, chars in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    raw, found = text.encode(), []
    low = raw.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_MARK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding_of(text: str) -> str | None:
    chars = set(text)
    return next((name for name, alphabet in _SETS.items() if chars <= alphabet), None)


def levels(strings: list[str]) -> np.ndarray:
    """-log10 of the combined p-value of each string, in tenths and cut at ``LEVELS``; 0 is most random."""
    out = np.full(len(strings), LEVELS, dtype=np.int64)
    groups: dict[tuple[str, int], list[int]] = {}
    for i, s in enumerate(strings):
        if name := encoding_of(s):
            groups.setdefault((name, len(s)), []).append(i)
    for (name, n), where in groups.items():
        chars = np.frombuffer("".join(strings[i] for i in where).encode("ascii"), dtype=np.uint8).reshape(len(where), n)
        p = combined(battery(chars, ENCODINGS[name]))
        out[where] = np.minimum(LEVELS, np.floor(-10 * np.log10(np.maximum(p, 1e-300)))).astype(np.int64)
    return out


def battery(chars: np.ndarray, alphabet: str) -> list[np.ndarray]:
    """p-values of the tests for the rows of ``chars``, strings of one length over one alphabet."""
    k, n = chars.shape
    size = len(alphabet)
    index = np.zeros(128, dtype=np.int64)
    index[[ord(c) for c in alphabet]] = np.arange(size)
    symbols = index[chars]
    counts = np.bincount((symbols + size * np.arange(k)[:, None]).ravel(), minlength=k * size).reshape(k, size)
    chi = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    shares = [(np.array([c in group for c in alphabet])) for group in _CLASSES]
    shares = [s for s in [*shares, ~np.any(shares, axis=0)] if s.any()]
    expected = np.array([s.mean() * n for s in shares])
    seen = np.stack([counts[:, s].sum(axis=1) for s in shares], axis=1)
    tests = [chi_tail(chi, size - 1)]
    if len(shares) > 1:
        tests.append(chi_tail((((seen - expected) ** 2) / expected).sum(axis=1), len(shares) - 1))
    above = symbols >= size / 2
    high = above.sum(axis=1).astype(float)
    low = n - high
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1)
    mean = 2 * high * low / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
    tests.append(np.where((high == 0) | (low == 0), 2.0 ** (1 - n), normal_two_sided((runs - mean) / np.sqrt(var))))
    centred = symbols - symbols.mean(axis=1, keepdims=True)
    spread = np.maximum((centred ** 2).sum(axis=1), 1e-9)
    tests.append(normal_two_sided((centred[:, 1:] * centred[:, :-1]).sum(axis=1) / spread * math.sqrt(n)))
    return [np.clip(p, 1e-300, 1.0) for p in tests]


def combined(tests: list[np.ndarray]) -> np.ndarray:
    """Fisher's combination; the chi-squared tail has a closed form for its even degrees of freedom."""
    half = -sum(np.log(p) for p in tests)
    term = total = np.ones_like(half)
    for i in range(1, len(tests)):
        term = term * half / i
        total = total + term
    return np.clip(np.exp(-half) * total, 1e-300, 1.0)


def chi_tail(x: np.ndarray, df: int) -> np.ndarray:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    z = (np.cbrt(np.maximum(x, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * erfc(z / math.sqrt(2))


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return erfc(np.abs(z) / math.sqrt(2))


def erfc(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in x.ravel()]).reshape(x.shape)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Code-like strings that no fixed pattern overlaps."""
    if b"x" * 20 not in text.encode().translate(_CODED_MARK):
        return []
    return [m.span() for m in CODED.finditer(text) if not any(lo < m.end() and m.start() < hi for lo, _, hi in taken)]


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, side="right")) - 1


def letter_counts(text: str, without: list[tuple[int, int]]) -> np.ndarray:
    """Pairs of adjacent letters (27 x 27, 0 for no letter), then words in lower case, with a capital and in upper case.

    Code-like strings, given by their spans, tell nothing about words and are left out.
    """
    parts, done = [], 0
    for lo, hi in sorted(without):
        parts.append(text[done:max(lo, done)])
        done = max(hi, done)
    raw = f" {' '.join([*parts, text[done:]])}  ".encode()
    letters = np.frombuffer(raw.translate(_LETTER), dtype=np.uint8).astype(np.int64)
    case = np.frombuffer(raw.translate(_CASE), dtype=np.uint8)
    first = np.flatnonzero((case[:-2] == 0) & (case[1:-1] > 0) & (case[2:] > 0)) + 1
    shape = np.where(case[first] == 1, 0, case[first + 1])
    return np.concatenate([np.bincount(letters[:-1] * 27 + letters[1:], minlength=729), np.bincount(shape, minlength=3)])


def null_histogram(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts over all rows by cell: how many words and other code-like strings of each length class reach each
    level, then the :func:`letter_counts`."""
    size = 2 * len(LENGTHS) * (LEVELS + 1)

    def count(texts: list[str]) -> list[list]:
        strings, cells = [], np.zeros(size + 732, dtype=np.int64)
        for t in texts:
            taken = base_spans(t)
            spans = candidates(t, taken)
            strings += [t[lo:hi] for lo, hi in spans]
            cells[size:] += letter_counts(t, [(lo, hi) for lo, _, hi in taken] + [s for s in spans if not WORD.fullmatch(t, *s)])
        if strings:
            word = np.array([WORD.fullmatch(s) is not None for s in strings])
            where = np.array([length_class(len(s)) for s in strings])
            np.add.at(cells, (word * len(LENGTHS) + where) * (LEVELS + 1) + levels(strings), 1)
        full = np.flatnonzero(cells)
        return [[[{"cell": int(c), "n": int(cells[c])} for c in full]] + [[]] * (len(texts) - 1)]

    counted = annotated(docs.select(docs[text_col]), text_col, count, "cells array<struct<cell: int, n: long>>")
    return counted.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n"))


def drawn_shares(counts: np.ndarray) -> np.ndarray:
    """Per length class and level the share of drawn strings that reach it, from the :func:`letter_counts` of a corpus.

    A string follows the corpus from letter to letter and takes the case of its words.  It has the least length of its
    class, at which words look most random.
    """
    rng = np.random.default_rng(11)
    pairs = counts[:729].reshape(27, 27)[1:, 1:].astype(float)
    single = pairs.sum(axis=0) + ENGLISH_COUNT * np.array(ENGLISH) / sum(ENGLISH)
    single /= single.sum()
    steps = np.cumsum(pairs + ENGLISH_COUNT * single, axis=1)
    steps /= steps[:, -1:]
    steps[:, -1] = 1.0
    at = np.zeros((DRAWS, LENGTHS[-1]), dtype=np.int64)
    at[:, 0] = rng.choice(26, DRAWS, p=single)
    for i in range(1, LENGTHS[-1]):
        at[:, i] = (steps[at[:, i - 1]] <= rng.random((DRAWS, 1))).sum(axis=1)
    shapes = counts[729:] + np.array([1.0, 0.1, 0.01])
    shape = rng.choice(3, DRAWS, p=shapes / shapes.sum())
    chars = (at + ord("a") - 32 * ((shape == 2)[:, None] | ((shape == 1)[:, None] & (np.arange(LENGTHS[-1]) == 0)))).astype(np.uint8)
    words = [row.tobytes().decode("ascii") for row in chars]
    found = [np.bincount(levels([w[:n] for w in words]), minlength=LEVELS + 1) for n in LENGTHS]
    return (np.cumsum(found, axis=1) + 1) / (DRAWS + 1)


def thresholds(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> list[int]:
    """Per length class the weakest level that holds the false-discovery rate; -1 where none does."""
    size = 2 * len(LENGTHS) * (LEVELS + 1)
    cells = np.zeros(size + 732)
    for cell, n in null_histogram(docs, text_col).collect():     # at most 2 * 10 * 121 + 732 rows
        cells[cell] = n
    tested, words = np.cumsum(cells[:size].reshape(2, len(LENGTHS), LEVELS + 1), axis=2)
    share = (words + EVIDENCE * drawn_shares(cells[size:])) / (words[:, -1:] + EVIDENCE)
    expected = tested[:, -1:] * share
    last = WEAKEST + 1
    return [max([-1, *np.flatnonzero((t[:last] > 0) & (e[:last] <= rate * t[:last])).tolist()]) for t, e in zip(tested, expected)]


def scan(docs: DataFrame, text_col: str = "text", rate: float = RATE, limits: list[int] | None = None) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end) by start and kind, in code points.

    Null and empty texts have no secrets; repeated rows are scanned alike; a column named ``secrets`` is replaced.
    ``limits`` (from :func:`thresholds`) saves the pass over ``docs`` that sets the levels.
    """
    limits = thresholds(docs, text_col, rate) if limits is None else limits

    def spans(texts: list[str]) -> list[list]:
        found = [base_spans(t) for t in texts]
        held = [(i, lo, hi) for i, t in enumerate(texts) for lo, hi in candidates(t, found[i]) if not WORD.fullmatch(t, lo, hi)]
        for (i, lo, hi), level in zip(held, levels([texts[i][lo:hi] for i, lo, hi in held])):
            if level <= limits[length_class(hi - lo)]:
                found[i].append((lo, 3, hi))
        return [[[{"kind": KINDS[k], "start": lo, "end": hi} for lo, k, hi in sorted(f)] for f in found]]

    return annotated(docs, text_col, spans, "secrets array<struct<kind: string, start: int, end: int>>")


def redacted(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """``scanned`` with every span replaced by its kind in brackets; of overlapping spans the first names the place."""
    step = """aggregate(secrets, named_struct('done', 0, 'out', ''), (a, s) ->
        CASE WHEN s.end <= a.done THEN a
             WHEN s.start < a.done THEN named_struct('done', s.end, 'out', a.out)
             ELSE named_struct('done', s.end, 'out', concat(a.out, substring({t}, a.done + 1, s.start - a.done), '[', s.kind, ']')) END,
        a -> concat(a.out, substring({t}, a.done + 1)))""".format(t=f"`{text_col}`")
    return scanned.withColumn(text_col, F.when(F.size("secrets") > 0, F.expr(step)).otherwise(F.col(text_col)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of every row."""
    scanned = scan(id_text(docs, id_col, text_col))
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
