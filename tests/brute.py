"""Plain-Python recomputation for small fixtures."""

from __future__ import annotations

import math
import operator

OPS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<=": operator.le, "<": operator.lt, ">=": operator.ge}


def encode(value, cls):
    if value is None:
        return {"INTEGER": 0, "REAL": math.nan, "STRING": ""}[cls]
    return value


def digamma(n):
    return math.log(n) if n >= 1000 else -0.5772156649015329 + sum(1 / k for k in range(1, n))


def trigamma(n):
    return 1 / n if n >= 500 else math.pi ** 2 / 6 - sum(1 / k ** 2 for k in range(1, n))


def stats(a, b):
    return digamma(a) - digamma(a + b), trigamma(a) - trigamma(a + b), a / (a + b)


def distance(lower, upper):
    (lm, ls, _), (um, us, mean) = stats(*lower), stats(*upper)
    d = (lm - um) / math.sqrt(ls * ls + us * us)
    return d * math.exp(-0.2 / (1 - mean)) if mean > 0.8 else d


def search(rows, preds, batches, min_grad):
    """``rows``: encoded tuples; ``preds``: (col, op); ``batches``: lists of (x, y).

    Depth-first, one set after the other; returns {frozenset of predicate numbers: score}.
    """
    flat = [all(r[c] == rows[0][c] for r in rows) for c in range(len(rows[0]))]
    true = lambda p, x, y: OPS[preds[p][1]](rows[x][preds[p][0]], rows[y][preds[p][0]])
    node, kept = {}, {}
    for p, (c, op) in enumerate(preds):
        a, b, used = 1, 1, []
        if flat[c] and op in ("!=", ">", "<"):
            node[p], kept[p] = (1, 1 + 10 ** 9), []
            continue
        for batch in batches:
            hits = sum(true(p, x, y) for x, y in batch)
            a, b = a + hits, b + len(batch) - hits
            used += batch
            if b / (a * (a + b) ** 2) <= min_grad:
                break
        node[p], kept[p] = (a, b), used
    order = sorted(node, key=lambda p: (-(round(stats(*node[p])[0], 9)) if node[p][1] < 10 ** 9 else math.inf, p))
    rank = {p: k for k, p in enumerate(order)}
    a_of = {frozenset([p]): node[p][0] for p in node}
    edge = {(frozenset(), p): node[p] for p in node}
    sound = {(frozenset(), p): True for p in node}
    found = {}

    def grow(s, pairs, last):
        for p in order[:last]:
            if any(preds[q][0] == preds[p][0] for q in s) or a_of[s] == 1:
                continue
            if any(not sound.get((s - {c}, p), False) or a_of[(s - {c}) | {p}] == 1 for c in s):
                continue
            left = [(x, y) for x, y in pairs if true(p, x, y)]
            to = s | {p}
            a_of[to] = 1 + len(left)
            edge[s, p] = (a_of[to], 1 + a_of[s] - a_of[to])
            score = min(distance(edge[s - {c}, p], edge[s, p]) for c in s)
            sound[s, p] = score >= 2.0
            if sound[s, p] and a_of[to] == 1:
                found[to] = score
            grow(to, left, rank[p])

    for k, p in enumerate(order):
        s = frozenset([p])
        grow(s, [(x, y) for x, y in kept[p] if true(p, x, y)], k)
    return found


def violating(rows, dc):
    """Ordered pairs of distinct row numbers that satisfy every (col, op)."""
    return [(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows)
            if i != j and all(OPS[o](x[c], y[c]) for c, o in dc)]
