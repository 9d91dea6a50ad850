import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gainsay.llm import pair_maxscore as P

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, ranks):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, k in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:ranks])]
    return sorted(out)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.7)) for _ in range(60)] + ["É", "É", "ß", "co-op", "A1b", "tail"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 12, 60, 300]))) for _ in range(n)]
    texts[::7] = [texts[0]] * len(texts[::7])      # ties
    return texts + [None, "", " \t-", "x" * 200_000, "tail " * 100_000 + "end"], words


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sample", [0, 40, 10_000])
def test_search_equals_all_scores(spark, documents, seed, sample):
    texts, words = corpus(seed, 250)
    r = random.Random(seed)
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 30])))) for k in range(25)] + [(90, None), (91, ""), (92, "unknown"), (93, "end tail End")]
    docs = documents(texts).withColumn("score", F.lit(1)).withColumn("item", F.lit("clash")).withColumn("terms", F.lit("clash"))
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    got = sorted(tuple(x) for x in P.search(docs, asked, ranks=5, sample=sample).collect())
    assert got == brute(list(enumerate(texts)), items, 5)


def test_passes_ids_and_empty_tables(spark, documents, monkeypatch):
    texts, ids = ["a b", "a b", "b c d", "c", None, "a a a"], [3, 3, 9, None, 4, 1]
    docs = documents(texts, ids)
    items = spark.createDataFrame([("p", "a c"), ("q", "b b"), ("q", "zz"), (None, "a"), ("r", None)], "item_id string, text string")
    want = brute(list(zip(ids, texts)), [("p", "a c"), ("q", "b b"), ("r", None)], 20)
    assert sorted(tuple(x) for x in P.search(docs, items).collect()) == want
    monkeypatch.setattr(P, "TERMS", 2)
    assert sorted(tuple(x) for x in P.search(docs, items).collect()) == want
    assert P.search(documents([]), items).collect() == [] and P.search(docs, items.where("false")).collect() == []
    assert P.search(documents([None, ""]), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_pair_bounds_lie_between_scores_and_sums_of_maxima():
    r = np.random.default_rng(3)
    doc, term = np.nonzero(r.random((200, 12)) < 0.3)
    impact = r.integers(1, 1000, len(doc))
    pairs = [((a, 1 + a % 3), (a + 1, 2)) for a in range(0, 12, 2)]
    block = P.Block(np.arange(200), doc, term, impact, pairs)
    exact = np.zeros((200, 12), dtype=np.int64)
    exact[doc, term] = impact
    tighter = 0
    for pair in pairs:
        own = sum(c * exact[:, t] for t, c in pair)
        assert own.max() == block.bound(pair) <= sum(c * exact[:, t].max() for t, c in pair)
        tighter += block.bound(pair) < sum(c * exact[:, t].max() for t, c in pair)
        assert (block.gain(pair, np.arange(200)) == own).all()
    assert tighter
    total = sum(c * exact[:, t] for pair in pairs for t, c in pair)
    for least in (1, int(np.quantile(total, 0.5)), int(total.max()), int(total.max()) + 1):
        some, scores = block.best_of(pairs, least)
        assert some.tolist() == np.flatnonzero(total >= least).tolist() and (scores == total[some]).all()
