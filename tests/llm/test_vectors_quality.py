import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gainsay.llm import ann, quality


def nearest(ids, x, k):
    out = {}
    for i in np.flatnonzero(np.array(ids) % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("part, queries", [(4096, 1024), (64, 8)])
def test_recall_and_scores(spark, monkeypatch, part, queries):
    monkeypatch.setattr(ann, "PART", part)
    monkeypatch.setattr(ann, "QUERIES", queries)
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 32)).astype(np.float32).astype(float)
    x[600:1000] = x[600]                                                    # a third of the rows are one vector
    ids = np.arange(1500)
    rows = spark.createDataFrame([(int(i), v.tolist(), "clash") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score string")
    got = {}
    for row in ann.search(rows, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row["rank"] == len(got[row.query_id])
    want = nearest(ids, x, 20)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hits = sum(s >= want[q][-1][1] - 1e-9 for q, g in got.items() for _, s in g)
    assert hits >= 0.9 * 20 * len(want)
    for q, g in got.items():
        assert g == sorted(g, key=lambda v: (-v[1], v[0])) and all(abs(s - x[v] @ x[q]) < 1e-9 for v, s in g)


@pytest.mark.parametrize("spread", [0.0, 0.05])
def test_recall_where_copies_or_a_cluster_come_first(spark, spread):
    r = np.random.default_rng(4)
    x = r.standard_normal((2400, 32)).astype(np.float32).astype(float)
    x[:1800] = (x[0] + spread * x[:1800]).astype(np.float32)                # most rows, stored first, are alike
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = {q: w for q, w in nearest(np.arange(2400), x, 20).items() if q >= 1800}
    got = ann.search(rows, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") >= 1800), k=20).collect()
    assert len(got) == 20 * len(want)
    assert sum(g.score >= want[g.query_id][-1][1] - 1e-9 for g in got) >= 0.9 * len(got)


def test_few_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]),
            (None, [1.0, 1.0]), (8, [0.5, 0.0]), (20, [0.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 8, 0.5), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 8, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.search(df.where("vec_id = 2"), F.col("vec_id") % 20 == 0).collect() == []


def test_scan_drops_no_true_neighbour():
    r = np.random.default_rng(5)
    q, x = r.standard_normal((40, 64)), r.standard_normal((3000, 64))
    rotation, _ = np.linalg.qr(r.standard_normal((64, 64)))
    found = {(a, b) for qi, xi in ann.scan(q, x, rotation, 20) for a, b in zip(qi.tolist(), xi.tolist())}
    top = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([(a, b) in found for a in range(40) for b in top[a]]) > 0.99
    assert len(found) < 0.3 * 40 * 3000


def test_labellers_are_weighed_without_labels():
    r = random.Random(2)
    skill = [0.95, 0.9, 0.85, 0.8, 0.55, 0.5, 0.5, 0.5]
    counts, truth = {}, {}
    for _ in range(6000):
        good = r.random() < 0.7
        votes = "".join("0" if r.random() < 0.2 else "+" if (r.random() < s) == good else "-" for s in skill)
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(good)
    posterior, table = quality.estimate(list(counts.items()))
    right = sum((posterior[v] > 0.5) == g for v, gs in truth.items() for g in gs)
    assert right >= 0.93 * 6000
    learned = table[:6, 1, 2] / (table[:6, 1, 0] + table[:6, 1, 2])
    assert np.abs(learned - skill[:6]).max() < 0.08


def test_scorer_judges_held_out_texts(spark, documents):
    r = random.Random(1)
    word = lambda: r.choice("the of and to in is that for river valley stone house people weather mild ran slowly past old walked".split())
    good = [" ".join(word() for _ in range(60)).capitalize() + ". " + " ".join(word() for _ in range(9)) + "." for _ in range(150)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(40)] + [" | ".join(word() for _ in range(60)) for _ in range(40)]
    texts = good + bad + [None, "", good[0], "word " * 40_000]
    docs = documents(texts).withColumn("score", F.lit("clash"))
    got = {x.doc_id: x for x in quality.classify(docs).collect()}
    assert len(got) == len(texts)
    assert sum(got[i].keep for i in range(150)) >= 145 and sum(not got[i].keep for i in range(150, 230)) >= 75
    assert got[230].votes == got[231].votes == "0" * 8 and got[232].score == got[0].score
    assert quality.classify(documents([])).collect() == []


def test_shapes_are_worked_out_once_for_tokens_of_the_same_classes(monkeypatch):
    """Texts with many distinct words once worked out the shape of each, character by character, which took most of the time."""
    def plain(token):
        zeros = "".join("0" if c in "0123456789" else c for c in token)
        shape = re.sub(r"(.)\1+", r"\1\1", "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in zeros))
        return tuple(xxhash.xxh3_64_intdigest(kind + t) % quality.FEATURES for kind, t in (("w", token.lower()), ("s", shape)))

    odd = ["a", "Word", "IBM", "x2y22z222", "\0same", "ǅungla", "ß²³٣", "日本語", "--!!", "naïve-É", "0x00FF", "a" * 70, "İ1", "q́"]
    assert [quality.slots_for(t) for t in odd] == [plain(t) for t in odd]
    subs = []

    class Run:
        def sub(self, into, classes):
            subs.append(classes)
            return re.sub(r"(.)\1+", into, classes)

    monkeypatch.setattr(quality, "_RUN", Run())
    quality._SHAPES.clear()
    words = [f"w{k:05d}q" for k in range(2000)] + odd
    assert [quality.slots_for(w) for w in words] == [plain(w) for w in words] and subs.count("x00000x") == 1 and len(subs) <= 1 + len(odd)
    rng = np.random.default_rng(7)
    scorer = quality.Weights(rng.normal(size=quality.FEATURES), 0.3)
    for _ in range(20):
        text = " ".join(rng.choice(words, 40).tolist() + ["a", "a"])
        where, value = quality.features_of(text)
        assert math.isclose(scorer.score(text), 1 / (1 + math.exp(-(np.array(scorer.weights)[where] @ value + 0.3))), rel_tol=1e-9)
