import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gainsay.llm import common, jaccard_join as J
from gainsay.llm.components import components


def set_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(ids, texts):
    sets = [set_of(t) for t in texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, s in enumerate(sets):
        known = [x for x in (ids[i], least.get(find(i))) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((ids[i], len(s), least[find(i)] if s else ids[i]) for i, s in enumerate(sets)), key=str)


def families(seed):
    """Near copies around the limit, chains, copies in groups, shared passages, short and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([6, 12, 40, 120, 400]))]
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if r.random() < 0.3:
                base = copy
        if r.random() < 0.5:
            texts.append(" ".join(base[:len(base) // 2] + passage))
    for k in range(60):
        texts.append(" ".join(passage + [word() for _ in range(k % 15)]))
    same = " ".join(word() for _ in range(80))
    texts += [same] * 40 + [same.upper() + "  \n"] * 3 + ["", None, " \t ", "one", "ONE", "one two", "é É", "É é", "x " * 3000, "x " * 2000]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, documents, monkeypatch, seed):
    monkeypatch.setattr(J, "LEAF", 4)
    monkeypatch.setattr(J, "SPREAD", 5)
    texts = families(seed)
    ids = list(range(1000, 1000 + len(texts)))
    monkeypatch.setattr(J, "DEALT", 6)
    docs = documents(texts, ids).withColumn("node", F.lit("clash")).withColumn("component", F.lit(0)).withColumn("stays", F.lit(False)).withColumn("__id", F.lit(7))
    got = sorted((tuple(r) for r in J.join(docs).collect()), key=str)
    assert got == brute(ids, texts)
    kept = sorted(r.doc_id for r in J.one_per_component(docs).collect())
    assert kept == sorted(i for i, n, c in got if n == 0 or i == c)
    one = J.one_per_component(docs)
    assert set(one.columns) == set(docs.columns) and {(r["stays"], r["__id"]) for r in one.collect()} == {(False, 7)}


def test_points_of_a_tree_that_miss_its_centre_meet(spark):
    """Trees of fewer than DEALT points once lost their key between the rounds, so the second round compared nothing."""
    trees = spark.createDataFrame([(k, n, 5) for k in (1, 2) for n in (11, 12, 13, 14)], "key long, node long, n int")
    known = spark.createDataFrame([(11, 11), (12, 11)], "node long, component long")
    sets = spark.createDataFrame([(n, 5, [1] * J.GROUPS) for n in (11, 12, 13, 14)], "node long, n long, vec array<int>")
    got = sorted(map(tuple, J.between_components(trees, known, sets, 80).collect()))
    assert got == [(11, 13), (11, 14), (12, 13), (12, 14), (13, 14)]


def test_large_group_of_near_copies_that_reach_no_common_centre(documents):
    """One group in which most copies link with some others only; all settings as they are."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base, texts = [word() for _ in range(150)], []
    for k in range(80):
        copy = list(base) if k % 4 else texts[r.randrange(len(texts))].split() if texts else list(base)
        for _ in range(r.randint(1, 3)):
            copy[r.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    want = brute(ids, texts)
    assert 1 < len({c for _, _, c in want}) < 30
    assert sorted((tuple(x) for x in J.join(documents(texts, ids)).collect()), key=str) == want


def test_repeated_and_missing_ids(spark, documents):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    texts, ids = [a, a, b, None, "", a, b, ""], [7, 7, None, 3, 3, 9, 5, None]
    got = sorted((tuple(r) for r in J.join(documents(texts, ids)).collect()), key=str)
    assert got == sorted([(7, 6, 7), (7, 6, 7), (9, 6, 7), (None, 6, 5), (5, 6, 5), (3, 0, 3), (3, 0, 3), (None, 0, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in J.one_per_component(documents(texts, ids)).collect()), key=str)
    assert kept == sorted([(7, a), (5, b), (3, None), (3, ""), (None, "")], key=str)


def test_no_documents(documents):
    assert J.join(documents([])).collect() == []
    assert J.one_per_component(documents([None])).count() == 1


def test_bound_is_never_below_the_overlap():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 2**63, 200, dtype=np.uint64)) for _ in "ab")
        b = np.union1d(a[:r.integers(0, 200)], b[:50])
        at = lambda v: np.bincount((v >> J._TO_GROUP).astype(int), minlength=J.GROUPS)
        assert np.minimum(at(a), at(b)).sum() >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("seed", range(6))
def test_components(spark, seed):
    r = random.Random(seed)
    n = r.choice([10, 60, 200])
    links = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, n))] + [(k, k + 1) for k in range(0, 12)] * (seed % 2) + [(5, 5), (None, 3)]
    parent = list(range(n + 20))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {(i, find(i)) for a, b in links if a is not None and a != b for i in (a, b)}
    got = [tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_texts_of_candidates_are_read_a_few_at_a_time(monkeypatch):
    """All texts of an Arrow batch once became Python strings at once; an owner also holds for the parts after its own."""
    taken = []

    def counted(batch):
        for part in common.slices(batch):
            taken.append((part.num_rows, part.nbytes))
            yield part

    monkeypatch.setattr(common, "ROWS", 3)
    monkeypatch.setattr(J, "slices", counted)
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, 0, None, text)] + [(1, 0, b, text if b % 2 else text.upper() + " x y z " * b) for b in range(2, 9)] + [(9, 0, None, "a b c d e f"), (9, 0, 10, text)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["a", "part", "b", "text"])
    links = [(a, b) for out in J.linked(iter([batch]), 5, 80) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    want = {(a, b) for a, _, b, t in rows if b is not None for o in [{1: text, 9: "a b c d e f"}[a]]
            if 100 * len(set_of(o) & set_of(t)) >= 80 * len(set_of(o) | set_of(t))}
    assert set(links) == want and len(links) == len(want) >= 3 and max(n for n, _ in taken) == 3
