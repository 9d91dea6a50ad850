import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gainsay.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        seq = words(body)
        n = min(window, len(seq))
        for k in range(len(seq) - n + 1) if n else ():
            for i in range(len(doc) - n + 1):
                if doc[i:i + n] == seq[k:k + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(doc), hit, {i for i in found if i is not None}


@pytest.mark.parametrize("seed", range(300))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    letters, window = "abc"[:r.randint(1, 3)], r.choice([1, 2, 3, 10])
    items = [(i, " ".join(r.choice(letters) for _ in range(r.randint(0, window + 6)))) for i in range(r.randint(0, 5))]
    text = " ".join(r.choice(letters + "d") for _ in range(r.randint(0, 40)))
    spans, found = D.Automaton([(i, D.words_of(t)) for i, t in items], window).hits(D.words_of(text))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert (len(words(text)), {i for lo, hi in spans for i in range(lo, hi)}, found) == brute(text, items, window)


def test_words_follow_the_definition():
    for text in ("A-B c_d\u00e9\u0130 x\x7fy \u212a1 z", "", "123", "\u00c9COLE Stra\u00dfe\n\u65e5\u672c"):
        assert [w.decode() for w in D.words_of(text)] == words(text)


def cases():
    r = random.Random(4)
    item = lambda n: " ".join(r.choice("alpha beta gamma delta mu nu xi pi rho tau".split()) + str(r.randrange(40)) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([30, 12, 10, 9, 3, 0, 30])] + [(3, None), (None, item(11)), (2, item(15)), (7, items_shared(r))]
    texts = [None, "", "quite clean"] + [f"start {b or ''} end" for _, b in items]
    a = items[0][1].split()
    texts += [" ".join(a[3:12]), " ".join(a[3:13]).upper(), " ".join(a[3:13] + ["cut"] + a[13:25]), ", ".join(a), "noise " * 20_000 + items[1][1], texts[3], texts[3]]
    return items, texts


def items_shared(r):
    return " ".join(str(r.randrange(5)) for _ in range(25))


@pytest.mark.parametrize("shard_words", [10_000, 20])
def test_digests_of_documents(spark, documents, shard_words):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(texts, ids=[*range(len(texts) - 1), len(texts) - 2]).withColumn("n_words", F.lit("clash"))
    hit = D.contaminated(docs, bench, shard_words=shard_words)
    got = sorted((r.doc_id, r.n_words, {i for s in r.hit_spans for i in range(s.start, s.end)}, set(r.hit_items)) for r in hit.collect())
    want = sorted((i, *brute(t, items, 10)) for i, t in zip([*range(len(texts) - 1), len(texts) - 2], texts))
    assert got == want
    rows = {r.doc_id: r for r in D.digests(docs, bench).collect()}
    for i, n, spans, found in want:
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(spans), len(found), bool(spans))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_cleaning_cuts_spans_and_drops_mostly_copied_texts(spark, documents):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [f"One, two three: {item.upper()}! " + "four " * 30, item + " x", "clean -- text", None, ""]
    got = {r.doc_id: r.text for r in D.cleaned(D.contaminated(documents(texts), bench)).collect()}
    assert got == {0: "One, two three: ! " + "four " * 30, 2: "clean -- text", 3: None, 4: ""}


def test_empty_tables(spark, documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.digests(documents(["a b"]), empty).collect()] == [False]
    assert D.digests(documents([]), empty).collect() == []
