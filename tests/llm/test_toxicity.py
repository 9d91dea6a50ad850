import random
import zlib

import pytest
from pyspark.sql import functions as F

from gainsay.llm import toxicity as T

CALM = "the weather in the valley was mild and the river ran slowly past old stone houses while people walked home".split()


def corpus(n):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(CALM) for _ in range(r.randint(3, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["blorfo", "zunkab", "zunkel", "zunkiri", "zunkoso", "zunkette"]))
        texts.append(" ".join(words) + ".")
        labels.append((i, int(i % 5 == 0), int(toxic)))
    return texts, labels


@pytest.fixture(scope="module")
def labelled(spark):
    texts, labels = corpus(1200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark, labelled):
    docs, labels = labelled
    got = T.digests(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 1200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.predicted == r.toxic for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_never_read(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda l: sorted((r.doc_id, r.score) for r in T.digests(docs, l).collect())
    assert score(labels) == score(flipped)


def test_edges(spark, labelled):
    docs, labels = labelled
    model = T.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "zunkxx"), (2, "zunkxx"), (None, "calm " * 50_000 + "blorfo"), (3, "x")],
                                "doc_id long, text string").withColumn("toxicity", F.lit("clash"))
    got = T.scored(odd, model).select("doc_id", "text", "toxicity").collect()
    assert len(got) == 6
    scores = {(r.doc_id, r.text and r.text[:6]): r.toxicity for r in got}
    assert scores[1, None] == scores[1, ""] == scores[3, "x"] == pytest.approx(model.base)
    assert scores[2, "zunkxx"] > 0.3 < scores[None, "calm c"]
    assert T.digests(docs.limit(0), labels.limit(0)).collect() == []


def test_fixed_words_without_labels(spark, labelled):
    docs, labels = labelled
    model = T.fit(docs, labels.where("toxic IS NULL"))
    score = lambda text: model.score(model.matches(text))
    assert score("You are an idiot.") >= 0.3 > score("A mild day.")
    assert score("I will kill you.") >= 0.3 > score("They kill time.".replace("They", "Bored cats"))
    assert score("He is not an idiot.") < score("He is an idiot.")


def test_grammar_marks_clauses():
    model = T.Model({"idiot": ("I", 1.0), "kill": ("T", 1.0)}, {"zunk": ("I", 1.0)})
    names = lambda text: [p for p, _ in model.matches(text)]
    assert names("Idiot! You idiot.") == ["insult", "insult to target"]
    assert names("not a real idiot, idiot") == ["negated insult", "insult"]
    assert names("she said idiot. idiot") == ["reported insult to target", "insult"]
    assert names("said: never kill you") == ["reported negated threat to target"]
    assert names("zunkig und zunk") == ["insult"]
    assert names("") == names("calm") == []


def test_a_small_sample_scores_like_all_labels(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(6000):
        words = [r.choice(CALM) for _ in range(12)]
        toxic = i % 10 == 0
        if toxic and i % 20 == 0:                                            # half of the toxic documents match nothing
            words[r.randrange(12)] = "zunkab"
        elif not toxic and i % 50 == 1 or toxic and i % 100 == 10:           # matched by a fixed word, mostly in clean documents
            words[r.randrange(12)] = "hurt"
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, part = T.fit(docs, known), T.fit(docs, known, size=400)
    assert whole.base < 0.1 and part.base == pytest.approx(whole.base, abs=0.02)
    assert set(part.patterns) == set(whole.patterns)
    for text in (None, "calm", "a zunkab here.", "cold hurt."):
        scores = [m.score(m.matches(text or "")) for m in (whole, part)]
        assert scores[1] == pytest.approx(scores[0], abs=0.15)
        assert (scores[0] >= T.THRESHOLD) == (scores[1] >= T.THRESHOLD)
