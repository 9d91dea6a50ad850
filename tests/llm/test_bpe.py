import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from gainsay.llm import attribution, bpe


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["a", "'", "re", "'re", "ll ", " ", "  ", "\n\n", "\t", "7", "42", "é", "日本", "!", "?!", " ", " ", "x" * 40, " " * 30, "🙂", "<|endoftext|>"]


def odd_text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(ODD) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_stitched_chunks_equal_the_whole(reference, seed):
    text = odd_text(seed, 300)
    codec = bpe.pieces_of(P.path("byte_bpe_multi_50k.tiktoken"))
    stride, overlap = 40 + seed, 1 + seed % 20
    spans = bpe.chunks_of(text, stride, overlap)
    assert spans[-1][1] == len(text) and all(a[1] >= b[0] for a, b in zip(spans, spans[1:]))
    parts = []
    for k, (lo, hi) in enumerate(spans):
        fields = bpe.encoded_chunk(codec, text[lo:hi], lo, spans[k - 1][1] if k else 0, lo + stride, k == len(spans) - 1)
        parts.append(dict(zip(("ids", "head_at", "head_before", "tail_at", "tail_before"), fields)))
    ids = bpe.stitched(parts)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_documents_round_trip(spark, documents, reference):
    texts = [odd_text(1, 400), None, "", "a" * 5000, " " * 3000, "word " * 2000, odd_text(1, 400), "word " * 2000]
    docs = documents(texts, ids=[0, 1, 2, 3, 4, 5, 6, 5]).withColumn("tag", F.lit(1)).withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(docs, stride=512, overlap=64)).collect()
    assert len(got) == len(texts)
    want = sorted((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in zip([0, 1, 2, 3, 4, 5, 6, 5], texts))
    assert sorted((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_no_documents(spark, documents):
    assert bpe.decode(bpe.encode(documents([]))).collect() == []
    assert attribution.attribute(documents([])).collect() == []


@pytest.mark.parametrize("rule", attribution.RULES)
def test_sections_add_up_to_the_whole(spark, documents, reference, rule):
    texts = ["one\n\n\n  two\nthree", "é\né\n", "\n", "", None, "no break", odd_text(3, 200), odd_text(3, 200)]
    ids = [0, 1, 2, 3, 4, 5, 6, 6]
    got = attribution.attribute(documents(texts, ids=ids).withColumn("section", F.lit(9)), rule).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 5, 6}
    for i, text in zip(ids, texts):
        times = ids.count(i)
        rows = [r for r in got if r.doc_id == i]
        assert sum(r.n_tokens for r in rows) == pytest.approx(times * len(reference.encode_ordinary(text or "")))
    # Tokens one by one, by the rule's own words.
    text = texts[0]
    pieces = [reference.decode_single_token_bytes(t) for t in reference.encode_ordinary(text)]
    sections = text.encode().splitlines(keepends=True)
    owner = [s for s, part in enumerate(sections) for _ in part]
    want, at = [0.0] * len(sections), 0
    for p in pieces:
        own = owner[at:at + len(p)]
        for s in set(own):
            want[s] += {"first": own[0] == s, "last": own[-1] == s, "share": own.count(s) / len(p)}[rule]
        at += len(p)
    rows = sorted((r.section, r.start, r.end, r.n_tokens) for r in got if r.doc_id == 0)
    assert [r[3] for r in rows] == pytest.approx(want)
    assert "".join(text[a:b] for _, a, b, _ in rows) == text


def test_unknown_rule(documents):
    with pytest.raises(ValueError):
        attribution.attribute(documents(["a"]), "middle")
