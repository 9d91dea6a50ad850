import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gainsay.llm import bpe, common, decontaminate, secret_scan, toxicity
from gainsay.llm.common import table
from gainsay.llm.queries import ORACLES, QUERIES
from tests.llm.test_decontaminate import brute as hits_of
from tests.llm.test_jaccard_join import set_of

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    # Toxicity: exactly the documents below the threshold, untouched.
    scores = {r.doc_id: r.toxicity for r in toxicity.scored(docs, toxicity.fit(docs, table(spark, SF, "labels"))).collect()}
    now = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert now.columns == columns
    left = {r.doc_id: r.text for r in now.collect()}
    assert left == {i: t for i, t in texts.items() if scores[i] < toxicity.THRESHOLD} and 0 < len(left) < len(texts)
    # Near duplicates: the least document of each group of links.
    sets, group = {i: set_of(t) for i, t in left.items()}, {i: i for i in left}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in left:
        for j in left:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    now = corpus_pipeline.drop_near_duplicates(spark, now, SF)
    assert now.columns == columns
    kept = {r.doc_id: r.text for r in now.collect()}
    assert kept == {i: t for i, t in left.items() if find(i) == i}
    # Benchmark: no window is left where it was, others are untouched.
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    now = corpus_pipeline.cut_benchmark(spark, now, SF)
    assert now.columns == columns
    clean = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
    for i, t in kept.items():
        n, hit, _ = hits_of(t, items, decontaminate.WINDOW)
        if not hit:
            assert clean[i][0] == t
        elif len(hit) >= decontaminate.MAX_COVERAGE * n:
            assert i not in clean
        else:
            words = decontaminate.words_of(t)
            assert decontaminate.words_of(clean[i][0]) == [w for k, w in enumerate(words) if k not in hit] and clean[i][1] == len(clean[i][0])
    # Secrets: base spans are gone.
    now = corpus_pipeline.redact_secrets(spark, now, SF)
    assert now.columns == columns
    safe = {r.doc_id: r.text for r in now.collect()}
    assert set(safe) == set(clean) and not any(secret_scan.base_spans(t) for t in safe.values())
    assert all(safe[i] == t for i, (t, _) in clean.items() if not secret_scan.base_spans(t))
    # Tokens decode to the texts.
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(now)).collect()}
    assert got == safe
    final = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == set(safe)


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    odd = [(900_001, None), (900_002, ""), (900_003, " \n\t"), (900_004, "x " * 50_000), (900_005, "x " * 50_000), (900_006, "password = hunter2hunter2")]
    clash = {"toxicity": 7, "toxic_patterns": "p", "n_words": 3, "hit_spans": "h", "hit_items": "i", "secrets": "s", "stays": False, "__id": 7, "_n": 5, "d0": "d", "a b": 1}
    some = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    for c, v in clash.items():
        some = some.withColumn(c, F.lit(v))
    now = some
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == some.columns, name
        rows = {r["doc_id"]: r for r in now.collect()}
        assert {900_001, 900_002, 900_003, 900_004} <= set(rows), name
        assert all(r[c] == v for r in rows.values() for c, v in clash.items()), name
    assert 900_005 not in rows and "hunter2" not in rows[900_006]["text"] and rows[900_006]["n_chars"] == len(rows[900_006]["text"])
    last = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.tokenise(spark, now, SF).collect()}
    assert set(last) == set(rows) and last[900_001] == last[900_002] == 0
    empty = some.limit(0)
    assert all(stage(spark, empty, SF).collect() == [] for _, stage in corpus_pipeline.STAGES)


def test_url_filter_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = QUERIES["op8_url_filter"](spark, SF)
    want = con.execute(ORACLES["op8_url_filter"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(os.path.join(tmp_path, f"{t}.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    assert got.count() == 0 and got.columns


def test_workers_get_texts_a_few_megabytes_at_a_time(spark, documents, monkeypatch):
    """Spark's own bound of 64 MB, or 10,000 rows, a batch let all texts of a partition reach a worker at once."""
    texts = [f"{k} " * 40_000 for k in range(300)]
    whole = documents(texts).coalesce(1).select("doc_id", "text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    got = common.in_arrow(whole, sizes, "n long, bytes long").collect()
    largest = max(len(t) for t in texts)
    assert sum(r["n"] for r in got) == len(texts) and max(r["bytes"] for r in got) <= common.BYTES + 2 * largest
    monkeypatch.setattr(common, "BYTES", 1 << 20)
    assert common.mapped(whole, lambda cols: ((len(t),) for t in cols["text"]), "n long").agg({"n": "sum"}).first()[0] == sum(map(len, texts))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(1 << 20)
