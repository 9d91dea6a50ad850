"""From raw documents to tokens: toxicity, near duplicates, benchmark passages, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared folder and read again as
the documents of the next.  All but the last return the columns of ``documents``, whatever their names, untouched but for
the text and ``n_chars``, which follows the text where a stage changes it.  Null and empty texts pass every stage.  No stage is expressible in SQL as a whole (learned scores, BPE merges), so there is no SQL statement;
tests recompute every stage's decisions by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gainsay.llm import bpe, decontaminate, jaccard_join, secret_scan, toxicity
from gainsay.llm.common import importable, table
from gainsay.shared import staged


#: Columns that stages read or change; all others pass through them under numbers, so that none meets a name used inside.
READ = ("doc_id", "text", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with neutral names, and what gives their own names and order back."""
    names = {c: c if c in READ else f"d{i}" for i, c in enumerate(docs.columns)}
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    return docs.select(*[quoted[c].alias(n) for c, n in names.items()]), lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; the model is fitted on the training labels."""
    importable(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    inner, outer = _apart(docs)
    return outer(toxicity.scored(inner, model).where(F.col("toxicity") < toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of links; documents without words all stay."""
    importable(spark)
    return jaccard_join.one_per_component(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; mostly copied ones go."""
    importable(spark)
    inner, outer = _apart(docs)
    hit = decontaminate.contaminated(inner, table(spark, sf_dir, "benchmark"))
    return outer(_counted(decontaminate.cleaned(hit), F.size("hit_spans") > 0))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kind of each secret in its place."""
    importable(spark)
    inner, outer = _apart(docs)
    return outer(_counted(secret_scan.redacted(secret_scan.scan(inner)), F.size("secrets") > 0))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    importable(spark)
    coded = bpe.decode(bpe.encode(docs))
    return coded.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", cut_benchmark),
          ("secrets", redact_secrets), ("tokens", tokenise)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def _counted(docs: DataFrame, changed: Column) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
