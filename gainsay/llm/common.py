"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes that a Python task takes up and hands back at once, save for a single row that is larger.
ROWS, BYTES = 2048, 4 << 20
#: What functions remember within a worker; emptied at the end of a partition, since workers are used again by others.
MEMORIES: list[dict] = []
_C = ctypes.CDLL(None)


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it is, also when the driver found it by ``sys.path`` alone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget() -> None:
    """Empties the memories of this worker and hands free memory back: an idle worker counts beside those of later stages."""
    for held in MEMORIES:
        held.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow``, to which Spark hands batches of about ``BYTES`` bytes, save for a single row that is larger.

    Spark's own bound is 64 MB (or 10,000 rows), which executor and worker hold at once, and more while their buffers grow.  It is a
    setting of the session, read when the plan runs, so it stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``ROWS`` rows and, but for single rows, ``BYTES`` bytes."""
    lo = 0
    while lo < batch.num_rows:
        part = batch.slice(lo, ROWS)
        while part.num_rows > 1 and part.nbytes > BYTES:
            part = part.slice(0, part.num_rows // 2)
        yield part
        lo += part.num_rows


def mapped(df: DataFrame, rows: Callable[[dict[str, list]], Iterator[tuple]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that read columns as lists and yield output tuples."""
    struct = _struct(df, schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                held: list[tuple] = []
                size = 0
                for row in rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}):
                    held.append(row)
                    size += sum(x.nbytes if isinstance(x, np.ndarray) else len(x) for x in row if isinstance(x, (str, bytes, np.ndarray)))
                    if len(held) >= ROWS or size >= BYTES:
                        yield _packed(held, arrow)
                        held, size = [], 0
                if held:
                    yield _packed(held, arrow)
        forget()

    return in_arrow(df, run, struct)


def annotated(df: DataFrame, text_col: str, values: Callable[[list], Sequence[Sequence]], schema: str) -> DataFrame:
    """``df`` with new columns computed from one text column; the others pass through untouched.

    ``values`` gets the texts of a batch (nulls as empty) and returns one list per new column.  A column of
    ``df`` with the name of a new one is replaced.
    """
    added = _struct(df, schema)
    kept = [c for c in df.columns if c not in added.names and c != text_col]
    source = df.select(*(df[quoted(c)] for c in kept), df[quoted(text_col)])
    struct = StructType([*source.schema.fields, *added.fields])
    arrow, types, n = to_arrow_schema(struct), to_arrow_schema(added).types, len(source.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                new = values([t or "" for t in part.column(n - 1).to_pylist()])
                columns = [part.column(i) for i in range(n)] + [pa.array(v, type=t) for v, t in zip(new, types)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(
                    [pa.field(f.name, c.type) for f, c in zip(arrow, columns)]))
        forget()

    return in_arrow(source, run, struct)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns can't clash then."""
    return docs.select(docs[quoted(id_col)].cast("long").alias("doc_id"), docs[quoted(text_col)].cast("string").alias("text"))


def sampled(key: Column, size: int, total: int) -> Column:
    """Condition that about ``size`` of ``total`` rows meet, by a hash of their key: the same rows whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < int(min(1.0, size / max(total, 1)) * (1 << 40))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def digest_of(ids: Column) -> Column:
    """Lowercase hex SHA-256 of an array of ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ","), 256)


def _struct(df: DataFrame, schema: str) -> StructType:
    return df.sparkSession.createDataFrame([], schema).schema


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
