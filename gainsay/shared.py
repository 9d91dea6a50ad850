"""The shared folder used to cut lineage and to stage tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or already set on the context).

    It is taken from the session.  Only a local master, where driver and executors are one process, may leave it unset
    and gets a temporary folder; on a cluster executors have to reach the folder and may be lost at any time.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="gainsay-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Unlike an RDD checkpoint the table stays columnar, so every later pass reads only the columns
    it needs.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small driver-side table (metadata) as a local relation of known size."""
    struct = spark.createDataFrame([], schema).schema
    columns = list(zip(*rows)) if rows else [() for _ in struct]
    arrow = pa.table({f.name: pa.array(list(c), type=to_arrow_type(f.dataType))
                      for f, c in zip(struct, columns)})
    return spark.createDataFrame(arrow, struct)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

