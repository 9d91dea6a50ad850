"""Reader for text logs of found constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Markers of the log format.
SECTION_MARK = "---"
NO_SECTION = "Unknown"


def read_dc_log(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, position, section, denial_constraint)`` of every ``!( ... )`` line.

    Lines keep their order as (file, block, position).  The section in force is carried forward
    inside each block of a file, and from block to block by one small table, so a single huge file
    is still read and labelled in parallel.
    """
    lines = (spark.read.text(path)
             .select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("position"))
             .where("line LIKE '---%---' OR line LIKE '!(%)'"))
    return label_sections(lines)


def label_sections(lines: DataFrame) -> DataFrame:
    """Carries section lines forward over ``(file, block, position, line)``."""
    named = lines.selectExpr("file", "block", "position", "line",
                             f"CASE WHEN line LIKE '{SECTION_MARK}%{SECTION_MARK}' "
                             "THEN trim(BOTH '- ' FROM line) END AS header")
    carried = (named.where("header IS NOT NULL").groupBy("file", "block")
               .agg(F.expr("max_by(header, position) AS final")))
    blocks = (named.select("file", "block").distinct().join(carried, ["file", "block"], "left")
              .selectExpr("file", "block", "last_value(final) IGNORE NULLS OVER (PARTITION BY file ORDER BY block "
                                           "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier"))
    inside = named.selectExpr("*", "last_value(header) IGNORE NULLS OVER (PARTITION BY file, block ORDER BY position "
                                   "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS here")
    return (inside.where("header IS NULL").join(blocks, ["file", "block"])
                  .selectExpr("file", "block", "position",
                              f"coalesce(here, earlier, '{NO_SECTION}') AS section", "line AS denial_constraint"))
