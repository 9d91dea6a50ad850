"""Classification of found constraints, totals and examples."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gainsay.functions.text import KEY_PATTERN, LOOKUP_PAIRS, classify, is_useless, parse_dc


def parse(df: DataFrame, line: str = "denial_constraint") -> DataFrame:
    """Adds ``parsed``: ``array<struct<left, op, right>>``."""
    return df.withColumn("parsed", parse_dc(F.col(line)))


def triage(df: DataFrame, line: str = "denial_constraint", key_pattern: str = KEY_PATTERN,
           lookup_pairs: Iterable[tuple[str, str]] = LOOKUP_PAIRS) -> DataFrame:
    """Adds ``parsed``, ``category`` and ``useless``."""
    parsed = df if "parsed" in df.columns else parse(df, line)
    return (parsed.withColumn("category", classify(F.col("parsed"), key_pattern, lookup_pairs))
                  .withColumn("useless", is_useless(F.col("category"))))


def summary(triaged: DataFrame) -> DataFrame:
    """``(section, total, useful, useless)``; the grand total has a NULL section."""
    return triaged.rollup("section").agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.when(~F.col("useless"), 1).otherwise(0)), F.lit(0)).alias("useful"),
        F.coalesce(F.sum(F.when(F.col("useless"), 1).otherwise(0)), F.lit(0)).alias("useless"))


def category_counts(triaged: DataFrame) -> DataFrame:
    """Number of useless constraints by section and category.

    All classes are counted first: a filter before the grouping, where the optimizer would also move one that looks at the class
    alone, parses every line once more.
    """
    counted = triaged.groupBy("section", "category").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.when(F.col("n") > 0, is_useless(F.col("category"))))


def examples(triaged: DataFrame, order: Sequence[str] | None = None, line: str = "denial_constraint", n: int = 5) -> DataFrame:
    """The first ``n`` useless constraints of each category, and how many more there are.

    Without ``order`` they come as in the log: by file, block and position, as far as these columns are there.  The rank filter lets every task send at most ``n`` rows per group, however large the group.
    """
    useless = triaged.where("useless")
    by = list(order) if order else [c for c in ("file", "block", "position") if c in triaged.columns]
    first = (useless.select("section", "category", *by, line)
             .withColumn("place", F.row_number().over(Window.partitionBy("section", "category").orderBy(*by)))
             .where(f"place <= {int(n)}"))
    return (first.join(category_counts(triaged), ["section", "category"])
                 .select("section", "category", "place", line, F.greatest(F.col("n") - n, F.lit(0)).alias("more")))
