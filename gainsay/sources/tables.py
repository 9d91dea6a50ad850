"""Inputs: tables, CSV files in three dialects, inline rows; and column-slice export."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gainsay.operators.schema_model import quoted
from gainsay.shared import staged

# Type names a CSV header may carry, as in ``salary(Integer)``.
HEADER_TYPES = {"Integer": "bigint", "Double": "double", "String": "string"}

DELIMITERS, QUOTES, SNIFFED_LINES = (",", ";", "\t", "|"), ('"', "'"), 50


def read_input(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A table or view of that name, else a CSV file with header, inferred types and a sniffed dialect."""
    if _is_identifier(name_or_path) and spark.catalog.tableExists(name_or_path):
        return spark.table(name_or_path)
    sep, quote = sniffed([r[0] for r in spark.read.text(name_or_path).limit(SNIFFED_LINES).collect()])
    return spark.read.csv(name_or_path, header=True, inferSchema=True, sep=sep, quote=quote)


def sniffed(lines: Sequence[str]) -> tuple[str, str]:
    """Delimiter and quote of a CSV file, from its first lines: those that split most lines into equally many fields, at least two."""
    def fields(line: str, sep: str, quote: str) -> int:
        outside = "".join(line.split(quote)[::2]) if line.count(quote) % 2 == 0 else line
        return outside.count(sep) + 1

    def fit(sep: str, quote: str) -> tuple:
        counts = [fields(line, sep, quote) for line in lines if line.strip()]
        common = max(counts, key=counts.count, default=1)
        whole = sum(cell.strip()[:1] == quote == cell.strip()[-1:] for line in lines for cell in line.split(sep) if len(cell.strip()) > 1)
        return (common > 1) * counts.count(common), common, whole

    return max(((sep, quote) for sep in DELIMITERS for quote in QUOTES), key=lambda d: fit(*d))


def _is_identifier(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*){0,2}", name) is not None


def read_explicit_csv(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",",
                      quote: str = '"', escape: str = "\\") -> DataFrame:
    """Headerless CSV with a given schema; rows that do not fit are dropped, ``explicit_csv_rejects`` lists them."""
    return (spark.read.schema(schema).option("mode", "DROPMALFORMED").option("sep", delimiter)
                 .option("quote", quote).option("escape", escape).csv(path))


def read_typed_csv(spark: SparkSession, path: str, quote: str = "'", strip_types: bool = True) -> DataFrame:
    """CSV whose header names the types: ``id(Integer),name(String),price(Double)``.

    A cell that does not fit its type reads as NULL; ``typed_csv_rejects`` lists these cells.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, quote=quote, ignoreLeadingWhiteSpace=True)
    out = []
    for name in raw.columns:
        hit = re.fullmatch(r"(.*)\((\w+)\)", name)
        dtype = HEADER_TYPES.get(hit.group(2), "string") if hit else "string"
        plain = hit.group(1) if hit and strip_types else name
        out.append(F.expr(f"try_cast({_sql_name(name)} as {dtype})").alias(plain))
    return raw.select(*out)


def explicit_csv_rejects(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",",
                         quote: str = '"', escape: str = "\\") -> DataFrame:
    """``(line, cause)`` of the records that ``read_explicit_csv`` drops: too few or many fields, or the columns whose cells don't fit."""
    struct = spark.createDataFrame([], schema).schema
    names = [_sql_name(f.name) for f in struct.fields]
    kept = T.StructType([*struct.fields, T.StructField("__line", T.StringType())])
    rows = (spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line").option("sep", delimiter)
                 .option("quote", quote).option("escape", escape).csv(path))
    empty = ", ".join(f"CASE WHEN {n} IS NULL THEN '{f.name}' END" for n, f in zip(names, struct.fields))
    return (rows.where("__line IS NOT NULL").selectExpr("__line AS line", f"array_join(array_compact(array({empty})), ', ') AS none")
                .selectExpr("line", "CASE WHEN none = '' THEN 'number of fields' ELSE concat('empty or unfit: ', none) END AS cause"))


def typed_csv_rejects(spark: SparkSession, path: str, quote: str = "'") -> DataFrame:
    """``(column, wanted, value)`` of every cell that ``read_typed_csv`` has to read as NULL because it does not fit its type."""
    raw = spark.read.csv(path, header=True, inferSchema=False, quote=quote, ignoreLeadingWhiteSpace=True)
    cells = []
    for name in raw.columns:
        hit = re.fullmatch(r"(.*)\((\w+)\)", name)
        dtype = HEADER_TYPES.get(hit.group(2), "string") if hit else "string"
        if dtype != "string":
            cell = _sql_name(name)
            cells.append(F.expr(f"CASE WHEN {cell} IS NOT NULL AND try_cast({cell} AS {dtype}) IS NULL THEN struct('{dtype}' AS wanted, {cell} AS value) END")
                         .alias(f"cell{len(cells)}"))
    names = [m.group(1) for n in raw.columns if (m := re.fullmatch(r"(.*)\((\w+)\)", n)) and HEADER_TYPES.get(m.group(2), "string") != "string"]
    if not cells:
        return spark.createDataFrame([], "column string, wanted string, value string")
    tagged = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("column"), c["wanted"].alias("wanted"), c["value"].alias("value")))
                       for n, c in zip(names, (F.col(f"cell{k}") for k in range(len(cells))))])
    return raw.select(*cells).select(F.inline(F.array_compact(tagged)))


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def inline_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A few literal rows as a table."""
    return spark.createDataFrame(list(rows), schema)


def materialise(df: DataFrame, table: str | None = None) -> DataFrame:
    """Store a derived table once (in the catalog when named) so later passes do not redo it."""
    if table is None:
        return staged(df)
    df.write.saveAsTable(table)
    return df.sparkSession.table(table)


def export_columns(df: DataFrame, cols: Sequence[str], path: str) -> None:
    """Write some columns as CSV with a header."""
    df.select(*[quoted(c) for c in cols]).write.option("header", True).csv(path)
