"""Type classes, value encoding, constant columns and the predicate space."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gainsay.functions.text import OPERATORS, predicate_text
from gainsay.shared import local_table

INTEGER, REAL, STRING = "INTEGER", "REAL", "STRING"

# Strings longer than this are compared by their SHA-256 digest (64 bytes), so an encoded row has
# a bounded width; shorter ones are kept, hence a digest never meets a raw value.
RAW_STRING_BYTES = 63


@dataclass(frozen=True)
class ColumnInfo:
    col_id: int
    name: str
    type_class: str
    temporal: bool = False


@dataclass(frozen=True)
class Predicate:
    pred_id: int
    col_id: int
    op_id: int
    col: str
    op: str


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def _type_class(dtype: T.DataType, order_temporal: bool) -> tuple[str, bool]:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER, False
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return REAL, False
    if order_temporal and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return INTEGER, True
    return STRING, False


def column_infos(schema: T.StructType, order_temporal: bool = False) -> list[ColumnInfo]:
    return [ColumnInfo(k, f.name, *_type_class(f.dataType, order_temporal))
            for k, f in enumerate(schema.fields)]


def type_classes(df: DataFrame, order_temporal: bool = False) -> DataFrame:
    """One row per column: ``(col_id, col, type_class)``."""
    rows = [(c.col_id, c.name, c.type_class) for c in column_infos(df.schema, order_temporal)]
    return local_table(df.sparkSession, rows, "col_id int, col string, type_class string")


def schemas_equal(left: DataFrame, right: DataFrame) -> bool:
    """Same columns with the same type classes in the same order."""
    return [(c.name, c.type_class) for c in column_infos(left.schema)] == \
        [(c.name, c.type_class) for c in column_infos(right.schema)]


def predicates_of(infos: Iterable[ColumnInfo]) -> list[Predicate]:
    out: list[Predicate] = []
    for c in infos:
        for op_id, op in enumerate(OPERATORS[:2] if c.type_class == STRING else OPERATORS):
            out.append(Predicate(len(out), c.col_id, op_id, c.name, op))
    return out


def predicate_space(df: DataFrame, order_temporal: bool = False) -> DataFrame:
    """All same-column comparisons: ``(pred_id, col_id, op_id, col, op, predicate)``."""
    rows = [(p.pred_id, p.col_id, p.op_id, p.col, p.op)
            for p in predicates_of(column_infos(df.schema, order_temporal))]
    space = local_table(df.sparkSession, rows, "pred_id int, col_id int, op_id int, col string, op string")
    return space.withColumn("predicate", predicate_text(F.col("col"), F.col("op")))


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _wall_clock_micros(ref: str) -> str:
    """Microseconds of a timestamp without a zone, from its own fields: no session zone, so no skipped or repeated hour."""
    return (f"(unix_date(CAST({ref} AS DATE)) * 86400000000L + hour({ref}) * 3600000000L + minute({ref}) * 60000000L "
            f"+ CAST(extract(SECOND FROM {ref}) * 1000000 AS BIGINT))")


def encoded_sql(ref: str, dtype: T.DataType, info: ColumnInfo, parity: bool = False, compact: bool = False) -> str:
    """Comparable form of one column: NULL becomes 0, NaN or the empty string.

    ``compact`` is for comparisons only: long strings become digests, and times, which as text are
    only compared for equality, become numbers (NULL the smallest one).
    """
    is_date = isinstance(dtype, T.DateType)
    is_time = isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    if is_date or is_time:
        number = f"CAST(unix_date({ref}) AS BIGINT)" if is_date else f"unix_micros({ref})"
        if isinstance(dtype, T.TimestampNTZType):
            number = _wall_clock_micros(ref)
        if info.temporal:
            return f"coalesce({number}, 0L)"
        if compact:
            return f"coalesce({number}, {-(1 << 63) + 1}L)"
    if info.type_class == INTEGER:
        return f"coalesce(CAST({ref} AS BIGINT), 0L)"
    if info.type_class == REAL:
        value = f"CAST(CAST({ref} AS FLOAT) AS DOUBLE)" if parity else f"CAST({ref} AS DOUBLE)"
        return f"coalesce({value}, double('NaN'))"
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        ref = f"to_json({ref})"
    elif isinstance(dtype, T.BinaryType):
        ref = f"hex({ref})"
    text = f"coalesce(CAST({ref} AS STRING), '')"
    if compact:
        text = f"CASE WHEN octet_length({text}) > {RAW_STRING_BYTES} THEN sha2({text}, 256) ELSE {text} END"
    return text


def encoded_value(field: T.StructField, info: ColumnInfo, parity: bool = False, compact: bool = False) -> Column:
    return F.expr(encoded_sql(sql_name(field.name), field.dataType, info, parity, compact))


def encode(df: DataFrame, parity: bool = False, order_temporal: bool = False) -> DataFrame:
    """``df`` with every column in its comparable form, names kept."""
    infos = column_infos(df.schema, order_temporal)
    return df.select(*[encoded_value(f, c, parity).alias(c.name) for f, c in zip(df.schema.fields, infos)])


def constant_columns(df: DataFrame, parity: bool = False, order_temporal: bool = False) -> DataFrame:
    """``(col_id, col, type_class, is_constant)``, all columns in one aggregate.

    A column is constant when all encoded values are equal; NaN differs from itself, so a REAL
    column holding any NaN is not constant.
    """
    infos = column_infos(df.schema, order_temporal)
    values = df.select(*[encoded_value(f, c, parity, compact=True).alias(f"c{c.col_id}")
                         for f, c in zip(df.schema.fields, infos)])
    flags = [is_constant(F.col(f"c{c.col_id}"), c.type_class).alias(f"k{c.col_id}") for c in infos]
    entries = F.array(*[F.struct(F.lit(c.col_id).alias("col_id"), F.lit(c.name).alias("col"),
                                 F.lit(c.type_class).alias("type_class"),
                                 F.coalesce(F.col(f"k{c.col_id}"), F.lit(False)).alias("is_constant"))
                        for c in infos])
    return values.agg(*flags).select(F.inline(entries))


def is_constant(value: Column, type_class: str) -> Column:
    """Aggregate: every value of the (encoded) column is the same."""
    lo, hi = F.min(value), F.max(value)
    if type_class == REAL:
        return (lo == hi) & ~F.isnan(hi)
    return lo == hi


def dictionary(df: DataFrame, col: str, parity: bool = False) -> DataFrame:
    """Dictionary of one column: ``(value, cnt)`` per distinct encoded value.

    Comparisons only need equality of values, which Spark does on the values themselves; the
    dictionary is for profiling and needs no dense global numbering.
    """
    field = df.schema[col]
    info = column_infos(T.StructType([field]))[0]
    return (df.select(encoded_value(field, info, parity).alias("value"))
              .groupBy("value").agg(F.count(F.lit(1)).alias("cnt")))
