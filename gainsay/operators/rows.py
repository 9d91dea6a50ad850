"""Rows with dense numbers, encoded for pair comparison."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gainsay.operators.schema_model import (RAW_STRING_BYTES, REAL, STRING, ColumnInfo, Predicate, column_infos,
                                            encoded_sql, predicates_of, quoted, sql_name)
from gainsay.shared import local_table, staged

_POSITION_MASK = (1 << 33) - 1
_PROBE_ROWS = 64
#: The largest table of files and their offsets that is broadcast.
LOOKUP_BYTES = 64 << 20


def value_name(col_id: int) -> str:
    return f"c{col_id}"


@dataclass
class RowSet:
    """Rows ``(rid, c0, c1, ...)`` with ``rid`` dense in ``[0, n)``, plus column facts.

    ``df`` holds the raw columns; ``encoded`` gives their comparable forms, so a plan that first
    narrows the rows down encodes only those it keeps.
    """

    df: DataFrame
    n: int
    columns: list[ColumnInfo]
    parity: bool = False
    constant: dict[int, bool] = field(default_factory=dict)

    @property
    def predicates(self) -> list[Predicate]:
        return predicates_of(self.columns)

    def encoded(self, col_id: int) -> str:
        name = value_name(col_id)
        return encoded_sql(name, self.df.schema[name].dataType, self.columns[col_id], self.parity, compact=True)

    def values(self, col_ids: Sequence[int]) -> DataFrame:
        """``(rid, c..)`` in comparable form."""
        return self.df.selectExpr("rid", *[f"{self.encoded(c)} AS {value_name(c)}" for c in col_ids])

    def width(self, col_ids: Sequence[int]) -> int:
        """Proven upper bound for the bytes of one encoded row with these columns."""
        return 32 + sum(8 + (RAW_STRING_BYTES + 9 if self.columns[c].type_class == STRING else 8) for c in col_ids)


def with_row_id(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "rid") -> DataFrame:
    """``df`` plus a dense row number; see ``numbered``."""
    return numbered(df, order_by, name)[0]


def numbered(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "rid") -> tuple[DataFrame, int]:
    """``df`` plus a dense row number, and the number of rows.

    Without ``order_by`` rows are numbered by their files, in order of their paths, and their places in these: both are properties of
    what is stored, so nothing is shuffled and numbers stay the same however a later job deals the files out to tasks.  What is
    more than a scan of Parquet files is stored first.  With ``order_by`` rows are range-partitioned and sorted by those columns and
    stored with their positions; numbers, times and a hash of the row break ties, which also splits a frequent key over partitions.
    """
    spark = df.sparkSession
    part, pos, cnt, before = "__part", "__pos", "__cnt", "__before"
    if order_by:
        keys = [quoted(c) for c in order_by]
        ties = _ties(df, order_by)
        ordered = df.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)
        placed = staged(ordered.select("*", F.spark_partition_id().cast("string").alias(part),
                                       F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias(pos)))
        rank = int
    else:
        base = df if plain_scan(df) else staged(df)
        where = base.metadataColumn("_metadata")
        placed = base.select("*", where["file_path"].alias(part), where["row_index"].alias(pos))
        rank = str
    counts = sorted((rank(p), c) for p, c in placed.groupBy(part).agg(F.count(F.lit(1)).alias(cnt)).collect())
    offsets, total = [], 0
    for p, c in counts:
        offsets.append((str(p), total))
        total += c
    names = [sql_name(f.name) for f in df.schema.fields]
    if len(offsets) == 1:
        return placed.selectExpr(*names, f"{pos} AS {name}"), total
    # One row per file or stored partition.
    lookup = local_table(spark, offsets, f"{part} string, {before} long")
    if sum(len(p) + 40 for p, _ in offsets) <= LOOKUP_BYTES:
        lookup = F.broadcast(lookup)
    return placed.join(lookup, part).selectExpr(*names, f"{before} + {pos} AS {name}"), total


def plain_scan(df: DataFrame) -> bool:
    """True when every row of the plan is a row of a Parquet file and every row of the files is there."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return all(re.match(r"[\s:+-]*(Project |Relation .*\bparquet$)", line) for line in lines)


def _ties(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """What orders rows of equal keys: numbers and times, then a hash of the row, so no text becomes a sort key."""
    rest = [f for f in df.schema.fields if f.name not in order_by]
    short = [quoted(f.name) for f in rest if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    return [*short, F.xxhash64(*[quoted(f.name) for f in df.schema.fields if f.dataType.typeName() != "map"])]


def index_rows(df: DataFrame, order_by: Sequence[str] | None = None, num_lines: int = -1,
               parity: bool = False, order_temporal: bool = False) -> RowSet:
    """Number and encode the rows of ``df``; ``num_lines`` keeps the first rows of that order."""
    infos = column_infos(df.schema, order_temporal)
    raw = df.select(*[quoted(f.name).alias(value_name(k)) for k, f in enumerate(df.schema.fields)])
    position = {f.name: value_name(k) for k, f in enumerate(df.schema.fields)}
    keys = [position[c] for c in order_by] if order_by else None
    if num_lines > 0:
        # A true limit: tasks send their first rows only, and what is numbered is no larger.
        raw = (raw.orderBy(*keys, *_ties(raw, keys)) if keys else raw).limit(num_lines)
    rows, n = numbered(raw, keys)
    out = RowSet(rows, n, infos, parity)
    out.constant = _constant(out)
    return out


def _constant(rows: RowSet) -> dict[int, bool]:
    """Which columns hold one value.  A column that varies within a few rows needs no scan; the
    others are compared with the first row's value over the whole table, in one aggregate."""
    ids = [c.col_id for c in rows.columns]
    probe = rows.values(ids).limit(_PROBE_ROWS).collect() if ids else []
    flat = dict.fromkeys(ids, False)
    open_ids = [c for c in ids if probe and all(r[value_name(c)] == probe[0][value_name(c)] for r in probe)]
    if open_ids:
        tests = []
        for c in open_ids:
            value = rows.encoded(c)
            clean = f" AND NOT isnan(max({value}))" if rows.columns[c].type_class == REAL else ""
            tests.append(F.expr(f"min({value}) = max({value}){clean} AS k{c}"))
        got = rows.df.agg(*tests).first()
        flat.update({c: bool(got[f"k{c}"]) for c in open_ids})
    return flat


def is_unique(rows: RowSet, col_id: int) -> bool:
    """No two rows agree on the column (NaN agrees with nothing)."""
    values = rows.values([col_id])
    if rows.columns[col_id].type_class == REAL:
        values = values.where(f"NOT isnan({value_name(col_id)})")
    return values.groupBy(value_name(col_id)).agg(F.expr("count(1) AS n")).where("n > 1").isEmpty()
