"""Whole groups of sorted rows within a task, taken up a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Batches of whole groups, each with the rising numbers of its rows' groups.

    The rows of a partition come sorted by their first ``keys`` columns.  A batch holds about ``most`` rows, more only where
    a single group does.
    """
    held, n, wanted = [], 0, most
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < wanted:
            continue
        rows = pa.concat_batches(held)
        group = _numbers(rows, keys)
        cut = int(np.searchsorted(group, group[-1]))             # the last group may go on
        if cut:
            yield group[:cut], rows.slice(0, cut)
        rest = rows.slice(cut)
        held, n, wanted = [rest.take(pa.array(np.arange(len(rest))))], len(rest), max(most, 2 * len(rest))
        del rows
    if n:
        rows = pa.concat_batches(held)
        yield _numbers(rows, keys), rows


def _numbers(rows: pa.RecordBatch, keys: int) -> np.ndarray:
    new = np.zeros(len(rows), dtype=np.int64)
    for k in range(keys):
        code = codes(rows.column(k))
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are; a null is a value."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def bounds(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row where its group begins and ends."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(first, len(group)))
    return np.repeat(first, sizes), np.repeat(first + sizes, sizes)
