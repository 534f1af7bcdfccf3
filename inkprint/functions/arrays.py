"""Ragged, padded and sliced arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`. An expression mentioned inside the lambda of a higher-order function
    is evaluated again for every element; a lambda variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def truncate_rows(rows: Column, max_length: int) -> Column:
    """First `max_length` symbols of every post."""
    return F.transform(rows, lambda r: F.slice(r, 1, max_length))


def row_lengths(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.size(r))


def unflatten(values: Column, lens: Column) -> Column:
    """Cut a flat array back into rows of the given lengths. Every value is visited once: `slice` would copy the whole
    flat array again for each row."""
    offsets = F.aggregate(lens, F.array(F.lit(0)),
                          lambda acc, n: F.concat(acc, F.array((F.element_at(acc, -1) + n).cast("int"))))
    empty = F.array().cast("array<int>")

    def rows(flat: Column) -> Column:
        def row(n: Column, i: Column) -> Column:
            at = F.get(flat["offsets"], i)
            places = F.sequence(at, at + n - 1)
            return F.when(n > 0, F.transform(places, lambda j: F.get(flat["values"], j).cast("int"))).otherwise(empty)

        return F.transform(flat["lens"], row)

    return bind(F.struct(values.alias("values"), lens.alias("lens"), offsets.alias("offsets")), rows)


def pad_row(row: Column, length: int, fill: int = 0) -> Column:
    """Right-pad one row to exactly `length`; a longer row is an error."""
    padded = F.concat(row, F.array_repeat(F.lit(fill), F.lit(length) - F.size(row)))
    return F.when(F.size(row) > length, F.raise_error(F.lit(f"a row has more than {length} values"))).otherwise(padded)


def pad_rows(rows: Column, length: int, fill: int = 0) -> Column:
    return F.transform(rows, lambda r: pad_row(r, length, fill))


def slice_at(values: Column, start: Column, length: Column) -> Column:
    """Zero-based [start, start + length)."""
    return F.slice(values, start.cast("int") + 1, length.cast("int"))


def gather(values: Column, indices: Column) -> Column:
    """Elements at zero-based indices; an index outside gives null."""
    return F.transform(indices, lambda i: F.get(values, i.cast("int")))


def sequence_mask(length: Column, max_length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(max_length - 1)), lambda i: i < length)


def one_hot(index: Column, size: int) -> Column:
    """All zeros when the index is outside [0, size)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1).otherwise(0))


def packed(values: Column) -> Column:
    """Integers in [0, 65536) in two bytes each, the higher first: the bytes sort as the lists do."""

    def pack(row):
        found = np.asarray(row, np.int64)
        if len(found) and (found.min() < 0 or found.max() >= 1 << 16):
            raise ValueError("a packed integer must be in [0, 65536)")
        return found.astype(">u2").tobytes()

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(pack, na_action="ignore").astype(object)

    return run(values)


def unpacked(values: pa.BinaryArray) -> pa.ListArray:
    """The lists of integers that `packed` made, for use in Arrow batches."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    flat = np.frombuffer(b"".join(values.drop_null().to_pylist()), ">u2").astype(np.int32)
    ends = pa.array(np.r_[0, np.cumsum(sizes // 2)].astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(flat), mask=values.is_null() if values.null_count else None)


def joined(values: Column) -> Column:
    """Comma-joined text of an array."""
    return F.array_join(values.cast("array<string>"), ",")


def joined_rows(rows: Column) -> Column:
    """Text of a nested array: commas inside a row, semicolons between rows."""
    return F.array_join(F.transform(rows, lambda r: joined(r)), ";")
