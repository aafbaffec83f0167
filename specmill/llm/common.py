"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one Arrow batch that are turned into Python objects at a time: bounds a task's
# memory for long texts without changing any result.
SLICE_BYTES = 8 << 20

# Bytes kept in a word after lower-casing A-Z: digits, letters and everything beyond ASCII.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 ``text`` after lower-casing A-Z; null has none."""
    return [] if text is None else text.translate(_WORD_BYTES).split()


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 ``text`` after lower-casing A-Z; null has none."""
    return [] if text is None else text.translate(_LOWER_BYTES).split()


def slices(batch: pa.RecordBatch, column: str):
    """Cuts of ``batch`` whose ``column`` holds about ``SLICE_BYTES`` at most, one row at least."""
    values = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(values: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    return values.cast(pa.binary() if pa.types.is_string(values.type) else pa.large_binary()).to_pylist()


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


# Bits of a key filter: 4 MB in all, whatever the number of keys.
FILTER_BITS = 25


def perhaps_in(rows: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` without those whose ``column`` is surely none of the ``keys`` (one column); some others stay.

    The keys set bits of a map of fixed size, in pieces of 4096 bytes, and the map is broadcast. A join that keeps
    few rows then shuffles few. With more keys than the map has room for it lets everything through and costs nothing but itself.
    """
    slot = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(1 << bits))
    pieces = keys.select(F.shiftright(slot, 15).alias("_piece"), (slot % 32768).alias("_bit")).distinct()
    pieces = pieces.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    own = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << bits))
    marked = rows.withColumns({"_piece": F.shiftright(own, 15), "_at": own % 32768}).join(F.broadcast(pieces), "_piece")
    byte = F.conv(F.hex(F.col("_map").substr((F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    place = F.expr("shiftleft(1, cast(_at % 8 AS int))")
    return marked.where(byte.bitwiseAND(place) != 0).select(*rows.columns)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(_packed, _text): ``text``, and all other columns in one struct, so that no name of theirs meets an operator's own."""
    others = [c for c in docs.columns if c != text]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)] or [F.lit(None).cast("int").alias("c0")]
    return docs.select(F.struct(*fields).alias("_packed"), F.col(f"`{text}`").alias("_text"))


def unpacked(columns: list[str], text: str, new: Column | None = None) -> list[Column]:
    """The ``columns`` that went into ``packed``, with ``new`` for the text."""
    others = [c for c in columns if c != text]
    own = F.col("_text") if new is None else new
    return [own.alias(c) if c == text else F.col(f"_packed.c{others.index(c)}").alias(c) for c in columns]


def share_of(rows: DataFrame, key: Column, wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of the ``total`` rows, chosen by a hash of ``key``; all of them where there are fewer."""
    if total <= wanted:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int(wanted / total * (1 << 30)))


def grouped(batches, keys: tuple[str, ...]):
    """Runs of rows with the same keys as dicts of lists; rows must come sorted by them."""
    current, columns = None, None
    for batch in batches:
        data = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        marks = list(zip(*(data[k] for k in keys)))
        start = 0
        for at in range(1, len(marks) + 1):
            if at < len(marks) and marks[at] == marks[start]:
                continue
            if marks[start] != current:
                if columns is not None:
                    yield columns
                current, columns = marks[start], {name: [] for name in data}
            for name in data:
                columns[name].extend(data[name][start:at])
            start = at
    if columns is not None:
        yield columns
