"""Helpers for Arrow batch functions over text and id lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text (or list entries) handled at once.
BLOCK = 1 << 20


def blocks(batches, col: str, most: int = BLOCK, rows: int | None = None):
    """Slices of the batches with about ``most`` bytes of the string column
    (or entries of the list column) ``col``, one row at least and ``rows`` at most."""
    for b in batches:
        c = b.column(col)
        size = pc.binary_length(c) if pa.types.is_string(c.type) else pc.list_value_length(c)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(int(np.searchsorted(ends, base + most, side="right")), at + (rows or b.num_rows)))
            yield b.slice(at, to - at)
            at = to


def letters(col: pa.Array):
    """(bytes, start of each letter and the end, first letter of each row and
    the end, code point of each letter); a null row has no letters."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8))[offs[0]:offs[-1]]
    offs = offs - offs[0]
    start = np.flatnonzero((data & 0xC0) != 0x80)
    points = data if len(start) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return data, np.append(start, len(data)), np.searchsorted(start, offs), points.astype(np.int64)


def string_lists(data, start, at, size, bounds, null=None) -> pa.Array:
    """Lists of strings: entry j has ``size[j]`` letters from letter ``at[j]``;
    row i has the entries bounds[i] to bounds[i + 1]."""
    begin, end = start[at], start[at + size]
    ends = np.append(0, np.cumsum(end - begin))
    pick = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], end - begin)
    values = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[pick]))
    return lists(values, bounds, null)


def lists(values, bounds, null=None) -> pa.Array:
    """Lists with the entries bounds[i] to bounds[i + 1]; null where ``null``."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=mask)


def list_values(col) -> tuple[np.ndarray, np.ndarray]:
    """(entries, bounds) of a list column without null entries; a null list is empty."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(col).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size, dtype=np.int64))


def joined(col, sep: str = ",") -> pa.Array:
    """Each list's entries as one text; a null list gives null."""
    return pc.binary_join(pa.ListArray.from_arrays(col.offsets, col.values.cast(pa.string()), mask=col.is_null()) if col.null_count
                          else pa.ListArray.from_arrays(col.offsets, col.values.cast(pa.string())), sep)
