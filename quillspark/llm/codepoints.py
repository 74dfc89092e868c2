"""Arrow text as one flat array of code points, and back.

Each text is preceded by a separator (U+0000), so that a look at a neighbouring position never
reaches into another text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEP = 0


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a separator, and the offset at which each begins."""
    joined = "\0" + "\0".join(texts) + "\0"
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) + 1 if len(texts) else np.zeros(0, np.int64)
    return flat, starts


def flatten_arrow(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same from an Arrow array of strings, by its buffers: one conversion for the whole array, none per row.
    A null is an empty text. U+0000 inside a text becomes U+FFFD."""
    rows = len(texts)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64) if rows else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # A code point begins at every byte that continues none.
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    bounds = before[at - at[0]]
    starts = bounds[:-1] + np.arange(1, rows + 1)
    flat = np.zeros(len(points) + rows + 1, dtype=np.uint32)
    flat[np.arange(len(points)) + np.repeat(np.arange(1, rows + 1), np.diff(bounds))] = np.where(points == SEP, np.uint32(0xFFFD), points)
    return flat, starts


def unflatten_arrow(flat: np.ndarray) -> pa.Array:
    """An Arrow array of the texts between the separators of a flat array."""
    bounds = np.flatnonzero(flat == SEP)
    inside = flat != SEP
    size = np.where(flat < 0x80, 1, np.where(flat < 0x800, 2, np.where(flat < 0x10000, 3, 4))) * inside
    total = np.concatenate(([0], np.cumsum(size)))
    data = flat[inside].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    offsets = np.append(total[bounds[:-1]], total[-1]) if len(bounds) > 1 else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data))


def unflatten(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The text between each start and end."""
    whole = flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def expand(flat: np.ndarray, table: "Expansions") -> np.ndarray:
    """Replace every code point that the table holds by its expansion."""
    slot = table.slot_of(flat)
    at = np.flatnonzero(slot >= 0)
    if not len(at):
        return flat
    slot = slot[at]
    length = table.length[slot]
    repeats = np.ones(len(flat), dtype=np.int64)
    repeats[at] = length
    out = np.repeat(flat, repeats)
    to = at + np.cumsum(length - 1) - (length - 1)
    for j in range(int(length.max())):
        more = length > j
        out[to[more] + j] = table.values[table.offset[slot[more]] + j]
    return out


class Expansions:
    """Lookup from a code point to a sequence of code points (possibly empty)."""

    def __init__(self, mapping: dict[int, tuple[int, ...]]):
        keys = sorted(mapping)
        self.keys = np.array(keys, dtype=np.uint32)
        self.length = np.array([len(mapping[k]) for k in keys] or [1], dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.values = np.array([v for k in keys for v in mapping[k]] or [0], dtype=np.uint32)
        self._slot = np.full((keys[-1] if keys else 0) + 2, -1, dtype=np.int32)
        self._slot[self.keys] = np.arange(len(keys))

    def slot_of(self, flat: np.ndarray) -> np.ndarray:
        return self._slot[np.minimum(flat, len(self._slot) - 1)]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
