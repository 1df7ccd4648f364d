"""Many small rows as few large ones: 48-bit numbers and their documents in binary columns.

A *slice* is a run of neighbouring documents of one task, known by the number of its first
document. What it sends to a block travels as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from findlake.llm.grams import U64

Batches = Iterator[pa.RecordBatch]
LOW = U64((1 << 48) - 1)


def pack(values: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def runs(owner: np.ndarray, n: int) -> bytes:
    """How many entries each of ``n`` documents has."""
    counts = np.bincount(owner, minlength=n)
    return counts.astype(np.uint8 if not n or counts.max() < 256 else "<u4").tobytes()


def owners(data: bytes, n: int) -> np.ndarray:
    return np.repeat(np.arange(n), np.frombuffer(data, np.uint8 if len(data) == n else "<u4"))


_KINDS = ("<u1", "<u2", "<u4", "<i4", "<i8")


def thin(values: np.ndarray) -> bytes:
    """Integers in the narrowest kind that holds them all, which the first byte names."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    k = next(k for k, kind in enumerate(_KINDS) if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max)
    return bytes([k]) + values.astype(_KINDS[k]).tobytes()


def thick(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _KINDS[data[0]], offset=1).astype(np.int64)


def block_of(value: np.ndarray, number: int) -> np.ndarray:
    """Which of ``number`` blocks a 64-bit value lies in, by its top bits."""
    return (((value >> U64(48)) * U64(number)) >> U64(16)).astype(np.int64)


def slices_of(source: Batches, size: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of neighbouring documents, ``size`` characters or one document at a time."""
    ids, texts, total = [], [], 0
    for batch in source:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text)
            total += len(text or "") + 1
            if total >= size:
                yield ids, texts
                ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def groups_of(source: Batches) -> Iterator[list[dict]]:
    """Neighbouring rows that share their first column."""
    rows: list[dict] = []
    for batch in source:
        for row in batch.to_pylist():
            key = next(iter(row.values()))
            if rows and next(iter(rows[0].values())) != key:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows
