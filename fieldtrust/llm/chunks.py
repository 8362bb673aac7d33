"""Texts packed into chunks, and the exchange of sorted keys between chunks and key ranges.

A chunk is a few megabytes of whole texts, compressed. What the texts of a chunk want to know about the whole corpus (how often
a word pair occurs, whether a passage occurs elsewhere) they ask once for each distinct 64-bit key: the sorted keys are cut
into ranges and shuffled, a range adds up what all chunks said, and the answers go back in the order of the keys asked.
Chunks and ranges have bounded sizes, so their number grows with the input and what a task holds does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import short_batches, written

CHUNK_BYTES = 8 << 20
RANGE_BYTES = 12 << 20
KINDS = "chunk long, raw long, ids array<long>, known binary, sizes array<long>, digests binary, data binary"
#: What stands for a null id in ``ids``, which so holds no nulls (pandas would make doubles of it); ``known`` tells it from a real one.
NO_ID = np.iinfo(np.int64).max


def pack(docs: DataFrame, name: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` as a written table of chunks; null texts are empty. ``known`` has a byte for each id, 0 where it is null; ``digests`` the SHA-256 of each text."""

    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        ids, parts, size, n = [], [], 0, 0

        def full() -> pa.RecordBatch:
            row = [first + n, size, [NO_ID if i is None else i for i in ids], bytes(i is not None for i in ids), [len(p) for p in parts], b"".join(hashlib.sha256(p).digest() for p in parts), squeeze(b"".join(parts))]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in KINDS.split(", ")])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = (t or "").encode("utf-8", "surrogatepass")
                if parts and size + len(p) > chunk_bytes:
                    yield full()
                    ids, parts, size, n = [], [], 0, n + 1
                ids.append(i)
                parts.append(p)
                size += len(p)
        if parts:
            yield full()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, KINDS), name)


def ids_of(row) -> list[int | None]:
    """The ids of a chunk's texts, None for null."""
    return [int(i) if k else None for i, k in zip(row.ids, row.known, strict=True)]


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def put(x: np.ndarray) -> bytes:
    """Integers of 64 bits by byte planes, so that equal high bytes cost nothing."""
    return squeeze(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()) if len(x) else b""


def got(data: bytes, kind=np.uint64) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1).T).tobytes(), kind)


def put_sorted(keys: np.ndarray) -> bytes:
    return put(np.diff(keys, prepend=np.uint64(0)))


def got_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(got(data), dtype=np.uint64)


def ranges_for(chunks: DataFrame, per_byte: float = 1.0) -> int:
    """How many key ranges the chunks need."""
    raw = chunks.agg(F.sum("raw")).first()[0] or 0
    return max(1, int(-(-raw * per_byte // RANGE_BYTES)))


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key; in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def runs(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the ranges that sorted keys lie in; ranges without a key cost nothing."""
    if not len(keys):
        return []
    own = range_of(keys, ranges)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def held_by_several(asked: DataFrame) -> DataFrame:
    """``asked(chunk, range, keys, many)`` to ``(chunk, range, payload)``: a bit for each key, whether another chunk asks for it too or ``many`` says that several texts of its own do."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()
        keys = [got_sorted(k) for k in pdf["keys"]]
        every = np.concatenate(keys)
        every.sort()
        twice = every[1:][every[1:] == every[:-1]]
        del every
        shared = np.unique(np.concatenate([twice, *(k[bits(m, len(k))] for m, k in zip(pdf["many"], keys, strict=True))]))
        packed = []
        for k in keys:
            at = np.minimum(np.searchsorted(shared, k), max(len(shared) - 1, 0))
            packed.append(np.packbits(shared[at] == k if len(shared) else np.zeros(len(k), bool)).tobytes())
        return pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "payload": packed})

    return asked.groupBy("range").applyInPandas(run, "chunk long, range long, payload binary")
