"""Counts of hashes too many to hold: a count-min sketch merged from one sketch per task.

The sketch has `depth` rows of `cells` counters. A task adds its hashes to a sparse sketch of
its own and hands out the touched parts, compressed; parts of the same range of cells are
added up in one place, saturating at 255, so an estimate is never below the true count
(or below 255). What scoring needs of a merged counter, four bits or one, is then packed and
broadcast: its size follows the number of hashes up to a stated bound. Beyond the bound
estimates grow coarse, and never too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import words

#: cells of one transported part
PART = 1 << 18
#: hashes a task adds before it hands out what it has
HELD = 1 << 21
_TURN = np.uint64(0xD6E8FEB86659FD93)

Hashes = Callable[[pa.RecordBatch], np.ndarray]


@lru_cache(1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _encode(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending cells and their counts: gaps as bytes (255 adds up), counts above 1 apart."""
    gap = np.diff(at, prepend=0)
    more = gap // 255
    gaps = np.full(len(gap) + int(more.sum()), 255, np.uint8)
    gaps[np.cumsum(more + 1) - 1] = gap % 255
    many = np.flatnonzero(n > 1)
    body = b"".join([many.astype(np.uint32).tobytes(), np.minimum(n[many], 255).astype(np.uint8).tobytes(), gaps.tobytes()])
    return np.array([len(many), len(body)], np.uint32).tobytes() + _codec().compress(body, asbytes=True)


def _decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    many, size = np.frombuffer(blob[:8], np.uint32).tolist()
    body = _codec().decompress(blob[8:], size, asbytes=True)
    gaps = np.frombuffer(body, np.uint8, offset=5 * many)
    at = np.cumsum(gaps, dtype=np.int64)[gaps < 255]
    n = np.ones(len(at), np.uint8)
    n[np.frombuffer(body, np.uint32, many)] = np.frombuffer(body, np.uint8, many, 4 * many)
    return at, n


def cells_for(hashes: int, most: int) -> int:
    """Power of two of at least four cells per hash, PART to `most`."""
    return int(min(most, max(PART, 1 << (4 * max(hashes, 1) - 1).bit_length())))


def words_about(docs: DataFrame, text_col: str) -> int:
    """About the number of words of a column, from its size in bytes; only sizes the sketch."""
    found = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0]
    return (found or 0) // 6


def cell(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Cell of every hash in a row of the sketch."""
    turned = hashes if row == 0 else words.mix(hashes + _TURN * np.uint64(row))
    return (turned & np.uint64(cells - 1)).astype(np.int64)


def sketch(docs: DataFrame, hashes: Hashes, depth: int, cells: int, pack: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Merged and packed sketch: depth * cells counters through `pack`, as one array of bytes.

    docs: the columns that `hashes` takes from a batch. `pack` maps PART counters (uint8) to
    bytes, the same number for every part, and zeros to zeros.
    """
    per_row = cells // PART
    width = len(pack(np.zeros(PART, np.uint8)))

    def local(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        value = np.concatenate(held)
        for row in range(depth):
            at = cell(value, row, cells).astype(np.uint32)  # cells are 2**32 at most
            at.sort()
            first = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint32(1)))
            n = np.diff(np.append(first, len(at)))
            at = at[first]
            cuts = np.searchsorted(at, (np.arange(per_row + 1) * PART).astype(np.uint64))
            ids, blobs = [], []
            for k in range(per_row):
                a, b = cuts[k], cuts[k + 1]
                if b > a:
                    ids.append(row * per_row + k)
                    blobs.append(_encode(at[a:b].astype(np.int64) - k * PART, n[a:b]))
                if ids and (k == per_row - 1 or len(ids) == 64):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "cells"])
                    ids, blobs = [], []

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in words.pieces(batch, "text"):
                held.append(hashes(part))
                n += len(held[-1])
                if n >= HELD:
                    yield from local(held)
                    held, n = [], 0
        if n:
            yield from local(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the parts in a partition, one counter array each: bounded by the sketch's own size."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = _decode(blob.as_py())
                held = total.setdefault(k, np.zeros(PART, np.uint8))
                held[at] += np.minimum(n, 255 - held[at])
        for k, v in total.items():
            packed = _codec().compress(pack(v), asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names=["part", "cells"])

    parts = docs.mapInArrow(gather, "part int, cells binary")
    merged = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").mapInArrow(merge, "part int, cells binary")
    out = np.zeros((depth * per_row, width), np.uint8)
    for r in merged.toLocalIterator():  # depth * cells counters in all, whatever the input
        out[r["part"]] = np.frombuffer(_codec().decompress(bytes(r["cells"]), width), np.uint8)
    return out.reshape(depth, per_row * width)


def repeated_bits(counters: np.ndarray) -> np.ndarray:
    """One bit a counter: 2 or more."""
    return np.packbits(counters > 1, bitorder="little")


def level_nibbles(counters: np.ndarray) -> np.ndarray:
    """Four bits a counter: 0, 1, 2, then a level for every further factor of 1.5."""
    levels = np.concatenate([[0, 1], 2 + np.floor(np.log(np.arange(2, 256) / 2) / np.log(1.5))]).astype(np.uint8)
    found = np.minimum(levels, 15)[counters]
    return found[::2] | (found[1::2] << 4)


def maybe_repeated(packed: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    """Whether the estimate of each hash is 2 or more, from `repeated_bits`."""
    out = np.ones(len(hashes), bool)
    for row in range(len(packed)):
        at = cell(hashes, row, cells)
        out &= (packed[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def level(packed: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    """Smallest level over the rows, from `level_nibbles`."""
    out = np.full(len(hashes), 15, np.uint8)
    for row in range(len(packed)):
        at = cell(hashes, row, cells)
        out = np.minimum(out, (packed[row][at >> 1] >> (4 * (at & 1)).astype(np.uint8)) & 15)
    return out
