"""Words of Arrow string columns as numpy arrays, without a Python object per word.

A batch of texts is one buffer of UTF-8 bytes. A table of 256 entries says which bytes
belong to words; words are the maximal runs of such bytes inside one text. A word's 64-bit
hash is a polynomial in random values of its bytes, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: bytes between words: space and 0x09-0x0D
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NOT_BLANK = ~BLANKS
#: letters: ASCII letters and every byte of a code point above 127
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SAME = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, other bytes as they are
LOWER = SAME.copy()
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = _BACK = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (a finaliser of two multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(2 * n, _BASE)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def _inverses(n: int) -> np.ndarray:
    global _BACK
    if len(_BACK) < n:
        grown = np.full(2 * n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        grown[0] = 1
        _BACK = np.multiply.accumulate(grown)
    return _BACK


_powers(1024)


@dataclass
class Words:
    """hashes, start, end: by word (byte positions in `data`); first: by text, words [first[i], first[i+1])."""

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is the empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_BLANK, fold: np.ndarray = SAME
) -> Words:
    n = len(data)
    mask = np.zeros(n + 2, bool)
    mask[1:-1] = inside[data]
    border = mask[1:] != mask[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a word ends with its text
    start = np.flatnonzero((border | edge) & mask[1:])
    end = np.flatnonzero((border | edge) & mask[:-1])
    if len(start):
        size = end - start
        held = np.flatnonzero(mask[1:-1])  # positions of word bytes, word by word
        begin = np.cumsum(size) - size
        place = np.arange(len(held)) - np.repeat(begin, size)
        terms = _VALUES[fold[data[held]]] * _powers(int(size.max()) + 1)[place]
        hashes = mix(np.add.reduceat(terms, begin) + size.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, offsets, hashes, start, end, np.searchsorted(start, offsets))


def pieces(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; one long text is one slice."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def runs(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words inside a text, the text's number, and the place in it.

    The hash is the polynomial of the k word hashes, from running sums and the inverse power.
    """
    n = len(hashes)
    if n < k:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    m = n - k + 1
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(text[:m] == text[k - 1 :])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(n)[:n], out=sums[1:])
    total = (sums[starts + k] - sums[starts]) * _inverses(n)[starts]
    return mix(total), text[starts], starts - first[text[starts]]


def run_hashes(hashes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of the k words from every start (positions in `hashes`), and 31 that don't derive from them."""
    n = len(hashes)
    out = []
    for values in (hashes, mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F))):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(n)[:n], out=sums[1:])
        out.append(mix((sums[starts + k] - sums[starts]) * _inverses(n)[starts]))
    return out[0], (out[1] >> np.uint64(33)).astype(np.int32)


def prefixes(w: Words, sizes: range, fold: np.ndarray = SAME) -> np.ndarray:
    """Hash of the first k bytes of every word longer than that, for each k in `sizes`; else 0."""
    total = np.zeros(len(w.start), np.uint64)
    out = np.zeros((len(w.start), len(sizes)), np.uint64)
    long = np.arange(len(w.start))
    for k in range(sizes.stop):
        if k in sizes:
            long = long[w.end[long] - w.start[long] > k]
            out[long, k - sizes.start] = mix(total[long] + np.uint64(k))
        at = np.minimum(w.start[long] + k, len(w.data) - 1)
        total[long] += _VALUES[fold[w.data[at]]] * _POWERS[k]
    return out


def pack_texts(rows: DataFrame, also: str | None = None) -> DataFrame:
    """id, text as id, size, packed: texts compressed one by one, for a shuffle that carries them.

    also: a bigint column that goes along, as `own`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [t.encode() if t is not None else None for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                        pa.array([t and codec.compress(t, asbytes=True) for t in texts], pa.binary()), part.column(2),
                    ],
                    names=["id", "size", "packed", "own"],
                )

    packed = rows.selectExpr("id", "text", f"`{also or 'id'}` as own").mapInArrow(run, "id bigint, size bigint, packed binary, own bigint")
    return packed if also else packed.drop("own")


def unpack_text(size: int | None, packed: bytes | None) -> bytes:
    """The bytes of a packed text; null is the empty text."""
    return pa.Codec("zstd", 1).decompress(packed, size, asbytes=True) if packed else b""


def small_batches(batch: pa.RecordBatch, sizes: list[str], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which the columns `sizes` add up to about `limit`."""
    total = sum(np.asarray(pc.fill_null(batch.column(c), 0)) for c in sizes)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(total) // limit)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def range_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of every range of bytes; the ranges stand side by side and cover `data` from start[0] on."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(start[0], len(data)) - np.repeat(start, size)
    terms = _VALUES[data[start[0] :]] * _powers(int(size.max()) + 1)[place]
    return mix(np.add.reduceat(terms, start - start[0]) + size.astype(np.uint64))


def window_grams(hashes: np.ndarray, first: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `size` words inside a text: its first word, and its smallest gram.

    Returns the windows' starts (positions in `hashes`), the positions of the grams and their
    hashes. A window's gram is the leftmost of those with the smallest hash among its runs of
    `gram` words: equal windows have equal grams at equal places in them.
    """
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = n - gram + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(n)[:n], out=sums[1:])
    value = mix((sums[gram:] - sums[:m]) * _inverses(n)[:m])
    at, span, width = np.arange(m), 1, size - gram + 1

    def lesser(shift: int) -> np.ndarray:
        a, b = at[: len(at) - shift], at[shift:]
        return np.where(value[b] < value[a], b, a)

    while 2 * span <= width:
        at, span = lesser(span), 2 * span
    if span < width:
        at = lesser(width - span)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    return starts, at[starts], value
