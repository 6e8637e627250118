"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A vocabulary file is read, never trained. Its pieces are put in a double-array trie over UTF-8
bytes, the white-space marker as the space it stands for. A text gets one space in front; the
encoding is the sequence of pieces with the largest sum of log scores. A character that is no
piece becomes its byte pieces, at `UNKNOWN` below the smallest score. Of equal sums the path
whose last piece starts first wins, at every position. A unigram vocabulary has log scores; for
one that was made by merges, the log of a Zipf law over the order of its pieces takes their place.

No piece holds a space behind another character, so texts are cut before every run of spaces
(and around line ends, where no longer piece holds one), and the distinct cuts of a batch are
solved side by side, a step of numpy for all of them.

Decoding joins the pieces' bytes and takes the first space away: the exact text, also where it
holds the marker's own character (by its bytes). Null text: null. Empty text: no pieces. Control
and unknown ids decode to nothing. Bytes that are no UTF-8 decode to the replacement character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from runlens.llm import words

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN = 10.0
#: solved cuts a task remembers, at most
REMEMBERED = 400_000
_NORMAL, _USER, _BYTE, _UNIGRAM = 1, 4, 6, 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """Pieces as bytes, log scores, kinds; the trie: base, parent and piece by node."""

    texts: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    parent: np.ndarray
    piece: np.ndarray
    cut_lines: bool

    @property
    def unknown(self) -> float:
        return float(self.scores[self.kinds == _NORMAL].min()) - UNKNOWN


def _double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, parent and piece: the child of node n by byte b is base[n] + b if its parent is n."""
    order = sorted(keys)
    base, parent, piece = [0], [-1], [-1]

    def grow(n: int) -> None:
        more = max(0, n - len(base))
        base.extend([0] * more)
        parent.extend([-1] * more)
        piece.extend([-1] * more)

    parent[0] = -2
    free = 257  # any byte's child can stand from here on
    stack = [(0, 0, len(order), 0)]
    while stack:
        node, lo, hi, depth = stack.pop()
        if len(order[lo]) == depth:
            piece[node] = keys[order[lo]]
            lo += 1
        groups: list[tuple[int, int, int]] = []
        while lo < hi:
            b, end = order[lo][depth], lo + 1
            while end < hi and order[end][depth] == b:
                end += 1
            groups.append((b, lo, end))
            lo = end
        if not groups:
            continue
        while free < len(parent) and parent[free] != -1:
            free += 1
        at, tries = free - groups[0][0], 0
        grow(at + 257)
        while not all(parent[at + b] == -1 for b, _, _ in groups):
            # after some tries a fresh range: a few per cent more cells, linear time
            tries += 1
            at = at + 1 if tries < 64 else len(base)
            grow(at + 257)
        base[node] = at
        for b, a, z in groups:
            parent[at + b] = node
            stack.append((at + b, a, z, depth + 1))
    grow(len(base) + 257)
    return np.array(base, np.int32), np.array(parent, np.int32), np.array(piece, np.int32)


def build(texts: list[str], scores: np.ndarray, kinds: np.ndarray) -> Vocabulary:
    """kinds: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte."""
    raw = [t.replace(MARKER, " ").encode() for t in texts]
    byte_ids = np.full(256, -1, np.int32)
    keys: dict[bytes, int] = {}
    for i, (text, kind) in enumerate(zip(texts, kinds.tolist(), strict=True)):
        if kind == _BYTE:
            byte_ids[int(text[3:5], 16)] = i
            raw[i] = bytes([int(text[3:5], 16)])
        elif kind in (_NORMAL, _USER) and raw[i]:
            if b" " in raw[i].lstrip(b" "):
                raise ValueError(f"piece {i} holds a space behind another character")
            keys.setdefault(raw[i], i)
        else:
            raw[i] = b""
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces")
    cut = not any(b"\n" in k and len(k) > 1 for k in keys)
    return Vocabulary(raw, np.asarray(scores, float), kinds, byte_ids, *_double_array(keys), cut)


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read a SentencePiece model file (on the driver; tasks get the arrays)."""
    texts, scores, kinds, trained = [], [], [], _UNIGRAM
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                own = dict(_fields(value))
                texts.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                trained = dict(_fields(value)).get(3, _UNIGRAM)
    kind, score = np.array(kinds), np.array(scores)
    if trained != _UNIGRAM:
        normal = np.flatnonzero(np.isin(kind, (_NORMAL, _USER)))
        rank = np.arange(1, len(normal) + 1)
        score[normal] = -np.log(rank) - np.log((1 / rank).sum())
    return build(texts, score, kind)


def _solve(cuts: np.ndarray, size: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of all rows of `cuts` (padded bytes; `size` bytes each): ids, number by row."""
    n, width = cuts.shape
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    last, came = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
    padded = np.pad(cuts, ((0, 0), (0, 1)))
    rows = np.arange(n)
    for s in range(width):
        lead = (padded[:, s] & 0xC0) != 0x80
        live = rows[lead & (size > s) & (best[:, s] > -np.inf)]
        if not len(live):
            continue
        first = padded[live, s]
        long = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
        known = np.zeros(len(live), bool)
        node, at, held = np.zeros(len(live), np.int32), np.arange(len(live)), live
        for e in range(s, width):
            child = v.base[node] + padded[held, e]
            ok = (v.parent[child] == node) & (size[held] > e)
            at, node, held = at[ok], child[ok], held[ok]
            if not len(held):
                break
            piece = v.piece[node]
            full = piece >= 0
            known[at[full & (long[at] == e + 1 - s)]] = True
            total = best[held, s] + v.scores[piece]
            win = full & (total > best[held, e + 1])
            w = held[win]
            best[w, e + 1], last[w, e + 1], came[w, e + 1] = total[win], piece[win], s
        # a character that is no piece: its bytes, all at one price
        r, long = live[~known], long[~known]
        price = best[r, s] + v.unknown
        win = price > best[r, s + long]
        r, long, price = r[win], long[win], price[win]
        for k in range(4):
            some = long > k
            if not some.any():
                break
            best[r[some], s + k + 1] = price[some]
            last[r[some], s + k + 1] = v.byte_ids[padded[r[some], s + k]]
            came[r[some], s + k + 1] = s + k
    # walk back, all rows at once; ids come out last first
    where, steps = size.astype(np.int64).copy(), []
    live = rows[size > 0]
    while len(live):
        steps.append((live, last[live, where[live]]))
        where[live] = came[live, where[live]]
        live = live[where[live] > 0]
    number = np.bincount(np.concatenate([r for r, _ in steps]), minlength=n) if steps else np.zeros(n, np.int64)
    end = np.cumsum(number)
    out = np.empty(int(end[-1]) if n else 0, np.int32)
    for k, (r, ids) in enumerate(steps):
        out[end[r] - 1 - k] = ids
    return out, number


class Encoder:
    """Encodes batches of texts and remembers the cuts it has solved."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of every cut, and of it those of each text."""
        space = data == 32
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        begin[1:-1] |= space[1:] & ~space[:-1]
        if self.v.cut_lines:
            line = np.flatnonzero(data == 10)
            begin[line] = True
            begin[line + 1] = True
        begin[len(data)] = False
        start = np.flatnonzero(begin)
        return start, np.searchsorted(start, offsets)

    def _learn(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        order = np.argsort(size, kind="stable")
        ids, numbers = [], []
        at = 0
        while at < len(order):
            # rows of similar size, with about a million cells at a time
            width = int(size[order[at]])
            stop = min(len(order), at + max(1, 1_000_000 // (width + 1)))
            if stop - at > 1:
                stop = at + max(1, int(np.searchsorted(size[order[at:stop]], 1.25 * width + 4, "right")))
            own = order[at:stop]
            top = int(size[own[-1]])
            place = start[own][:, None] + np.arange(top)
            rows = np.where(np.arange(top) < size[own][:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)
            found, number = _solve(rows, size[own], self.v)
            ids.append(found)
            numbers.append(number)
            at = stop
        if not ids:
            return
        number = np.concatenate(numbers)
        begin = np.cumsum(number) - number + len(self.pool)
        self.pool = np.concatenate([self.pool, *ids])
        all_hashes = np.concatenate([self.hashes, hashes[order]])
        by = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[by]
        self.start = np.concatenate([self.start, begin])[by]
        self.number = np.concatenate([self.number, number])[by]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the end of each text's ids."""
        data, offsets = words.buffers(pa.array([f" {t}" if t else "" for t in texts], pa.large_string()))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        start, first = self._cuts(data, offsets)
        size = np.diff(np.append(start, len(data)))
        hashes = words.range_hashes(data, start, size)
        own, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.__init__(self.v)
        at = np.minimum(np.searchsorted(self.hashes, own), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != own if len(self.hashes) else np.ones(len(own), bool)
        self._learn(own[new], start[where[new]], size[where[new]], data)
        at = np.searchsorted(self.hashes, own)[which]
        number = self.number[at]
        end = np.cumsum(number)
        place = np.arange(int(end[-1])) - np.repeat(end - number - self.start[at], number)
        ends = np.concatenate([[0], end])[first[1:]]
        return self.pool[place], ends


def decode(ids: np.ndarray, ends: np.ndarray, v: Vocabulary) -> list[bytes]:
    """Bytes of every sequence of ids; sequence i ends at ends[i]."""
    size = np.array([len(t) for t in v.texts])
    pool = np.frombuffer(b"".join(v.texts), np.uint8)
    begin = np.cumsum(size) - size
    ids = ids[(ids >= 0) & (ids < len(size))] if len(ids) and ((ids < 0) | (ids >= len(size))).any() else ids
    end = np.cumsum(size[ids])
    place = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size[ids] - begin[ids], size[ids])
    data = pool[place].tobytes()
    stops = np.concatenate([[0], end])[ends].tolist()
    return [data[a:b][1:] if data[a : a + 1] == b" " else data[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, `ids` (null for null text) and `decoded`, the text that the ids give back."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in words.pieces(batch, "text"):
                texts = part.column(1).to_pylist()
                ids, ends = encoder.encode(texts)
                back = [
                    None if t is None else b.decode(errors="replace")
                    for t, b in zip(texts, decode(ids, ends, shared.value), strict=True)
                ]
                at = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(at, pa.array(ids)), pa.array(back, pa.string())],
                    names=["id", "ids", "decoded"],
                )

    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def add_pieces(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """`docs` with the ids of every text in `ids_col`, and the text that they give back in `text_col`.

    An input column called `ids_col` is replaced.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != ids_col.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in words.pieces(batch, text_col):
                texts = part.column(place).to_pylist()
                ids, ends = encoder.encode(texts)
                back = [
                    None if t is None else b.decode(errors="replace")
                    for t, b in zip(texts, decode(ids, ends, shared.value), strict=True)
                ]
                at = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                columns = [*part.columns, pa.ListArray.from_arrays(at, pa.array(ids))]
                columns[place] = pa.array(back, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, ids_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))
