"""Exact removal of repeated passages, behind a count-min prefilter.

A window is `size` consecutive words of one text. It is counted by its smallest gram, the run of
2/5 of its words with the smallest hash: equal windows have equal grams at different places, and
neighbouring windows mostly share one, so a seventh of the grams stands for all windows. Pass
one counts these grams in a sketch merged from one sketch per task (see `counts`); the estimate
of a window is never too low. Pass two keeps the windows whose estimate is 2 or more. A task settles repeats among its own windows at
once (all but its first are removed, sent as runs) and sends on only its first occurrence of a
window, so a passage in a third of all texts is at most one row a task. What is sent is grouped
exactly by 95 bits of hash; all but the first by (id, place) are removed. The rows of the
result carry the places of windows to cut, joined to the texts once.

Null or empty text: no words. Rows with a null id sort first, each by itself, in the order of the
input. Rows that share an id are taken for copies of one row: none of them is earlier than the other. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm import counts, words
from runlens.llm.tables import with_row_key

SIZE = 20
DEPTH = 2
#: bits a row of the broadcast sketch at most: DEPTH * MOST_CELLS / 8 bytes in all
MOST_CELLS = 1 << 28


def _split(batch: pa.RecordBatch) -> words.Words:
    return words.split_words(*words.buffers(batch.column(batch.schema.get_field_index("text"))))


def _gram(size: int) -> int:
    """Words of the grams that stand for windows in the sketch: about a seventh of all grams do."""
    return max(1, 2 * size // 5)


def _grams(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Hashes of the grams that stand for the windows of a batch, once for every place."""
    split = _split(batch)
    _, at, value = words.window_grams(split.hashes, split.first, size, _gram(size))
    return value[np.unique(at)]


def _spans(places: np.ndarray) -> np.ndarray:
    """Ascending places as flat (first, last) runs."""
    gap = np.flatnonzero(np.diff(places) > 1)
    first = np.append(places[:1], places[gap + 1])
    last = np.append(places[gap], places[-1:])
    return np.column_stack([first, last]).ravel()


def candidates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """h, g, id, place: windows that may repeat elsewhere; spans: repeats settled inside a task."""
    cells = counts.cells_for(counts.words_about(docs, "text") // (1 + (size - _gram(size)) // 2), MOST_CELLS)
    packed = counts.sketch(docs.select("text"), lambda b: _grams(b, size), DEPTH, cells, counts.repeated_bits)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, g, ids, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, ids, g, h))
        h, g, ids, place = h[order], g[order], ids[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (ids != ids[lead]) | (place != place[lead])
        keep = ~again
        n = int(keep.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(h[keep].view(np.int64)), pa.array(g[keep]), pa.array(ids[keep]), pa.array(place[keep].astype(np.int32)), pa.nulls(n, pa.list_(pa.int32())),
            ],
            names=["h", "g", "id", "place", "spans"],
        )
        ids, place = ids[again], place[again]
        order = np.lexsort((place, ids))
        ids, place = ids[order], place[order]
        cuts = np.append(np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)), len(ids)) if len(ids) else [0]
        out = [(int(ids[a]), _spans(place[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        if out:
            nothing = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    nothing, nothing.cast(pa.int32()), pa.array([i for i, _ in out], pa.int64()),
                    nothing.cast(pa.int32()), pa.array([s.astype(np.int32) for _, s in out], pa.list_(pa.int32())),
                ],
                names=["h", "g", "id", "place", "spans"],
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in words.pieces(batch, "text"):
                split = _split(part)
                starts, at, value = words.window_grams(split.hashes, split.first, size, _gram(size))
                places, which = np.unique(at, return_inverse=True)
                starts = starts[counts.maybe_repeated(shared.value, value[places], cells)[which]]
                text = np.searchsorted(split.first, starts, "right") - 1
                ids = np.asarray(part.column(0), np.int64)
                h, g = words.run_hashes(split.hashes, starts, size)
                held.append((h, g, ids[text], starts - split.first[text]))
                n += len(starts)
                if n >= counts.HELD:
                    yield from settle(held)
                    held, n = [], 0
        if n:
            yield from settle(held)

    return docs.mapInArrow(scan, "h bigint, g int, id bigint, place int, spans array<int>")


def repeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """id and `spans`: flat runs (first, last) of places whose windows start earlier elsewhere."""
    found = candidates(docs, size)
    order = Window.partitionBy("h", "g").orderBy("id", "place")
    # rows with spans only pass through: their key is their id
    keyed = found.selectExpr("coalesce(h, id) as h", "coalesce(g, -1) as g", "id", "place", "spans")
    again = keyed.withColumn("rank", F.rank().over(order)).where("rank > 1 or spans is not null")
    return again.groupBy("id").agg(
        F.expr("concat(flatten(collect_list(spans)), flatten(collect_list(if(spans is null, array(place, place), null)))) as spans")
    )


def remove_repeated(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `n_words`, `n_removed` and `kept`, the words left."""
    named = docs.selectExpr(f"cast(`{id_col}` as bigint) as own", f"`{text_col}` as text")
    keyed = with_row_key(named, "own", "id")
    texts = words.pack_texts(keyed, "own")
    both = texts.join(repeated(keyed.select("id", "text"), size), "id", "left").select("own", "size", "packed", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.small_batches(batch, ["size"]):
                total, gone, kept = [], [], []
                for size_of, packed, spans in zip(*part.columns[1:], strict=True):
                    own = words.unpack_text(size_of.as_py(), packed.as_py()).split()
                    total.append(len(own))
                    if spans.is_valid:
                        runs = np.asarray(spans.values).reshape(-1, 2)
                        step = np.zeros(len(own) + 1, np.int64)
                        np.add.at(step, runs[:, 0], 1)
                        np.add.at(step, runs[:, 1] + size, -1)
                        own = [own[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
                    gone.append(total[-1] - len(own))
                    kept.append(b" ".join(own).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    names=["id", "n_words", "n_removed", "kept"],
                )

    out = both.mapInArrow(apply, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id_col)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
