"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits, lower-cased, hashed to `BUCKETS` terms. Term weights are
inverse document frequencies over all documents; terms in more than `STOP` of them weigh 0. A
latent space is fitted by a randomised singular value decomposition of the benchmark's items and of
all passages of all documents, which together weigh as much: tasks add their passages up in a
sketch of `SKETCH` rows by random signs, Spark adds up the sketches, and the leading singular vectors
are taken of the items and the sketch. Its rank exceeds the number of items searched at once.

Every document is cut into overlapping passages of 2 * `STRIDE` words. A passage is checked if its
cosine with an item's latent image is `NEAR` or more, or if it holds, of any run of up to `STRIDE`
words of the item, as many words as a copy needs (stop words count): by the second way no copy is
lost by its item's length or terms. The check: the longest common subsequence of the
item's words and the passage with its surroundings must hold `LCS` of the item's words, or
`PARAPHRASE` of them and, where the cosine is near, `ANSWER` of the words of the item's last
sentence (its answer).
Retrieval and check run in one pass over the texts; nothing but hits is shuffled.

The benchmark is a query set: it goes to the driver in blocks of `ITEMS` items (one pass over
the documents each), whatever their number. Null or empty texts and items hit nothing. Items with
fewer than `LEAST` words are found only whole, at any length. Repeated items or rows give repeated hits, merged
by (id, item). Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import words

BUCKETS = 1 << 14
STRIDE = 32
STOP = 0.1
ITEMS = 256
EXTRA_RANK = 24
#: rows of the sketch of all passages, whatever their number
SKETCH = 128
NEAR = 0.3
LCS = 0.7
PARAPHRASE = 0.55
ANSWER = 0.8
LEAST = 8
#: bytes of the table of a block of items' runs; of more, the runs' words are looked up one by one
TABLE = 1 << 25

_TERM = words.LETTERS.copy()
_TERM[48:58] = True


def _split(column: pa.Array) -> tuple[words.Words, np.ndarray]:
    w = words.split_words(*words.buffers(column), inside=_TERM, fold=words.LOWER)
    return w, (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def corpus_statistics(docs: DataFrame) -> tuple[np.ndarray, int, np.ndarray]:
    """Documents by term, their number, and the sketch of all passages, over all rows (`id`, `text`).

    A passage of 2 * STRIDE words is a unit row of the terms that it holds. The sketch has SKETCH
    rows: the sums of the passages that hash to them, each with a random sign.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sketch = np.zeros(BUCKETS + 1, np.int64), np.zeros(SKETCH * BUCKETS)
        for batch in batches:
            for part in words.pieces(batch, "text"):
                w, term = _split(part.column(1))
                total[BUCKETS] += len(part)
                if not len(term):
                    continue
                row, text, place = _blocks(w, 2 * STRIDE)
                key = np.unique(row * BUCKETS + term)
                held, term = key // BUCKETS, key % BUCKETS
                total[:BUCKETS] += np.bincount(np.unique(text[held] * BUCKETS + term) % BUCKETS, minlength=BUCKETS)
                # copies in rows of their own are passages of their own: the id counts
                own = np.asarray(part.column(0).fill_null(0)).astype(np.int64).view(np.uint64)[text]
                content = np.add.reduceat(w.hashes, np.flatnonzero(np.diff(row, prepend=-1)))
                at = words.mix(own ^ words.mix(content + place.astype(np.uint64)))
                sign = np.where(at >> np.uint64(63), 1.0, -1.0) / np.sqrt(np.bincount(held))
                cell = (at % np.uint64(SKETCH)).astype(np.int64) * BUCKETS
                np.add.at(sketch, cell[held] + term, sign[held])
        yield _vector(-1, total)
        for k in range(SKETCH):
            yield _vector(k, sketch[k * BUCKETS : (k + 1) * BUCKETS].astype(np.float32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(v, np.int64 if k < 0 else np.float32)
        for k, v in total.items():
            yield _vector(k, v)

    parts = docs.select("id", "text").mapInArrow(count, "k int, v binary").repartition(8, "k").mapInArrow(add, "k int, v binary")
    total, sketch = np.zeros(BUCKETS + 1, np.int64), np.zeros((SKETCH, BUCKETS))
    for r in parts.collect():  # SKETCH + 1 rows, whatever the documents' number
        if r["k"] < 0:
            total = np.frombuffer(bytes(r["v"]), np.int64)
        else:
            sketch[r["k"]] = np.frombuffer(bytes(r["v"]), np.float32)
    return total[:BUCKETS], int(total[BUCKETS]), sketch


def _vector(k: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])


def weights(frequency: np.ndarray, size: int) -> np.ndarray:
    """Inverse document frequencies; 0 for stop terms."""
    out = np.log((size + 1) / (frequency + 1))
    # in a handful of documents a share tells nothing, and no word weighs nothing
    out[(frequency > STOP * size) & (frequency > 20)] = 0
    if size <= 20:
        out += 0.1
    return out


@dataclass
class Rows:
    """Sparse rows: term, weight and row of every entry, sorted by row."""

    term: np.ndarray
    value: np.ndarray
    row: np.ndarray
    n: int


def _blocks(w: words.Words, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's block of `stride` words, each block's text and its place in it."""
    count = np.diff(w.first)
    blocks = -(-count // stride)
    text = np.repeat(np.arange(len(count)), blocks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    of = np.repeat(np.arange(len(count)), count)
    return (np.cumsum(blocks) - blocks)[of] + (np.arange(len(of)) - w.first[of]) // stride, text, place


def item_rows(texts: pa.Array, idf: np.ndarray) -> Rows:
    """A row for every text."""
    w, term = _split(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(w.first))
    value = idf[term]
    some = np.flatnonzero(value > 0)
    return Rows(term[some], value[some], row[some], len(texts))


def _unit(rows: Rows) -> Rows:
    norm = np.sqrt(np.bincount(rows.row, rows.value**2, rows.n))
    return Rows(rows.term, rows.value / np.maximum(norm, 1e-12)[rows.row], rows.row, rows.n)


def latent_space(items: np.ndarray, sketch: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right singular vectors of items and passages.

    items: unit rows. A sketch of k rows adds the k-th part of the passages' weight to each of its
    squared singular values; their median, which is about that, is taken off again.
    """
    other = sketch * idf
    square, side = np.linalg.eigh(other @ other.T)
    own = np.maximum(square - np.median(square), 0)
    # the passages together weigh as much as the items
    scale = np.sqrt(own / np.maximum(square, 1e-300) * ((items**2).sum() / max(square.sum(), 1e-300)))
    stacked = np.concatenate([items, (side * scale).T @ other])
    value, vector = np.linalg.eigh(stacked @ stacked.T)
    value, vector = value[::-1][: len(items) + EXTRA_RANK], vector[:, ::-1][:, : len(items) + EXTRA_RANK]
    some = value > 1e-9 * max(value.max(), 1e-300)
    return stacked.T @ (vector[:, some] / np.sqrt(value[some]))


def block_products(images: np.ndarray, term: np.ndarray, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Sums of the words' rows of `images` by block, n blocks of STRIDE slots; the last row of images is 0."""
    padded = np.full(n * STRIDE, len(images) - 1)
    padded[row * STRIDE + slot] = term
    out, one = np.empty((n, images.shape[1]), np.float32), np.ones(STRIDE, np.float32)
    # as many blocks at once as the processor's cache holds
    for lo in range(0, n, 32):
        hi = min(n, lo + 32)
        taken = images[padded[lo * STRIDE : hi * STRIDE]].reshape(hi - lo, STRIDE, -1)
        np.matmul(one, taken, out=out[lo:hi])
    return out


def common_subsequence(masks: dict[int, int], m: int, window: list[int]) -> int:
    """Length of the longest common subsequence; masks: places of every word of the item, as bits."""
    full = (1 << m) - 1
    s = full
    for x in window:
        u = s & masks.get(x, 0)
        s = ((s + u) | (s - u)) & full
    return m - s.bit_count()


@dataclass
class Item:
    key: int
    size: int
    masks: dict[int, int]
    answer: frozenset[int]


def _items(keys: list[int], texts: list[str | None]) -> list[Item]:
    out = []
    for key, text in zip(keys, texts, strict=True):
        w, _ = _split(pa.array([text], pa.string()))
        own = w.hashes.tolist()
        masks: dict[int, int] = {}
        for i, x in enumerate(own):
            masks[x] = masks.get(x, 0) | 1 << i
        sentences = [s for s in (text or "").replace("\n", ".").split(".") if s.strip()]
        last, _ = _split(pa.array(sentences[-1:], pa.string()))
        out.append(Item(key, len(own), masks, frozenset(last.hashes.tolist())))
    return out


def leaked(item: Item, window: list[int], near: bool = True) -> int:
    """Length of the common subsequence if the window repeats the item, else 0. near: it may be a paraphrase."""
    n = common_subsequence(item.masks, item.size, window)
    if item.size < LEAST:
        return n if n == item.size else 0
    if n >= LCS * item.size and n >= LEAST:
        return n
    if not near:
        return 0
    held = len(item.answer.intersection(window))
    return n if n >= PARAPHRASE * item.size and n >= LEAST and held >= ANSWER * max(len(item.answer), 1) else 0


@dataclass
class Runs:
    """Balanced runs of up to STRIDE words of items, as postings of their words.

    word: ascending hashes; those of word k are at first[k] to first[k + 1] of `run` and `count`
    (its times in the run). need: words that a passage must hold; item: the item of a run.
    """

    word: np.ndarray
    first: np.ndarray
    run: np.ndarray
    count: np.ndarray
    need: np.ndarray
    item: np.ndarray

    def table(self) -> np.ndarray | None:
        """Times of a word in a run (words x runs, and a last row of 0); null if that is more than TABLE."""
        if (len(self.word) + 1) * len(self.item) > TABLE:
            return None
        out = np.zeros((len(self.word) + 1, len(self.item)), np.uint8)
        out[np.repeat(np.arange(len(self.word)), np.diff(self.first)), self.run] = self.count
        return out


def item_runs(texts: pa.Array) -> Runs:
    """Of a copy, `leaked` wants LCS of the item's words in common: some run has its share of them."""
    w, _ = _split(texts)
    size = np.diff(w.first)
    parts = -(-size // STRIDE)
    of = np.repeat(np.arange(len(size)), size)
    base = np.cumsum(parts) - parts
    run = base[of] + (np.arange(len(of)) - w.first[of]) * parts[of] // size[of]
    item = np.repeat(np.arange(len(size)), parts)
    share = np.where(size < LEAST, 1.0, np.maximum(LCS, LEAST / np.maximum(size, 1)))
    need = np.ceil(np.bincount(run, minlength=len(item)) * share[item] - 1e-9).astype(np.int64)
    word, which = np.unique(w.hashes, return_inverse=True)
    key, count = np.unique(which * max(len(item), 1) + run, return_counts=True)
    first = np.searchsorted(key // max(len(item), 1), np.arange(len(word) + 1))
    return Runs(word, first, key % max(len(item), 1), count, need, item)


def held_runs(
    runs: Runs, table: np.ndarray | None, w: words.Words, row: np.ndarray, text: np.ndarray, place: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Passages (by their first block) and items of which they hold all that a run needs.

    row: each word's block. With and without a table of the runs the result is the same.
    """
    if not len(runs.word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(runs.word, w.hashes), len(runs.word) - 1)
    known = np.flatnonzero(runs.word[at] == w.hashes)
    block = row[known]
    if table is not None:
        return _held_in_table(runs, table, block, at[known], text)
    # a word is in the passage of its block and in that of the block before
    second = place[block] > 0
    both = np.concatenate([block, block[second] - 1]) * len(runs.word) + np.concatenate([at[known], at[known][second]])
    both = np.unique(both)
    passage, word = both // len(runs.word), both % len(runs.word)
    many = runs.first[word + 1] - runs.first[word]
    total, out, lo = np.append(0, np.cumsum(many)), [], 0
    while lo < len(both):
        # whole passages, of about a million postings
        hi = int(np.searchsorted(total, total[lo] + (1 << 20), "right")) - 1
        hi = max(int(np.searchsorted(passage, passage[min(hi, len(both) - 1)])), int(np.searchsorted(passage, passage[lo], "right")))
        if total[-1] - total[lo] <= 1 << 20:
            hi = len(both)
        n = many[lo:hi]
        post = np.repeat(runs.first[word[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, which = np.unique(np.repeat(passage[lo:hi], n) * len(runs.item) + runs.run[post], return_inverse=True)
        held = np.bincount(which, runs.count[post], len(key))
        key = key[held >= runs.need[key % len(runs.item)]]
        out.append(np.column_stack([key // len(runs.item), runs.item[key % len(runs.item)]]))
        lo = hi
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _held_in_table(
    runs: Runs, table: np.ndarray, block: np.ndarray, word: np.ndarray, text: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """`held_runs` by sums of the table's rows: what two blocks hold together is their sum at most."""
    n, none = len(text), len(table) - 1
    key = np.unique(block * none + word)
    block, word = key // none, key % none
    first = np.searchsorted(block, np.arange(n))
    # a block and a row of nothing behind each block that ends its text
    padded = np.full((n + 1, STRIDE), none)
    padded[block, np.arange(len(block)) - first[block]] = word
    follow = np.append(np.where(text[1:] == text[:-1], np.arange(1, n), n), n)
    need, found = runs.need.astype(np.uint8), []
    held = np.empty((n + 1, len(runs.item)), np.uint8)
    for lo in range(0, n + 1, 32):
        np.add.reduce(table[padded[lo : lo + 32]], axis=1, dtype=np.uint8, out=held[lo : lo + 32])
    for lo in range(0, n, 1024):
        hi = min(n, lo + 1024)
        passage, run = np.nonzero(held[lo:hi] + held[follow[lo:hi]] >= need)
        passage += lo
        for k in range(0, len(run), 1 << 14):
            p, r = passage[k : k + (1 << 14)], run[k : k + (1 << 14)]
            own = np.sort(np.concatenate([padded[p], padded[follow[p]]], axis=1), axis=1)
            own[:, 1:][own[:, 1:] == own[:, :-1]] = none  # a word of both blocks counts once
            enough = table[own, r[:, None]].sum(axis=1) >= runs.need[r]
            found.append(np.column_stack([p[enough], runs.item[r[enough]]]))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _search(docs: DataFrame, images: np.ndarray, items: list[Item], runs: Runs, idf: np.ndarray) -> DataFrame:
    """id, item, cosine, lcs of every hit. images: item images in term space, unit latent length."""
    weighted = np.append(images * idf[:, None], np.zeros((1, images.shape[1])), axis=0).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((weighted, items, runs, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, items, runs, idf = shared.value
        table = runs.table()
        for batch in batches:
            for part in words.pieces(batch, "text", 1 << 19):
                w, term = _split(part.column(1))
                row, text, place = _blocks(w, STRIDE)
                if not len(text):
                    continue
                slot = np.arange(len(term)) - np.flatnonzero(np.diff(row, prepend=-1))[row]
                dots = block_products(weighted, term, row, slot, len(text))
                square = np.bincount(row, idf[term] ** 2, len(text))
                # a passage is a block and the next one of the same text
                more = np.append(text[1:] == text[:-1], False)
                dots[more] += dots[np.flatnonzero(more) + 1]
                square[more] += square[np.flatnonzero(more) + 1]
                near = dots
                near /= np.sqrt(np.maximum(square, 1e-12)).astype(np.float32)[:, None]
                block, item = np.nonzero(near >= NEAR)
                held = held_runs(runs, table, w, row, text, place)
                block, item = np.divmod(
                    np.unique(np.append(block * len(items) + item, held[0] * len(items) + held[1])), len(items)
                )
                if not len(block):
                    continue
                first_block = np.searchsorted(text, np.arange(len(part)))
                found: list[tuple[int, int, float, int]] = []
                for b, i in zip(block.tolist(), item.tolist(), strict=True):
                    t = int(text[b])
                    at = int(w.first[t]) + STRIDE * (b - int(first_block[t]))
                    close = bool(near[b, i] >= NEAR)
                    reach = max(STRIDE if close else 0, items[i].size)
                    lo, hi = max(int(w.first[t]), at - reach), min(int(w.first[t + 1]), at + 2 * STRIDE + reach)
                    n = leaked(items[i], w.hashes[lo:hi].tolist(), close)
                    if n:
                        found.append((t, items[i].key, float(near[b, i]), n))
                if found:
                    t, key, cosine, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(t)), pa.array(key, pa.int64()), pa.array(cosine), pa.array(n, pa.int32())],
                        names=["id", "item", "cosine", "lcs"],
                    )

    return docs.mapInArrow(run, "id bigint, item bigint, cosine double, lcs int")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Id, item, `cosine` and `lcs` for every pair of a document and an item that it repeats."""
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as text").where("text is not null and text <> ''")
    query = benchmark.selectExpr(f"cast(`{item_col}` as bigint) as item", f"`{item_text_col}` as text").where(
        "item is not null and text is not null"
    )
    frequency, size, sketch = corpus_statistics(rows)
    idf = weights(frequency, size)
    out, held = None, []

    def search(block: list) -> DataFrame:
        items = [x for x in _items([r["item"] for r in block], [r["text"] for r in block]) if x.size]
        texts = pa.array([r["text"] for r in block if _items([0], [r["text"]])[0].size], pa.string())
        rows_of = _unit(item_rows(texts, np.maximum(idf, 1e-3)))
        found = np.zeros((len(items), BUCKETS))
        np.add.at(found, (rows_of.row, rows_of.term), rows_of.value)
        basis = latent_space(found, sketch, idf)
        latent = found @ basis
        length = np.sqrt((latent**2).sum(axis=1))
        return _search(rows, basis @ (latent / np.maximum(length, 1e-12)[:, None]).T, items, item_runs(texts), idf)

    for r in query.orderBy("item", "text").toLocalIterator():
        held.append(r)
        if len(held) == ITEMS:
            hits = search(held)
            out, held = hits if out is None else out.unionByName(hits), []
    if held and any(x.size for x in _items([0] * len(held), [r["text"] for r in held])):
        hits = search(held)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], "id bigint, item bigint, cosine double, lcs int")
    return out.groupBy("id", "item").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs")).selectExpr(
        f"id as `{id_col}`", f"item as `{item_col}`", "cosine", "lcs"
    )
