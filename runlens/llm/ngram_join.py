"""Documents whose word n-gram sets have a Jaccard similarity of 0.8 or more.

The tokens of a document are its distinct shingles. A sketch over all documents (see `counts`)
puts every token into a class: seen once, rare, or frequent (in `FREQUENT` documents or more).
Tokens are ordered by class, rare first, then by hash, alike in all documents. With e(n) = n/5,
the most tokens of n that the other document may lack:

* The first e + 1 tokens of two similar documents share one. Rare ones among them are indexed
  alone. (A token seen once has no partner.)
* Two documents that share no rare token there share frequent tokens only, if both have a
  frequent one in that prefix. Then every rare token of either is missing in the other, so their
  frequent tokens differ in d <= n/4 - r places (r: rare tokens), and of the first d + 2 shared
  ones two that follow each other in one list do so in the other: each difference can part one
  neighbouring pair only. They stand within the first d + 2 + e - r frequent tokens. Pairs of
  neighbours in this longer prefix are the indexed 2-token combinations.

So nothing is lost, and the index is linear in the text. With a key goes the most that can be
shared from it on, and pairs are compared only where that suffices: they do at their first key. Documents with the same set are one
entry. Every entry of a key is verified against the key's smallest entry; linked ones are one
group. Only entries of different groups that share a key are then verified with each other, so
a group of copies costs links in proportion to its members. Verification compares whole sets.

Null or empty text and text without words: an empty set, linked with nothing. A null id is
dropped with its row. Rows that share an id are taken for copies of one row: one result row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import counts, words
from runlens.llm.keyed import links_through_keys
from runlens.llm.tables import components, join_checked, stored

SIZE = 5
FREQUENT = 50
DEPTH = 2
#: words of 64 bits in a set's marks
MARKS = 8
#: counters a row of the broadcast sketch at most, two bits each
MOST_CELLS = 1 << 27


def shingles(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hash of every distinct shingle, sorted by both; the size of every set."""
    w = words.split_words(*words.buffers(column), fold=words.LOWER)
    count = np.diff(w.first)
    n = len(count)
    hashes, owner, _ = words.runs(w.hashes, w.first, size)
    short = np.flatnonzero((count > 0) & (count < size))
    whole = [w.hashes[w.first[i] : w.first[i + 1]] for i in short]
    # fewer words than a shingle: one token of all of them, salted with their number
    extra = [words.runs(np.append(x, np.uint64(len(x))), np.array([0, len(x) + 1]), len(x) + 1)[0][0] for x in whole]
    owner = np.concatenate([owner, short])
    hashes = np.concatenate([hashes, np.array(extra, np.uint64)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new], np.bincount(owner[new], minlength=n)


def classes(counters: np.ndarray, frequent: int = FREQUENT) -> np.ndarray:
    """Two bits a counter: seen once (or never), rare, frequent."""
    found = (counters > 1).astype(np.uint8) + (counters >= frequent)
    return found[::4] | found[1::4] << 2 | found[2::4] << 4 | found[3::4] << 6


def class_of(packed: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    out = np.full(len(hashes), 2, np.uint8)
    for row in range(len(packed)):
        at = counts.cell(hashes, row, cells)
        out = np.minimum(out, (packed[row][at >> 2] >> (2 * (at & 3)).astype(np.uint8)) & 3)
    return out


def keys(owner: np.ndarray, hashes: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Index keys of all sets: key, owner, and the most tokens shared if it is the first shared one."""
    order = np.lexsort((hashes, kind, owner))
    owner, hashes, kind = owner[order], hashes[order], kind[order]
    first = np.cumsum(n) - n
    rank = np.arange(len(owner)) - first[owner]
    size = n[owner]
    missing = size // 5
    frequent = np.bincount(owner[kind == 2], minlength=len(n))
    rare = (n - frequent)[owner]
    alone = np.flatnonzero((rank <= missing) & (kind == 1))
    # neighbours among the frequent tokens of sets with a frequent one in the prefix
    length = size // 4 - rare + 2 + missing - rare
    pair = np.flatnonzero((rare <= missing) & (kind == 2) & (rank + 1 < size) & (rank - rare + 1 < length))
    joint = words.mix(words.mix(hashes[pair]) + hashes[np.minimum(pair + 1, len(hashes) - 1)])
    return (
        np.concatenate([hashes[alone], joint]),
        np.concatenate([owner[alone], owner[pair]]),
        np.concatenate([(size - rank)[alone], frequent[owner[pair]]]),
    )


def marks(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Parities of the tokens on every bit, a row of `MARKS` words a set."""
    bits = np.zeros((n, 64 * MARKS), np.uint8)
    np.bitwise_xor.at(bits, (owner, (words.mix(hashes ^ np.uint64(3)) % np.uint64(64 * MARKS)).astype(np.int64)), 1)
    return np.packbits(bits, axis=1).view(np.int64)


def index(docs: DataFrame, size: int = SIZE, frequent: int = FREQUENT) -> DataFrame:
    """Rows of sets (id, s, t, n, m: hashes of the set, its size and marks) and of keys (key, s, n, f)."""
    cells = counts.cells_for(counts.words_about(docs, "text"), MOST_CELLS)
    packed = counts.sketch(docs.select("text"), lambda b: shingles(b.column(0), size)[1], DEPTH, cells, partial(classes, frequent=frequent))
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text"):
                owner, h, n = shingles(part.column(1), size)
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(words.mix(h ^ np.uint64(1)), out=sums[0, 1:])
                np.cumsum(words.mix(h ^ np.uint64(2)), out=sums[1, 1:])
                last = np.cumsum(n)
                s, t = (words.mix(x[last] - x[last - n] + n.astype(np.uint64)).view(np.int64) for x in sums)
                empty = pa.nulls(len(n), pa.int64())
                ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * MARKS)
                m = pa.ListArray.from_arrays(ends, pa.array(marks(owner, h, len(n)).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s), pa.array(t), pa.array(n), empty, empty, m],
                    names=["id", "s", "t", "n", "key", "f", "m"],
                )
                key, of, f = keys(owner, h, n, class_of(shared.value, h, cells))
                _, once = np.unique(np.column_stack([key.view(np.int64), s[of]]), axis=0, return_index=True) if len(key) else (0, [])
                key, of, f = key[once], of[once], f[once]
                empty = pa.nulls(len(key), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        empty, pa.array(s[of]), empty, pa.array(n[of]), pa.array(key.view(np.int64)), pa.array(f.astype(np.int64)),
                        pa.nulls(len(key), pa.list_(pa.int64())),
                    ],
                    names=["id", "s", "t", "n", "key", "f", "m"],
                )

    return docs.mapInArrow(scan, "id bigint, s bigint, t bigint, n bigint, key bigint, f bigint, m array<bigint>")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) of ids whose sets are similar. texts: id, size, packed."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def set_of(key: int, size_of: int, packed: pa.Scalar) -> np.ndarray:
            if key not in known:
                if len(known) >= 16:
                    known.clear()
                known[key] = shingles(pa.array([words.unpack_text(size_of, packed.as_py()).decode()], pa.string()), size)[1]
            return known[key]

        for batch in batches:
            a, b, size_a, size_b = (c.to_pylist() for c in batch.columns[:4])
            held = [
                i for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True))
                if similar(set_of(a[i], size_a[i], x), set_of(b[i], size_b[i], y))
            ]
            at = pa.array(held, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    left = texts.selectExpr("id as a", "size as size_a", "packed as packed_a")
    right = texts.selectExpr("id as b", "size as size_b", "packed as packed_b")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "size_a", "size_b", "packed_a", "packed_b")
    return both.mapInArrow(check, "a bigint, b bigint")


#: by size, and by what can be shared from the first shared key on: no similar pair fails it there
FITS = "5 * least(u.n, v.n) >= 4 * greatest(u.n, v.n) and 9 * least(u.f, v.f) >= 4 * (u.n + v.n)"
#: by the marks: a bit set in one alone is at least one token in one alone
CLOSE = f"9 * ({' + '.join(f'bit_count(u.m{i} ^ v.m{i})' for i in range(MARKS))}) <= u.n + v.n"


def groups(
    docs: DataFrame, size: int = SIZE, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per id: `n_shingles` and `component_id`, the smallest id reachable by links."""
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as text")
    found = stored(index(rows, size, frequent), "ngram-index", wide=True)
    every = found.where("key is null")
    sets = every.where("id is not null").select("id", "s", "t", "n").dropDuplicates(["id"])
    entries = found.where("key is not null").select("key", "s", "n", "f")
    # one representative for equal sets
    first = sets.where("n > 0").groupBy("s", "t", "n").agg(F.min("id").alias("rep"))
    first = stored(first.join(every.selectExpr("id as rep", "s", "m").dropDuplicates(["rep", "s"]), ["rep", "s"]), "ngram-sets")
    reps = first.select("s", "rep")
    bits = first.selectExpr("s", *[f"m[{i}] as m{i}" for i in range(MARKS)])

    def prepare(nodes: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
        active = stored(nodes.withColumnRenamed("id", "s").join(reps, "s").select(F.col("rep").alias("id")), "ngram-active")
        texts = stored(words.pack_texts(join_checked(rows, active, "id")), "ngram-texts", wide=True)

        def verify(pairs: DataFrame) -> DataFrame:
            """Similar ones of pairs (x, y) of set hashes."""
            ids = pairs.join(reps.selectExpr("s as x", "rep as a"), "x").join(reps.selectExpr("s as y", "rep as b"), "y")
            near = verified(ids.select("a", "b"), texts, size)
            back = near.join(reps.selectExpr("s as x", "rep as a"), "a").join(reps.selectExpr("s as y", "rep as b"), "b")
            return back.select("x", "y")

        return verify, bits

    linked = links_through_keys(entries, FITS, prepare, CLOSE)
    links = linked.join(reps.selectExpr("s as x", "rep as a"), "x").join(reps.selectExpr("s as y", "rep as b"), "y")
    same = sets.join(first.drop("m"), ["s", "t", "n"]).selectExpr("id as a", "rep as b")
    joined = components(sets.select("id"), same.unionByName(links.select("a", "b")))
    nameless = every.where("id is null").selectExpr("id", "n", "cast(null as bigint) as component_id")
    out = sets.join(joined, "id").select("id", "n", "component_id").unionByName(nameless)
    return out.selectExpr(f"id as `{id_col}`", "n as n_shingles", "component_id")
