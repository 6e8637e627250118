"""Ranked lexical search: block-max MaxScore over an index in document shards.

A term is a maximal run of ASCII letters, digits and characters above 127, A-Z lower-cased. The
index covers every row and every term. A shard holds the documents that one task read, up to
`POSTINGS` postings; in it a term has one list of (document, occurrences), ascending, in blocks of
`BLOCK`, packed as variable-length bytes. Beside the bytes stand every block's last document and
its largest impact, and the list's largest impact. The impact (10^9 tf) div (1000 tf + 20 m)
is the part of a score that does not depend on the query, so an index serves all queries.

Search goes through blocks of `QUERY_TERMS` query terms. Only their lists leave the index; each shard
is searched by one task. Per query, lists are ordered by their bound, weight times largest impact.
The lists whose bounds together stay below the shard's current TOP-th score are not essential: a
document only in them cannot enter. The other lists are merged over a window of documents; for
what they hold, the others are tried from the largest bound down, and a candidate whose
score cannot reach the threshold with the maximum of its block in the next list is dropped before
that block is unpacked. Windows grow, and after each the threshold rises. The shards' heaps are merged by a ranked
window, which Spark cuts to TOP rows in each task before rows are sent.

Scores are exact 64-bit integers, ties go to the smaller id, then to the text's place in the index.
Odd rows: a null or empty text has no terms and is never found; a null id comes after others of
equal score; rows that share an id are documents of their own. Items with the same id and text are
one item; items that share an id only are ranked each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm import words
from runlens.llm.tables import stored

TOP = 50
BLOCK = 128
#: postings of a shard, about, and query terms that are broadcast at a time, about
POSTINGS, QUERY_TERMS = 1 << 21, 1 << 16
#: documents of a search window: the first one, and how much the next are larger
WINDOW, GROWTH = 1024, 4
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
INDEX = "shard bigint, term bigint, df int, top bigint, last binary, best binary, at binary, body binary"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of every text: owner, hash, occurrences; and the texts' numbers of terms."""
    w = words.split_words(*words.buffers(column), inside=TERM_BYTES, fold=words.LOWER)
    n = np.diff(w.first)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((w.hashes, owner))
    owner, hashes = owner[order], w.hashes[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]) if len(owner) else np.zeros(0, np.int64)
    return owner[first], hashes[first].view(np.int64), np.diff(np.append(first, len(owner))), n


def corpus_size(rows: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms. rows: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = total = 0
        for batch in batches:
            for part in words.pieces(batch, "text"):
                w = words.split_words(*words.buffers(part.column(0)), inside=TERM_BYTES)
                held += int((np.diff(w.first) > 0).sum())
                total += len(w.start)
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([total])], names=["n", "l"])

    out = rows.select("text").mapInArrow(count, "n bigint, l bigint").agg(F.sum("n"), F.sum("l")).first()
    return out[0] or 0, out[1] or 0


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (seven bits each, the last one below 128), and their number by value."""
    size = 1 + sum((values >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        more = (size[some] > k + 1).astype(np.uint8) << np.uint8(7)
        out[end[some] - size[some] + k] = ((values[some] >> (7 * k)) & 127).astype(np.uint8) | more
    return out, size


def _unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, np.int64)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive ranges of bytes as one binary column."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _shard(number: int, ids: list[pa.Array], m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents (term null: ids in `body`, known ids in `at`, m in `last`), then a list a term."""
    names = ["shard", "term", "df", "top", "last", "best", "at", "body"]
    column = pa.concat_arrays(ids)
    own = np.asarray(column.fill_null(0)).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([number]), pa.nulls(1, pa.int64()), pa.array([len(own)], pa.int32()), pa.nulls(1, pa.int64()),
            pa.array([m.astype(np.int64).tobytes()], pa.binary()), pa.nulls(1, pa.binary()),
            pa.array([np.asarray(column.is_valid()).astype(np.uint8).tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary()),
        ],
        names=names,
    )
    if not len(doc):
        return
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.append(first, len(doc)))
    rank = np.arange(len(doc)) - np.repeat(first, df)
    blocks = np.flatnonzero(rank % BLOCK == 0)
    ends = np.append(blocks[1:], len(doc))
    # a list's gaps run on from block to block; its first document counts from -1
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first] + 1
    body, size = _packed(np.column_stack([gap, tf]).ravel())
    upto = np.append(0, np.cumsum(size))
    per_list = -(-df // BLOCK)
    worth = impact(tf, m[doc])
    best = np.maximum.reduceat(worth, blocks).astype(np.uint32)
    last = doc[ends - 1].astype(np.uint32)
    list_at = upto[2 * first]
    at = (upto[2 * ends] - np.repeat(list_at, per_list)).astype(np.uint32)  # where a block ends
    sizes = np.append(list_at[1:], upto[-1]) - list_at
    top = np.maximum.reduceat(worth, first)
    step = max(1, len(first) * (4 << 20) // max(1, len(body)))
    block_at = np.append(0, np.cumsum(per_list))
    for a in range(0, len(first), step):
        z = min(a + step, len(first))
        p, q = block_at[a], block_at[z]
        heads = [_binary(x[p:q], 4 * per_list[a:z]) for x in (last, best, at)]
        begin, end = list_at[a], list_at[z] if z < len(first) else len(body)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(z - a, number)), pa.array(term[first[a:z]]), pa.array(df[a:z].astype(np.int32)), pa.array(top[a:z]),
                *heads, _binary(body[begin:end], sizes[a:z]),
            ],
            names=names,
        )


def build(rows: DataFrame, n_docs: int, n_terms: int, postings: int = POSTINGS) -> DataFrame:
    """The index of rows (id, text), see `INDEX`; n_docs and n_terms: `corpus_size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, n_held = TaskContext.get().partitionId() << 24, 0, 0
        ids: list[pa.Array] = []
        held: list[tuple[np.ndarray, ...]] = []
        lengths: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            n = np.concatenate(lengths)
            m = 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)
            doc, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from _shard(base + number, ids, m, doc, term, tf)

        for batch in batches:
            for part in words.pieces(batch, "text"):
                owner, term, tf, n = terms_of(part.column(1))
                held.append((owner + sum(map(len, lengths)), term, tf))
                ids.append(part.column(0))
                lengths.append(n)
                n_held += len(owner)
                if n_held >= postings:
                    yield from flush()
                    ids, held, lengths, n_held, number = [], [], [], 0, number + 1
        if ids:
            yield from flush()

    return rows.mapInArrow(run, INDEX)


def query_terms(items: DataFrame) -> DataFrame:
    """q, item, term: the distinct terms of every item. items: q, item, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, term, _, _ = terms_of(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(term)], names=["q", "item", "term"])

    return items.mapInArrow(run, "q bigint, item bigint, term bigint")


class Postings:
    """A term's list in a shard; blocks are unpacked when they are asked for, and remembered."""

    def __init__(self, top: int, last: bytes, best: bytes, at: bytes, body: bytes, m: np.ndarray) -> None:
        self.top, self.m = top, m
        self.last = np.frombuffer(last, np.uint32).astype(np.int64)
        self.best = np.frombuffer(best, np.uint32).astype(np.int64)
        self.at = np.append(0, np.frombuffer(at, np.uint32).astype(np.int64))
        self.body = np.frombuffer(body, np.uint8)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.known:
            values = _unpacked(self.body[self.at[k] : self.at[k + 1]])
            docs = np.cumsum(values[::2]) + (self.last[k - 1] if k else -1)
            self.known[k] = docs, impact(values[1::2], self.m[docs])
        return self.known[k]

    def blocks(self, ks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(k) for k in ks]
        if len(found) == 1:
            return found[0]
        return np.concatenate([d for d, _ in found]), np.concatenate([g for _, g in found])

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of [lo, hi) and their impacts."""
        a, z = np.searchsorted(self.last, [lo, hi - 1])
        z = min(z, len(self.last) - 1)
        if a > z:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, g = self.blocks(list(range(a, z + 1)))
        p, q = np.searchsorted(docs, [lo, hi])
        return docs[p:q], g[p:q]


def best_of_shard(lists: list[tuple[int, Postings]], ids: np.ndarray, known: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard's `top` highest scores above 0, and the scores. lists: weight and postings.

    Ties go to the smaller id, then the document's number; `known` false (a null id) comes last.
    """
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].top)
    # bound[k]: most that the first k lists add
    bound = np.append(0, np.cumsum(np.array([w * p.top for w, p in lists], np.int64)))
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, lo, width = 1, 0, WINDOW
    while lo < len(ids):
        hi = min(lo + width, len(ids))
        # lists that cannot reach the threshold together are not essential
        split = int(np.searchsorted(bound, least, "left")) - 1
        if split >= len(lists):
            break
        sums = np.zeros(hi - lo, np.int64)
        for w, p in lists[split:]:
            at, g = p.between(lo, hi)
            sums[at - lo] += w * g
        found = np.flatnonzero(sums)
        have = sums[found]
        found += lo
        for k in range(split - 1, -1, -1):
            w, p = lists[k]
            keep = have + bound[k + 1] >= least
            found, have = found[keep], have[keep]
            block = np.searchsorted(p.last, found)
            inside = block < len(p.last)
            most = np.zeros(len(found), np.int64)
            most[inside] = w * p.best[block[inside]]
            keep = have + most + bound[k] >= least  # before any block is unpacked
            found, have, block = found[keep], have[keep], block[keep]
            if not len(found):
                break
            asked = np.unique(block)
            asked = asked[asked < len(p.last)]
            if len(asked):
                at, g = p.blocks(asked.tolist())
                place = np.minimum(np.searchsorted(at, found), len(at) - 1)
                have = have + np.where(at[place] == found, w * g[place], 0)
        docs, scores = np.append(docs, found), np.append(scores, have)
        order = np.lexsort((docs, ids[docs], ~known[docs], -scores))[:top]
        docs, scores = docs[order], scores[order]
        if len(docs) == top:
            least = max(1, int(scores[-1]))  # an equal score may still win by its id
        lo, width = hi, width * GROWTH
    return docs, scores


def search(index: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """q, item, id, score: the `top` best of every shard and query. queries: q, item, term, weight.

    One block of queries; its terms are broadcast.
    """
    spark = queries.sparkSession
    asked = queries.toArrow().sort_by([("q", "ascending")])  # bounded by the block
    q, item, term, weight = (np.asarray(asked.column(c).combine_chunks().fill_null(0)) for c in ("q", "item", "term", "weight"))
    no_item = np.asarray(asked.column("item").combine_chunks().is_null())
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    shared = spark.sparkContext.broadcast((q, item, no_item, term, weight, first))

    def run(rows: pa.Table) -> pa.Table:
        q, item, no_item, term, weight, first = shared.value
        data = rows.to_pydict()
        head = data["term"].index(None)
        m = np.frombuffer(data["last"][head], np.int64)
        ids, known = np.frombuffer(data["body"][head], np.int64), np.frombuffer(data["at"][head], np.uint8) > 0
        lists = {
            t: Postings(*args, m)
            for t, *args in zip(*(data[c] for c in ("term", "top", "last", "best", "at", "body")), strict=True)
            if t is not None
        }
        out: list[tuple[np.ndarray, ...]] = []
        for a, z in zip(first, np.append(first[1:], len(q)), strict=True):
            mine = [(w, lists[t]) for t, w in zip(term[a:z].tolist(), weight[a:z].tolist(), strict=True) if t in lists]
            docs, scores = best_of_shard(mine, ids, known, top)
            out.append((np.full(len(docs), a), docs, scores))
        at, docs, scores = (np.concatenate([x[k] for x in out]) for k in range(3))
        return pa.table({
            "q": q[at], "item": pa.array(item[at], mask=no_item[at]), "id": pa.array(ids[docs], mask=~known[docs]), "place": docs, "score": scores,
        })

    wanted = queries.select("term").distinct()
    lists = index.join(F.broadcast(wanted), "term", "left_semi").select(index.columns)
    heads = index.where("term is null")
    groups = lists.unionByName(heads).groupBy("shard")
    return groups.applyInArrow(run, "q bigint, item bigint, id bigint, place bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", postings: int = POSTINGS, query_terms_at_once: int = QUERY_TERMS) -> DataFrame:
    """item, rank, id, score, q (the number of the query): the `top` best documents of every item."""
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as text")
    n_docs, n_terms = corpus_size(rows)
    index = stored(build(rows, n_docs, n_terms, postings), "ranked-index", wide=True)
    asked = items.selectExpr(f"cast(`{item_col}` as bigint) as item", f"coalesce(`{item_text}`, '') as text").distinct()
    asked = stored(asked.selectExpr("monotonically_increasing_id() as q", "item", "text"), "ranked-items", wide=True)
    terms = stored(query_terms(asked), "ranked-terms", wide=True)
    # documents with a term: the lengths of its lists
    found = index.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.sum("df").alias("df"))
    weight = f"cast(floor(1000 * ln(cast({2 * n_docs + 2} as double) / cast(2 * df + 1 as double))) as bigint) as weight"
    queries = stored(terms.join(df, "term").selectExpr("q", "item", "term", weight), "ranked-queries", wide=True)
    blocks = -(-queries.count() // query_terms_at_once)
    block = F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1)))
    heaps = None
    for k in range(blocks):
        one = stored(search(index, queries.where(block == k), top), "ranked-heaps", wide=True)
        heaps = one if heaps is None else heaps.unionByName(one)
    if heaps is None:
        heaps = docs.sparkSession.createDataFrame([], "q bigint, item bigint, id bigint, place bigint, score bigint")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("place"))
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item", "rank", "id", "score", "q")
