"""Toxicity: a linear-chain conditional random field over the words of each line.

Words are runs of letters, lower-cased. The labelled tokens come from the labelled documents:
Spark counts the documents of each kind that hold a word, or a word with given first bytes. What
is `ODDS` times likelier in toxic rows, with log odds `SURE` standard errors above zero and in
`SUPPORT` of those rows, marks a word. A marked word is a toxic token in toxic rows and a clean
one elsewhere. A field with two states (clean, toxic) learns these tokens from hashed identity,
prefixes, neighbours and length, on a bounded sample of lines; its weights are a table of fixed
size.

Scoring runs forward-backward over all lines of a batch side by side. A document's evidence is
the sum of -log(1 - marginal) over its words, the log of that it holds no toxic word; a logistic
curve over evidence and length, fitted on bins of all training rows, gives the score. `spans` are runs
of words whose marginal is at least 0.5, as code point offsets.

Null and empty texts score like a text without evidence. Without training rows every score is 0
and there are no spans. A null label is not used. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import words

TABLE = 1 << 18
PREFIXES = range(4, 9)
SURE = 3.0
ODDS = 8
#: share of the toxic rows that hold a marked word, at least: copies of one text mark nothing
SUPPORT = 0.005
MOST_MARKED = 20_000
#: lines of training rows that the field is fitted on, at most, with a marked word and without
SAMPLE_LINES = 3_000
#: longest line of that sample in bytes (characters: half of it); scoring has no such bound
SAMPLE_BYTES = 4_000
EPOCHS = 25
BINS = 120
#: log of the largest evidence and number of words that the curve's bins tell apart
TOP = 12
_LINE = np.zeros(256, bool)
_LINE[10] = True


def tokens(column: pa.Array) -> tuple[words.Words, np.ndarray, np.ndarray]:
    """Words of all texts; the number of each word's line; each word's text."""
    data, offsets = words.buffers(column)
    w = words.split_words(data, offsets, inside=words.LETTERS, fold=words.LOWER)
    breaks = np.sort(np.concatenate([np.flatnonzero(_LINE[data]), offsets]))
    return w, np.searchsorted(breaks, w.start, "right"), np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))


def marks(w: words.Words) -> np.ndarray:
    """What a word can be marked by: itself, and its first bytes if it is longer; 0 for none."""
    return np.column_stack([w.hashes, words.prefixes(w, PREFIXES, words.LOWER)])


def word_counts(rows: DataFrame) -> DataFrame:
    """h, toxic, clean: documents of each kind that hold the word or prefix. rows: text, y."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text"):
                w, _, of = tokens(part.column(0))
                y = np.asarray(part.column(1))
                found = marks(w)
                of, h = np.repeat(of, found.shape[1])[found.ravel() > 0], found[found > 0]
                order = np.lexsort((of, h))
                h, o = h[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                h, o = h[new], o[new]
                start = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1)))
                n = np.diff(np.append(start, len(h)))
                toxic = np.add.reduceat(y[o].astype(np.int64), start) if len(start) else n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[start].view(np.int64)), pa.array(toxic, pa.int64()), pa.array(n - toxic, pa.int64())],
                    names=["h", "toxic", "clean"],
                )

    found = rows.select("text", "y").mapInArrow(count, "h bigint, toxic bigint, clean bigint")
    return found.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def marked_words(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the words marked toxic: MOST_MARKED surest at most."""
    n = rows.groupBy("y").count().collect()
    size = {int(r["y"]): r["count"] for r in n}
    if not size.get(1) or not size.get(0):
        return np.zeros(0, np.uint64)
    odds = (
        f"ln((toxic + 0.5) / ({size[1]} - toxic + 0.5)) - ln((clean + 0.5) / ({size[0]} - clean + 0.5))"
    )
    error = f"sqrt(1 / (toxic + 0.5) + 1 / ({size[1]} - toxic + 0.5) + 1 / (clean + 0.5) + 1 / ({size[0]} - clean + 0.5))"
    found = (
        word_counts(rows).withColumn("odds", F.expr(odds)).withColumn("z", F.expr(f"odds / {error}"))
        .where(f"z >= {SURE} and odds >= ln({ODDS}) and toxic >= greatest(3, {SUPPORT} * {size[1]})").orderBy(F.desc("z"), "h").limit(MOST_MARKED)
    )
    return np.sort(np.array([r["h"] for r in found.select("h").collect()], np.int64).view(np.uint64))


@dataclass
class Field:
    """Emission weights (toxic against clean) by feature, transition scores, and the score curve."""

    weights: np.ndarray
    moves: np.ndarray
    curve: np.ndarray


def curve(found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Inputs of the score's logistic curve: log evidence, log number of words, their product."""
    return np.column_stack([np.ones(len(found)), found, size, found * size, found**2])


def features(w: words.Words, line: np.ndarray) -> np.ndarray:
    """Table places of every word's features: identity, prefixes, words before and after, length."""
    h, n = w.hashes, len(w.hashes)
    edge = np.uint64(0)
    before, after = np.full(n, edge), np.full(n, edge)
    same = line[1:] == line[:-1]
    before[1:][same] = h[:-1][same]
    after[:-1][same] = h[1:][same]
    length = np.minimum(w.end - w.start, 24).astype(np.uint64)
    around = [words.mix(before + np.uint64(1)), words.mix(after + np.uint64(2)), words.mix(length + np.uint64(3))]
    return (np.column_stack([marks(w), *around]) & np.uint64(TABLE - 1)).astype(np.int32)


def _steps(line: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """First words of the chains, longest chain first, and the number of chains alive at each step."""
    start = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(start, len(line)))
    order = np.argsort(-size, kind="stable")
    size = size[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    return start[order], alive.tolist()


def marginals(emit: np.ndarray, line: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of the toxic state by word, and the log odds of the forward and backward messages.

    emit: score of the toxic state by word (the clean one has 0); moves[i, j]: score of state j
    after i. Two states need one number a message; one step is taken for all lines at once.
    """
    ahead, back = np.array(emit, float), np.zeros(len(emit))
    if len(emit):
        start, alive = _steps(line)
        (m00, m01), (m10, m11) = moves
        for t, k in enumerate(alive[1:], 1):
            at = start[:k] + t
            x = ahead[at - 1]
            ahead[at] += np.logaddexp(m01, m11 + x) - np.logaddexp(m00, m10 + x)
        for t in range(len(alive) - 2, -1, -1):
            at = start[: alive[t + 1]] + t
            x = emit[at + 1] + back[at + 1]
            back[at] = np.logaddexp(m10, m11 + x) - np.logaddexp(m00, m01 + x)
    return 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40))), ahead, back


def expected_moves(emit: np.ndarray, line: np.ndarray, moves: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Expected number of each move over all chains."""
    inner = np.flatnonzero(line[1:] == line[:-1])
    f, b = ahead[inner], (emit + back)[inner + 1]
    joint = np.stack([moves[0, 0] + 0 * f, moves[0, 1] + b, moves[1, 0] + f, moves[1, 1] + f + b])
    joint = np.exp(joint - joint.max(axis=0))
    return (joint / joint.sum(axis=0)).sum(axis=1)


def fit(w_feats: np.ndarray, line: np.ndarray, state: np.ndarray) -> Field:
    """Maximum likelihood by Adam on the whole sample, with an L2 penalty."""
    size = TABLE + 4
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    inner = np.flatnonzero(line[1:] == line[:-1])
    seen = np.bincount(2 * state[inner] + state[inner + 1], minlength=4).astype(float)
    for step in range(1, EPOCHS + 1):
        emit, moves = theta[:TABLE][w_feats].sum(axis=1), theta[TABLE:].reshape(2, 2)
        chance, ahead, back = marginals(emit, line, moves)
        expected = expected_moves(emit, line, moves, ahead, back)
        gap = np.repeat((chance - state)[:, None], w_feats.shape[1], axis=1)
        grad = np.concatenate([np.bincount(w_feats.ravel(), gap.ravel(), TABLE), expected - seen]) + 1e-2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Field(theta[:TABLE].astype(np.float32), theta[TABLE:].reshape(2, 2), np.zeros(5))


def is_marked(w: words.Words, marked: np.ndarray) -> np.ndarray:
    return np.isin(marks(w), marked).any(axis=1)


def _parts(text: str) -> Iterator[str]:
    """The lines of a text; those over SAMPLE_BYTES / 2 characters in parts, cut behind a blank where there is one."""
    most = SAMPLE_BYTES // 2
    for line in text.split("\n"):
        at = 0
        while len(line) - at > most:
            end = line.rfind(" ", at, at + most) + 1 or at + most
            yield line[at:end]
            at = end
        if at < len(line):
            yield line[at:]


def sample(rows: DataFrame, marked: np.ndarray) -> pa.Table:
    """Lines to learn from: SAMPLE_LINES with a marked word and as many without, by a hash's order."""
    shared = rows.sparkSession.sparkContext.broadcast(marked)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                (s, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for s in _parts(t or "")
            ]
            if both:
                lines = [s for s, _ in both]
                w, _, of = tokens(pa.array(lines, pa.string()))
                hit = np.zeros(len(lines), bool)
                hit[of[is_marked(w, shared.value)]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines, pa.string()), pa.array(hit), pa.array([y for _, y in both], pa.int32())],
                    names=["line", "hit", "y"],
                )

    lines = rows.selectExpr("text", "cast(y as int) as y").mapInArrow(find, "line string, hit boolean, y int").distinct().withColumn("o", F.xxhash64("line"))
    parts = [lines.where(f"hit = {k}").orderBy("o", "line", "y").limit(SAMPLE_LINES) for k in ("true", "false")]
    return parts[0].unionByName(parts[1]).select("line", "y").toArrow()


def evidence(column: pa.Array, field: Field) -> tuple[np.ndarray, words.Words, np.ndarray, np.ndarray]:
    """Evidence by text; words, their texts and marginals."""
    w, line, of = tokens(column)
    if not len(line):
        return np.zeros(len(column)), w, of, np.zeros(0)
    emit = np.add.reduce(field.weights[features(w, line)], axis=1, dtype=np.float64)
    chance, _, _ = marginals(emit, line, field.moves)
    return np.bincount(of, -np.log1p(-np.minimum(chance, 1 - 1e-12)), len(column)), w, of, chance


def _spans(text: bytes, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges as code point ranges."""
    return [(len(text[:a].decode()), len(text[:b].decode())) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def train(rows: DataFrame) -> Field:
    """rows: text, y (0 or 1), both not null."""
    marked = marked_words(rows)
    if not len(marked):
        return Field(np.zeros(TABLE, np.float32), np.zeros((2, 2)), np.array([-40.0, 0, 0, 0, 0]))
    lines = sample(rows, marked)
    w, line, of = tokens(lines["line"].combine_chunks())
    toxic = np.asarray(lines["y"].combine_chunks())[of] == 1
    field = fit(features(w, line), line, (is_marked(w, marked) & toxic).astype(np.int64))
    shared = rows.sparkSession.sparkContext.broadcast(field)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text"):
                found, w, *_ = evidence(part.column(0), shared.value)
                at = np.column_stack([np.log1p(found) / TOP, np.log1p(np.diff(w.first)) / TOP]) * BINS
                at = np.clip(at, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[:, 0]), pa.array(at[:, 1]), part.column(1)], names=["e", "n", "y"]
                )

    bins = (
        rows.selectExpr("text", "cast(y as int) as y").mapInArrow(binned, "e int, n int, y int").groupBy("e", "n")
        .agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("rows")).orderBy("e", "n").toPandas()
    )
    x = curve((bins["e"].to_numpy() + 0.5) * TOP / BINS, (bins["n"].to_numpy() + 0.5) * TOP / BINS)
    n, y = bins["rows"].to_numpy(float), bins["toxic"].to_numpy(float)
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = x.T @ (x * (n * p * (1 - p))[:, None]) + 1e-2 * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(hess, x.T @ (y - n * p) - 1e-2 * beta), -2, 2)
    field.curve = beta
    return field


def detect(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, `score` and `spans` (start, end, marginal) for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for part in words.pieces(batch, "text", 2 << 20):
                found, w, of, chance = evidence(part.column(1), f)
                spans: list[list[tuple[int, int, float]]] = [[] for _ in range(len(part))]
                at = np.flatnonzero(chance >= 0.5)
                # neighbouring words of one text are one span
                cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(of[at]) > 0)) if len(at) else at
                for a, b in zip(np.append(at[:1], at[cut + 1]), np.append(at[cut], at[-1:]), strict=True):
                    i = of[a]
                    text = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                    (x, y), = _spans(text, w.start[a : a + 1] - w.offsets[i], w.end[b : b + 1] - w.offsets[i])
                    spans[i].append((x, y, float(chance[a : b + 1].max())))
                x = curve(np.log1p(found), np.log1p(np.diff(w.first)))
                score = 1 / (1 + np.exp(-np.clip((x * f.curve).sum(axis=1), -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array(spans, pa.list_(span))], names=["id", "score", "spans"]
                )

    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    out = rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start:bigint,end:bigint,chance:double>>")
    return out.withColumnRenamed("id", id_col)
