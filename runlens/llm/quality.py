"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

`statistics` reads every whole text once and returns a few numbers a row. Features are the
statistics, standardised with means and deviations over all rows, their random Fourier features
(which approximate a Gaussian kernel) and a constant. Every task adds up its part of the normal
equations; Spark sums them, and the solution of the small system is a bounded model. Scores of
labelled rows by a model fitted on the other fold are counted in bins, and the isotonic
regression of the bins turns a raw score into a probability.

Null and empty texts get the statistics of an empty text and are scored like any other. Without
labelled rows every score is 0.5. Repeated rows count as often as they occur; a label whose
document is missing, or a null label, is not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import words
from runlens.llm.tables import stored

FOURIER = 160
WIDTH = 0.15
RIDGE = 1e-3
BINS = 1024
FOLDS = 2
_LOW, _HIGH = -0.5, 1.5

_MARKS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "high": range(128, 256),
    "digit": range(48, 58),
    "space": (32, 9),
    "line": (10,),
    "stop": b".,;:?",
    "shout": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*@^~_=+\\/<>",
    "bracket": b"()[]{}\"'",
}
STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_mean", "word_deviation", "words_unique", "lines_unique", "runs_unique",
    "words_long", "words_mixed", "line_words", *(f"share_{k}" for k in _MARKS),
]
_CLASS = np.full(256, len(_MARKS), np.int64)
for _i, _bytes in enumerate(_MARKS.values()):
    _CLASS[list(_bytes)] = _i
_NOT_LINE = np.arange(256) != 10


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes by owner."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def measure(column: pa.Array) -> np.ndarray:
    """Statistics of every text: one row each, columns as in STATISTICS."""
    data, offsets = words.buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = len(_MARKS) + 1
    owner = np.repeat(np.arange(n), size)
    marks = np.bincount(owner * kinds + _CLASS[data], minlength=n * kinds).reshape(n, kinds)
    w = words.split_words(data, offsets)
    count = np.diff(w.first)
    of = np.repeat(np.arange(n), count)
    long = w.end - w.start
    lines = words.split_words(data, offsets, inside=_NOT_LINE)
    n_lines = np.diff(lines.first)
    run, run_of, _ = words.runs(w.hashes, w.first, 5)
    n_runs = np.bincount(run_of, minlength=n)
    letter = words.LETTERS[data]
    after = np.flatnonzero(letter[:-1] & ~letter[1:] & words.NOT_BLANK[data[1:]]) if len(data) else np.zeros(0, int)
    safe = np.maximum(count, 1)
    mean = np.bincount(of, long, n) / safe
    square = np.bincount(of, long.astype(float) ** 2, n) / safe
    mixed = np.bincount(owner[after], minlength=n) / safe if len(after) else np.zeros(n)
    share = marks[:, : len(_MARKS)] / np.maximum(size, 1)[:, None]
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(n_lines), mean, np.sqrt(np.maximum(square - mean**2, 0)),
        _distinct(w.hashes, of, n) / safe,
        _distinct(lines.hashes, np.repeat(np.arange(n), n_lines), n) / np.maximum(n_lines, 1),
        _distinct(run, run_of, n) / np.maximum(n_runs, 1),
        np.bincount(of, long > 15, n) / safe, mixed, np.log1p(count / np.maximum(n_lines, 1)), share,
    ])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and `x`, the array of STATISTICS, for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text", 2 << 20):
                x = measure(part.column(1))
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["id", "x"]
                )

    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return rows.mapInArrow(run, f"id {kind}, x array<double>").withColumnRenamed("id", id_col)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of `value` with `weight` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Model:
    """All that scoring needs; its size depends on FOURIER and BINS only."""

    mean: np.ndarray
    deviation: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    chance: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        fourier = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / FOURIER)
        return np.column_stack([np.ones(len(z)), z, fourier])

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        # row by row sums: the same whatever else is in the batch
        return (self.features(x) * (self.weights if weights is None else weights)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.chance)


def _array(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def train(stats: DataFrame, labelled: DataFrame) -> Model:
    """stats: `x`; labelled: `x`, `y` (0 or 1, not null) and `fold` (0 to FOLDS - 1)."""
    spark = stats.sparkSession
    d = len(STATISTICS)
    sums = stats.selectExpr(*[f"x[{i}] as x{i}" for i in range(d)]).agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(d)]
    ).first()
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(d)])
    deviation = np.array([sums[f"s{i}"] or 0.0 for i in range(d)])
    random = np.random.default_rng(20)
    model = Model(
        mean, np.where(deviation > 1e-9, deviation, 1.0), random.normal(0, WIDTH, (d, FOURIER)),
        random.uniform(0, 2 * np.pi, FOURIER), np.zeros(0), np.array([0.0, 1.0]), np.array([0.5, 0.5]),
    )
    size = 1 + d + FOURIER
    shared = spark.sparkContext.broadcast(model)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = _array(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            z = np.column_stack([shared.value.features(x), y])
            for f in np.unique(fold):
                total[int(f)] = total.get(int(f), 0) + z[fold == f].T @ z[fold == f]
        for f, m in total.items():
            n = m.size
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, f, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(m.ravel())],
                names=["fold", "cell", "v"],
            )

    parts = labelled.selectExpr("x", "cast(y as double) as y", "cast(fold as int) as fold")
    found = parts.mapInArrow(equations, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v"))
    sums = np.zeros((FOLDS, (size + 1) ** 2))
    for r in found.collect():  # FOLDS * (size + 1)^2 rows at most
        sums[r["fold"], r["cell"]] = r["v"]
    sums = sums.reshape(FOLDS, size + 1, size + 1)

    def solve(m: np.ndarray) -> np.ndarray:
        penalty = RIDGE * max(m[0, 0], 1.0) * np.eye(size)
        penalty[0, 0] = 1e-9
        return np.linalg.solve(m[:size, :size] + penalty, m[:size, size])

    if not sums[:, 0, 0].sum():
        model.weights = np.zeros(size)
        return model
    apart = [solve(sums.sum(axis=0) - sums[f]) for f in range(FOLDS)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold = _array(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            raw = np.choose(fold, [shared.value.raw(x, w) for w in apart])
            at = np.clip((raw - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], names=["bin", "y"])

    bins = parts.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(
        F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")
    ).orderBy("bin").toPandas()
    at = _LOW + (bins["bin"].to_numpy() + 0.5) * (_HIGH - _LOW) / BINS
    n = bins["n"].to_numpy(float)
    model.weights = solve(sums.sum(axis=0))
    # one half pseudo count a block keeps scores inside (0, 1)
    model.at, model.chance = at, np.clip(isotonic(bins["good"].to_numpy(float) / n, n), 1e-3, 1 - 1e-3)
    return model


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Id and `score` (0 to 1) for every row of `stats`."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kind = stats.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                value = shared.value.score(_array(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["id", "score"])

    return (
        stats.selectExpr(f"`{id_col}` as id", "x").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    )


def train_on(
    docs: DataFrame, labels: DataFrame, train_where: str = "true", id_col: str = "doc_id", text_col: str = "text",
    stats: DataFrame | None = None,
) -> Model:
    """A model from the statistics of `docs` and the labels (id, `quality`) that meet `train_where`."""
    if stats is None:
        stats = stored(statistics(docs, id_col, text_col), "statistics", wide=True)
    known = labels.where(train_where).where("quality is not null").selectExpr(f"`{id_col}`", "quality as y")
    fold = f"cast(crc32(concat('fold', cast(`{id_col}` as string))) % {FOLDS} as int)"
    return train(stats, stats.join(known, id_col).selectExpr("x", "y", f"{fold} as fold"))


def classify(
    docs: DataFrame, labels: DataFrame, train_where: str = "true", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id and `score` for every row of `docs`."""
    stats = stored(statistics(docs, id_col, text_col), "statistics", wide=True)
    return score(stats, train_on(docs, labels, train_where, id_col, text_col, stats), id_col)


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, text_col, 2 << 20):
                yield part.filter(pa.array(shared.value.score(measure(part.column(place))) >= least))

    return docs.mapInArrow(run, docs.schema)
