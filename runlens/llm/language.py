"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every ASCII character that is no letter counts as a space, and runs of
one, two and three characters (the last ones padded) are hashed to `BUCKETS` buckets a length.
Counts by language come from all training rows: tasks add up their rows, Spark sums the tasks.
The matrix of log probabilities (3 * BUCKETS rows of one float per language) is broadcast; its
size is bounded by `MAX_LANGUAGES`. Scoring gathers the rows of all n-grams of a batch at once
and adds them up by text.

Null text and text without a letter: `und` with score 0. No training rows: `und` everywhere.
Rows with a null language are not learned from. Ties go to the language first by name.
Repeated rows count and score as often as they occur; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import words

BUCKETS = 1 << 15
LENGTHS = 3
SMOOTHING = 0.5
MAX_LANGUAGES = 256
UNKNOWN = "und"

_ODD = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, two zeros behind each; start and end of each text."""
    lowered = [(t or "").lower() for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(f"{t}\0\0" for t in lowered).encode("utf-32-le"), np.uint32).copy()
    codes[(codes < 128) & ((codes < 97) | (codes > 122)) & (codes > 0)] = 32
    start = np.cumsum(size + 2) - size - 2
    return codes, start, start + size


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each length, the bucket of the n-gram that starts at each code."""
    mixed = codes * _ODD[0]
    for k in range(LENGTHS):
        if k:
            mixed = mixed[:-1] * _ODD[k] + codes[k:] * _ODD[0]
        high = mixed ^ (mixed >> np.uint32(15))
        yield (high * _ODD[1] >> np.uint32(17)).astype(np.int64) + k * BUCKETS


def _inside(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    step[start] += 1
    step[end] -= 1
    return np.cumsum(step[:n]) > 0


def counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n: n-grams of all rows (`text`, `lang`) by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in words.pieces(batch, "text"):
                codes, start, end = _codes(part.column(0).to_pylist())
                names, which = np.unique(np.asarray(part.column(1).to_pylist(), object), return_inverse=True)
                owner = np.repeat(which, end - start)
                inside = np.flatnonzero(_inside(len(codes), start, end))
                for bucket in _buckets(codes):
                    for i, name in enumerate(names):
                        held = inside[owner == i]
                        held = held[held < len(bucket)]
                        into = total.setdefault(name, np.zeros(LENGTHS * BUCKETS, np.int64))
                        into += np.bincount(bucket[held], minlength=len(into))
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
                names=["lang", "bucket", "n"],
            )

    return rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")
    )


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (bucket x language) and log priors.

    rows: `text`, `lang`, both not null.
    """
    docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(docs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(docs)
    table = np.zeros((LENGTHS * BUCKETS, len(names)))
    found = counts(rows).toPandas()  # at most LENGTHS * BUCKETS rows a language
    table[found["bucket"], np.searchsorted(names, found["lang"]) if names else []] = found["n"]
    table = table.reshape(LENGTHS, BUCKETS, len(names)) + SMOOTHING
    table = np.log(table / table.sum(axis=1, keepdims=True)).reshape(LENGTHS * BUCKETS, len(names))
    prior = np.array([docs[n] for n in names], float)
    return names, table.astype(np.float32), np.log(prior / max(prior.sum(), 1))


def score(texts: list[str | None], names: list[str], table: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability by text."""
    best, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not names or not texts:
        return best, sure
    codes, start, end = _codes(texts)
    inside = np.flatnonzero(_inside(len(codes), start, end))
    total = np.zeros((len(inside), len(names)), np.float32)
    for bucket in _buckets(codes):
        total += table[bucket[inside]]
    full = np.flatnonzero(end > start)
    begin = np.cumsum(end - start) - (end - start)
    if len(full):
        # in double precision and text by text: the same whatever else is in the batch
        likely = np.add.reduceat(total, begin[full], axis=0, dtype=np.float64) + prior
        chance = np.exp(likely - likely.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        for i, row in zip(full, chance, strict=True):
            if any(map(str.isalpha, texts[i])):
                at = int(row.argmax())
                best[i], sure[i] = names[at], row[at]
    return best, sure


def identify(docs: DataFrame, train_on: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, `lang_pred` and `score` for every row of `docs`; learned from `train_on` (text, lang)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(train_on.select("text", "lang").dropna()))
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, prior = model.value
        for batch in batches:
            for part in words.pieces(batch, "text", 1 << 20):
                best, sure = score(part.column(1).to_pylist(), names, table, prior)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(best, pa.string()), pa.array(sure)], names=["id", "lang_pred", "score"]
                )

    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
