"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

Equal vectors of one label are one entry with a multiplicity. A table hashes an entry with
`FUNCTIONS` pseudo-random rotations (three rounds of random signs and a Walsh-Hadamard
transform): the hash of each is the axis, with sign, nearest to the rotated vector. The entry is
stored in the bucket of its hashes and looks into its `PROBES` likeliest buckets, those that
replace a hash by the axis that comes next. What shares a bucket, a label and a length in any of
`TABLES` tables is verified: cosine in double precision.

Vectors that are null, zero, or hold a null or non-finite component, and those with a null
label, link with nothing and are their own group. Vectors of different length never link. Rows
that share an id are separate vectors with that id, a result row each. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tables import components, stored

TABLES = 16
FUNCTIONS = 3
PROBES = 8
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (ROUNDS, x.shape[1]))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(x.shape[1])
    return x


def buckets(x: np.ndarray, table: int, functions: int = FUNCTIONS, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of every row, the likeliest first: rows x probes."""
    n, d = x.shape
    axes, gaps = [], []
    for f in range(functions):
        y = rotate(x, 1000 * table + f)
        near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
        value = np.take_along_axis(y, near, axis=1)
        axes.append(2 * near + (value < 0))
        size = np.abs(value)
        gaps.append((size[:, :1] - size) ** 2 if size.shape[1] > 1 else np.zeros((n, 1)))
    choices = list(product(*[range(a.shape[1]) for a in axes]))
    code = np.stack([sum(axes[f][:, c] * (2 * d) ** f for f, c in enumerate(choice)) for choice in choices], axis=1)
    cost = np.stack([sum(gaps[f][:, c] for f, c in enumerate(choice)) for choice in choices], axis=1)
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(code, order, axis=1) * 64 + table


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), size)


def _hashed(entries: DataFrame) -> DataFrame:
    """rep, label, size, bucket, first: `first` marks the bucket that stores the entry."""
    label = entries.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, labels, sizes = batch.column(0), batch.column(1), np.asarray(batch.column(2))
            for size in np.unique(sizes):
                for at in np.array_split(np.flatnonzero(sizes == size), max(1, (sizes == size).sum() // 2000)):
                    x = _matrix(batch.column(3).take(pa.array(at)), size)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = np.pad(x, ((0, 0), (0, (1 << max(1, int(size - 1).bit_length())) - size)))
                    for table in range(TABLES):
                        found = buckets(x, table)
                        k = found.shape[1]
                        take = pa.array(np.repeat(at, k))
                        yield pa.RecordBatch.from_arrays(
                            [
                                rep.take(take), labels.take(take), pa.array(np.full(len(take), size, np.int32)),
                                pa.array(found.ravel()), pa.array(np.tile(np.arange(k) == 0, len(at))),
                            ],
                            names=["rep", "label", "size", "bucket", "first"],
                        )

    return entries.select("rep", "label", "size", "v").mapInArrow(
        run, f"rep bigint, label {label}, size int, bucket bigint, first boolean"
    )


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows are scaled first, so that no square overflows."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _verified(pairs: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                near = pa.array(cosines(_matrix(part.column(3), size), _matrix(part.column(4), size)) >= least)
                yield part.select([0, 1]).filter(near)

    left = entries.selectExpr("rep as a", "size", "v as x")
    right = entries.selectExpr("rep as b", "v as y")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "size", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint")


def links(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector: id, `n_links`, `component_id`, `kept`."""
    rows = vectors.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{label_col}` as label", f"`{vector_col}` as v")
    fit = (
        "id is not null and label is not null and size(v) > 0 and exists(v, x -> x <> 0)"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < cast('infinity' as double))"
    )
    usable = rows.where(fit)
    entries = usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # an entry has a number of its own: ids may repeat; written once, so every step sees the same numbers
    numbered = entries.withColumn("size", F.size("v")).withColumn("rep", F.monotonically_increasing_id())
    entries = stored(numbered, "vector-entries")
    hashed = stored(_hashed(entries), "vector-buckets")
    keys = ["label", "size", "bucket"]
    pairs = (
        hashed.where("first").withColumnRenamed("rep", "p").join(hashed.withColumnRenamed("rep", "q"), keys)
        .where("p <> q").selectExpr("least(p, q) as a", "greatest(p, q) as b").distinct()
    )
    near = stored(_verified(pairs, entries, least), "vector-links")
    # a hub's links are summed before they meet
    copies = entries.select("rep", "copies")
    both = near.selectExpr("inline(array(struct(a as rep, b as other), struct(b as rep, a as other)))")
    linked = both.join(copies.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("copies").alias("more"))
    members = components(copies.selectExpr("rep as id"), near).selectExpr("id as rep", "component_id as root")
    members = stored(members.join(entries.select("rep", "id"), "rep"), "vector-members")
    groups = members.join(members.groupBy("root").agg(F.min("id").alias("c")), "root").select("rep", "c")
    of_entry = entries.join(groups, "rep").join(linked, "rep", "left").selectExpr(
        "label", "v", "copies - 1 + coalesce(more, 0) as n", "c"
    )
    found = usable.join(of_entry, ["label", "v"]).select("id", "n", "c")
    alone = rows.where(f"not coalesce({fit}, false)").selectExpr("id", "0L as n", "id as c")
    return found.unionByName(alone).selectExpr(f"id as `{id_col}`", "n as n_links", "c as component_id", "id <=> c as kept")
