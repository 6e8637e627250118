"""Links between entries that share index keys, in proportion to the keys even inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tables import components, join_checked, stored

Verify = Callable[[DataFrame], DataFrame]


def links_through_keys(
    entries: DataFrame, fits: str, prepare: Callable[[DataFrame], tuple[Verify, DataFrame]], close: str
) -> DataFrame:
    """Pairs (x, y) of entries that connect the same groups as all similar pairs that share a key.

    entries: key, s (the entry), and columns that `fits` compares, a condition on the aliases u
    and v. prepare: gets the entries (id) that share a key, and gives a function from pairs (x, y)
    to those that are similar, and marks: s and columns for `close`, a further condition on u and v that
    no similar pair fails.

    Every entry of a key is compared with the key's pivot, the entry that meets most others over
    all its keys: in a group of edited copies the one with fewest edits, near which most others
    lie. Linked ones are one group. Only entries that are in another group than their pivot are then
    compared with the key's others: of a group of copies, none; of edited copies, those too far
    from the pivot, and of these pairs `close` leaves few. Keys are combined by partial
    aggregates and joined, so a frequent key is split like any skewed join.
    """
    # counts alone, of few bytes, tell which keys have several rows; those of one entry go below
    ends = stored(entries.groupBy("key").count().where("count > 1").select("key"), "shared-ends")
    shared = stored(join_checked(entries, ends, "key").dropDuplicates(["key", "s"]), "shared-keys")
    # keys held by the same entries are one: what can be shared by any of them decides
    same = shared.groupBy("key").agg(
        F.xxhash64(F.bit_xor(F.xxhash64("s")), F.bit_xor(F.xxhash64("s", F.lit(1))), F.count(F.lit(1))).alias("holders"),
        F.count(F.lit(1)).alias("met"),
    ).where("met > 1")
    others = [c for c in shared.columns if c not in ("key", "s")]
    merged = shared.join(same, "key").groupBy("holders", "s").agg(F.sum("met").alias("met"), *[F.max(c).alias(c) for c in others])
    merged = stored(merged.withColumnRenamed("holders", "key"), "shared-holders")
    nodes = stored(merged.groupBy("s").agg(F.sum("met").alias("met")), "shared-nodes")
    pivots = merged.drop("met").join(nodes, "s").groupBy("key").agg(F.max(F.struct("met", "s")).alias("p"))
    shared = stored(merged.drop("met").join(pivots.selectExpr("key", "p.s as p"), "key"), "pivot-keys")
    nodes = nodes.select(F.col("s").alias("id"))
    verify, marks = prepare(nodes)
    pivots = shared.where("s = p")
    star = shared.where("s <> p").alias("u").join(pivots.alias("v"), "key").where(fits)
    near = stored(verify(star.selectExpr("v.s as x", "u.s as y").distinct()), "links")
    groups = components(nodes, near.selectExpr("x as a", "y as b")).selectExpr("id as s", "component_id as c")
    groups = stored(groups, "entry-groups")
    known = shared.join(groups, "s")
    roots = known.where("s = p").selectExpr("key", "c as r")
    placed = stored(known.join(roots, "key").join(marks, "s"), "placed-keys")
    far = (
        placed.where("c <> r").alias("u").join(placed.where("s <> p").alias("v"), "key")
        .where(f"u.c <> v.c and (v.c = v.r or u.s < v.s) and {fits} and {close}")
        .selectExpr("least(u.s, v.s) as x", "greatest(u.s, v.s) as y").distinct()
    )
    # each group of the first links as a star: as many links as entries
    stars = groups.where("s <> c").selectExpr("s as x", "c as y")
    return stars.unionByName(stored(verify(far), "links"))
