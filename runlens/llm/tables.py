"""Tables, intermediate results and connected groups shared by the operators."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Settings of a session that runs these operators.

    Rows and bytes of an Arrow batch are bounded, so that Python workers hold little of long
    texts; workers find this package where the driver has it, also from another folder. Shuffle files
    go as soon as the query that wrote them has ended, not when the driver happens to collect its garbage.
    """
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(filter(None, [root, paths.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; where it is unset, the warehouse's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def stored(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: survives lost executors, cuts lineage.

    Two tasks a core write it, so that files stay few however many shuffle partitions there are;
    `wide` keeps one task a partition, for tables of whole texts.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    few = df if wide else df.coalesce(2 * max(4, spark.sparkContext.defaultParallelism))
    few.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: largest side of a join that is broadcast, in rows of a few numbers (some ten bytes each)
BROADCAST_ROWS = 1_000_000


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner join that broadcasts `small`, a stored table, if its counted rows are few enough.

    Beyond that both sides are shuffled: the same result in another way.
    """
    few = small.count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on)


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable by links, for every id.

    nodes: one column `id` of any type that has an order; links: `a`, `b` (either order,
    repeats allowed, unknown ids ignored by the final join). Alternating large-star and small-star steps:
    every step is a partial minimum and a join on an id, so a hub with a third of all
    links is combined before the shuffle and split by the adaptive join. Each step's
    edges are written to the shared folder. Returns `id`, `component_id`.
    """
    spark = nodes.sparkSession
    edges = stored(
        links.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        # the sum tells whether a step changed anything: stars only ever lower their roots
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        root = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        # large star: neighbours above a node hang under the node's smallest neighbour
        large = (
            both.join(root, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        )
        # small star: a node and its smaller neighbours hang under the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(
            large.join(low, "u")
            .selectExpr("inline(array(struct(v as u, m as v), struct(u as u, m as v)))")
            .where("u <> v")
            .distinct(),
            "edges",
        )
    else:
        raise RuntimeError(f"links not resolved in {rounds} rounds")
    found = edges.groupBy("u").agg(F.min("v").alias("root"))
    return (
        nodes.join(found, nodes["id"] == found["u"], "left")
        .select(nodes["id"], F.coalesce("root", nodes["id"]).alias("component_id"))
    )


def free_name(columns: list[str], name: str) -> str:
    """`name`, or it with so many underscores behind that no column is called alike."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_own_key(docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """`docs` with a bigint column `key` that no two rows share: the id, or a number of its own
    for a row whose id is null or repeated. Those numbers sort first; such rows are written once.
    """
    own, again = F.col(f"`{id_col}`").cast("bigint"), free_name(docs.columns, "again")
    repeated = docs.select(own.alias(key)).groupBy(key).count().where(f"count > 1 and `{key}` is not null").select(key)
    repeated = stored(repeated.withColumn(again, F.lit(True)), "repeated-ids")
    known = docs.withColumn(key, own)
    if not repeated.isEmpty():
        known = known.join(repeated, key, "left")
    else:
        known = known.withColumn(again, F.lit(None).cast("boolean"))
    numbered = F.monotonically_increasing_id() + F.lit(1 - (1 << 63)) - F.lit(1)
    odd = F.col(f"`{again}`") | F.col(f"`{key}`").isNull()
    columns = [*docs.columns, key]
    rest = known.where(odd).select(*[f"`{c}`" for c in docs.columns]).withColumn(key, numbered)
    plain = known.where(f"`{again}` is null and `{key}` is not null").select(*[f"`{c}`" for c in columns])
    return plain.unionByName(stored(rest, "numbered-rows", wide=True))


def with_row_key(docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """`docs` with a bigint column `key`: the id or, for a row whose id is null, a number of its own.

    Those numbers go up from the smallest bigint, so they sort first. Rows without an id are
    written once, so that every pass sees the same numbers.
    """
    own = F.col(f"`{id_col}`").cast("bigint")
    nameless = docs.where(own.isNull())
    if nameless.isEmpty():
        return docs.withColumn(key, own)
    number = F.monotonically_increasing_id() + F.lit(1 - (1 << 63)) - F.lit(1)
    return docs.where(own.isNotNull()).withColumn(key, own).unionByName(
        stored(nameless.withColumn(key, number), "nameless-rows", wide=True)
    )
