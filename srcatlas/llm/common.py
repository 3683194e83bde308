"""What the operators of this subpackage share: written intermediate tables and small sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this class.
SPACE = " \t\n\x0b\x0c\r"
#: Input bytes that one shuffle partition should hold.
PARTITION_BYTES = 32 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where unset, a fresh one if all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="srcatlas-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(saved: DataFrame) -> None:
    """Delete a table that `save` wrote, once nothing reads it any more."""
    jvm, conf = saved.sparkSession._jvm, saved.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in saved.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def join_classes(rows: DataFrame, classes: DataFrame, key: list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """`rows` left-joined to `classes` (one row for each key, `size` rows each) without crowding a hot class into one task.

    A class of at least a `share`-th of the `total` rows is joined by broadcast: there are at most
    `share` of these, whatever the size of the tables.  All others are joined by a shuffle.
    """
    hot = F.col(size) * share >= total
    big = F.broadcast(classes.where(hot))
    cold = rows.join(F.broadcast(classes.where(hot).select(*key)), key, "left_anti").join(classes.where(~hot), key, "left")
    return rows.join(big, key).unionByName(cold)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) with component the smallest node reachable over edges (a, b).

    Alternating large-star and small-star rounds; a node's neighbours are only ever
    aggregated (min) and joined, never collected, so a node may have any number of them.
    Nodes without an edge do not appear.  Self loops and repeated edges change nothing.
    """
    current = save(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        last, current = current, save(small, "edges")
        discard(last)
        # The state is a fixed point once a round leaves the same edge set behind.
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    parents = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return parents.unionByName(roots.join(parents, "node", "left_anti"))
