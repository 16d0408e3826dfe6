"""Helpers of this folder: stored intermediate tables, gapless numbers, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillset.session import small_batches


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one of our own only when it is unset and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables written once to the shared folder, so that lost executors cost nothing but the running tasks.

    Reading a stored table again prunes columns and pushes filters, which an RDD checkpoint cannot. ``forget`` deletes a
    table that no later step reads; what the returned rows still read stays for the cluster to clear. ``batch_rows`` bounds the rows that go to
    Python at once while a table is stored.
    """

    def __init__(self, spark: SparkSession, label: str, batch_rows: int | None = None):
        self.spark, self.batch_rows = spark, batch_rows
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark, self.batch_rows) if self.batch_rows else nullcontext():
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def settle(self, rounds: int = 2, pause: float = 1) -> None:
        """Let Spark delete the shuffle files of steps that are stored: it does so once neither Python nor the JVM holds their plans.

        Python and the listeners give theirs up in the background and one after the other, hence the pauses.
        """
        for _ in range(rounds):
            gc.collect()
            time.sleep(pause)
            self.spark._jvm.System.gc()

    def forget(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def own_columns(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only what an operator needs, under its own names: further columns of the input, whatever their names, cannot clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def gapless(df: DataFrame, group: str, part: str, order: list[str], into: str) -> DataFrame:
    """Number the rows of each ``group`` 0, 1, ... without gathering a group in one task.

    Every group is made of parts; rows are counted per part, parts get running offsets, and only the rows of one part are
    sorted together.
    """
    sizes = df.groupBy(group, part).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, part).orderBy(*order)
    placed = df.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = placed.join(offsets, [group, part])
    return joined.withColumn(into, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_before", "_inside")


def components(scratch: Scratch, edges: DataFrame, label: str, most_rounds: int = 60, roots: bool = True) -> DataFrame:
    """Smallest vertex reachable from every vertex of ``edges`` (a, b BIGINT); vertices without an edge are absent, and without ``roots``
    those that are the smallest themselves.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every step is a minimum per vertex followed by a
    join back, so a vertex with very many neighbours is pre-aggregated and its join can be split. Each round is stored, the
    loop ends once a round changes nothing.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.store(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{label}-0")
    state, previous = None, None
    for step in range(1, most_rounds + 1):
        both = now.select("a", "b").unionAll(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Rows that repeat, never more than the edges, are left to the one distinct below.
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).filter("a != b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        small = linked.unionAll(low.select("a", F.col("m").alias("b"))).filter("a != b")
        now = scratch.store(small.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{label}-{step}")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if previous:
            scratch.forget(previous)
        if tuple(found) == state:
            break
        state, previous = tuple(found), f"{label}-{step - 1}"
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    others = now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return others.unionAll(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()) if roots else others


def outside(spans: list[tuple], covers: list[tuple[int, int]]) -> set[tuple]:
    """Those of ``spans`` (start, end, ...) that lie inside none of ``covers`` (start, end). Both are walked once, in order of their starts:
    of the covers begun so far only the one that reaches furthest matters."""
    begun, reach, kept = 0, -1, set()
    ahead = sorted(covers)
    for span in sorted(spans):
        while begun < len(ahead) and ahead[begun][0] <= span[0]:
            reach, begun = max(reach, ahead[begun][1]), begun + 1
        if span[1] > reach:
            kept.add(span)
    return kept
