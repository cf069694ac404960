"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bound a Python worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of very long texts still fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="rasterflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables whose readers are written themselves; others than those of materialize stay."""
    for t in tables:
        if at := getattr(t, "stored_at", None):
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """What opens a path of the shared folder from Python, on the driver or a worker."""
    if urlsplit(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(nodes_edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected links.

    nodes_edges: columns a, b (long). Returns node, comp for every node that has a link; comp is the
    smallest node reachable. Alternating large-star and small-star rounds over written tables: each
    round halves the path length, links never reach the driver. Self links and repeats are harmless;
    null ends are dropped. An empty table gives an empty result.
    """
    links = (
        nodes_edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    links = materialize(links, name)
    given, olds = links, []
    mark = None
    while True:
        both = links.union(links.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour goes to the smallest one
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, links = links, materialize(small, name)
        olds.append(old)
        # a star forest has one link for each node that isn't a root, and no root with a parent
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
        discard(*[t for t in olds if t is not given])
        olds = []
    nodes = given.select(F.col("u").alias("node")).union(given.select(F.col("v").alias("node"))).distinct()
    out = materialize(
        nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), f"{name}-part"
    )
    discard(given, links)
    return out
