"""Spark plumbing of the operators: shared folder, lineage cuts, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the folder of spark.checkpoint.dir, a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared folder, and cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, for large results that several plans read.

    Unlike a checkpoint it is read column by column. The files go when the application ends.
    """
    spark = df.sparkSession
    shared_folder(spark)
    name = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stage-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(name)
    return spark.read.schema(df.schema).parquet(name)


def file_states(df: DataFrame) -> list[str]:
    """Path, size and time of change of each file that df reads."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return found


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps, which otherwise stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what the first round lets go of holds on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and the named columns), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's connected component.

    Alternating large-star and small-star steps over the edge list; each step is one shuffle of the
    edges by node, and a hub of any degree is handled by a sorted (spilling) window.
    Nodes without an edge to another node are absent. Null ends are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least(F.min("v").over(w), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(w))
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("connected components did not settle")
