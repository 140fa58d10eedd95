"""Row transforms over streams, and counts per event-time window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.transforms import Transform


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """A folder's files as a stream; a single file is one of its folder's, chosen by name."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).load(p.getParent().toString())
    return reader.load(path)


def filtered(stream: DataFrame, transform: Transform, column: str = "text") -> DataFrame:
    """The same plan as over a table: transforms hold no state."""
    return transform.apply(stream, column)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, keys…, n per window; rows later than the watermark are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    counted = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def write_jsonl(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what there is and ends; a rerun goes on from the checkpoint."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, a temporary one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its result as a table; in the modes append and complete."""
    spark = stream.sparkSession
    base = scratch(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    result = spark.read.schema(stream.schema).parquet(f"{base}/out")
    return result.select(*stream.columns)
