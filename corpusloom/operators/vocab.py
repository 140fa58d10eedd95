"""Vocabularies of (piece, score), and counts for training tokenizers elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "▁"


def clean(vocab: DataFrame) -> DataFrame:
    """One row per piece; a piece with a leading meta space goes if the bare one is there too. Equal pieces keep the best score."""
    best = vocab.groupBy("piece").agg(F.max("score").alias("score"))
    bare = best.select(F.concat(F.lit(META), F.col("piece")).alias("piece"))
    return best.join(bare, "piece", "left_anti")


def remove(vocab: DataFrame, pieces: DataFrame) -> DataFrame:
    return vocab.join(pieces.select("piece").distinct(), "piece", "left_anti")


def add(vocab: DataFrame, pieces: DataFrame, missing: float = -20.0) -> DataFrame:
    """With the pieces that aren't there yet, at the mean score of pieces of equal length."""
    means = vocab.groupBy(F.length("piece").alias("n")).agg(F.avg("score").alias("mean"))
    new = pieces.select("piece").distinct().join(vocab.select("piece"), "piece", "left_anti").withColumn("n", F.length("piece"))
    return vocab.select("piece", "score").unionByName(new.join(means, "n", "left").select("piece", F.coalesce("mean", F.lit(missing)).alias("score")))


def byte_pieces(spark, score: float = -10.0) -> DataFrame:  # noqa: ANN001
    """<0x00> … <0xFF>."""
    return spark.range(256).select(F.format_string("<0x%02X>", F.col("id")).alias("piece"), F.lit(score).alias("score"))


def word_counts(df: DataFrame, column: str = "text", min_frequency: int = 2) -> DataFrame:
    """word, n of whitespace-separated words: all that training of a vocabulary has to know of a corpus."""
    words = df.select(F.explode(F.split(F.col(column), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)


def pair_counts(counts: DataFrame) -> DataFrame:
    """left, right, n of neighbouring characters, weighted by word frequency: the first step of pair merging."""
    chars = counts.select("n", F.filter(F.split("word", ""), lambda c: c != "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("left"), F.get("c", i + 1).alias("right")))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))
