"""Block stores (chunked Parquet with a manifest), dataset recipes and weighted mixing."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .transforms import number_rows

CHUNK_BLOCKS = 4096


def chunked(blocks: DataFrame, chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    return blocks.withColumn("chunk_id", F.floor(F.col("block_id") / chunk_blocks).cast("bigint"))


def save(blocks: DataFrame, path: str, chunk_blocks: int = CHUNK_BLOCKS, mode: str = "errorifexists") -> None:
    """Writes one directory per chunk, zstd-compressed; mode ``append`` adds chunks to a store."""
    b = chunked(blocks, chunk_blocks)
    b.repartition("chunk_id").sortWithinPartitions("chunk_id", "block_id").write.mode(mode).option("compression", "zstd").partitionBy("chunk_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def manifest(blocks: DataFrame, chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """chunk_id, n_items, n_tokens, min_length, max_length, first_block, last_block."""
    n = F.size("input_ids").cast("bigint")
    return chunked(blocks, chunk_blocks).groupBy("chunk_id").agg(
        F.count("*").alias("n_items"), F.sum(n).alias("n_tokens"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block")
    )


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, filesize, sha1 of each data file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("filesize"), F.sha1("content").alias("sha1"))


def validate(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """file, status (missing, changed or unknown) of the files that a manifest of earlier doesn't vouch for."""
    now = file_manifest(spark, path).withColumnsRenamed({"filesize": "size_now", "sha1": "sha1_now"})
    both = known.join(now, "file", "full_outer")
    status = F.when(F.col("size_now").isNull(), "missing").when(F.col("filesize").isNull(), "unknown").when((F.col("filesize") != F.col("size_now")) | (F.col("sha1") != F.col("sha1_now")), "changed")
    return both.select("file", status.alias("status")).where("status IS NOT NULL")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """In a repeatable random order; the seed takes the part of a random state."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def subblocks(blocks: DataFrame, length: int) -> DataFrame:
    """Blocks cut into pieces of ``length``; a remainder that fills none is left out. sub_no counts within a block."""
    if length < 1:
        raise ValueError("length must be positive")
    k = F.floor(F.size("input_ids") / length).cast("int")
    parts = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice("input_ids", i * length + 1, F.lit(length))))
    return blocks.select("block_id", F.posexplode(parts).alias("sub_no", "sub_ids")).select("block_id", F.col("sub_no").cast("bigint").alias("sub_no"), F.col("sub_ids").alias("input_ids"))


def rotated(df: DataFrame, start: float, n_chunks: int, chunk: str = "chunk_id") -> DataFrame:
    """chunk_pos: chunk numbers after a rotation that begins at ``start``, a number or a fraction below 1."""
    s = int(start * n_chunks) if isinstance(start, float) and start < 1 else int(start)
    return df.withColumn("chunk_pos", F.pmod(F.col(chunk) - F.lit(s % max(n_chunks, 1)), F.lit(max(n_chunks, 1))))


def rank_shard(df: DataFrame, rank: int, world: int, pos: str = "chunk_pos") -> DataFrame:
    if not 0 <= rank < world:
        raise ValueError("rank must lie in 0 … world - 1")
    return df.where(F.pmod(F.col(pos), F.lit(world)) == rank)


_UNITS = {"": 1, "k": 10**3, "m": 10**6, "b": 10**9, "g": 10**9, "t": 10**12}


def token_amount(amount: str | float) -> int:
    """'10M', '1.5B', '250' and integers are numbers of tokens; a float counts in billions."""
    if isinstance(amount, float):
        return int(amount * 10**9)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmbgt]?)\s*", str(amount).lower())
    if not m:
        raise ValueError(f"not an amount of tokens: {amount!r}")
    return int(float(m[1]) * _UNITS[m[2]])


def resize(blocks: DataFrame, n: int, block_size: int | None = None, tokens: str | float | None = None, ratio: float | None = None, order: str = "block_id") -> DataFrame:
    """n blocks repeated or cut to ceil(tokens / block_size), or to ceil(n * ratio); ``copy`` counts the repetitions."""
    want = math.ceil(token_amount(tokens) / block_size) if tokens is not None else math.ceil(n * (1 if ratio is None else ratio))
    copies, rest = divmod(want, max(n, 1))
    numbered = number_rows(blocks, [order], "_row")
    times = F.lit(copies) + F.when(F.col("_row") < rest, 1).otherwise(0)
    full = numbered.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    return full.withColumn("copy", F.col("copy").cast("bigint")).drop("_row")


def quotas(sizes: dict[str, int], batch_size: int = 1024) -> dict[str, int]:
    """Blocks of each source in a batch, in proportion to its size (rounded half to even); zero quotas vanish."""
    total = sum(sizes.values())
    q = {k: round(batch_size * v / total) for k, v in sizes.items()} if total else {}
    return {k: v for k, v in q.items() if v}


def mix(sources: dict[str, DataFrame], sizes: dict[str, int], batch_size: int = 1024, seed: int = 42, order: str = "block_id", batches: int | None = None, skip: int = 0) -> DataFrame:
    """batch_no, slot, source, and the source's columns: batches with fixed quotas, slots in hashed order.

    Every source is numbered on its own; row r of a source with quota q is in batch r // q. ``batches``
    is as many as the largest epoch needs by default, shorter sources starting over. ``skip`` leaves out
    the batches already trained on.
    """
    q = quotas(sizes, batch_size)
    last = max((math.ceil(sizes[k] / q[k]) for k in q), default=0) if batches is None else batches
    parts = []
    for name, k in q.items():
        n = sizes[name]
        numbered = number_rows(sources[name], [order], "_row")
        epochs = math.ceil(last * k / n)
        again = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(epochs - 1, 0))))).withColumn("_at", F.col("_row") + F.col("epoch") * n)
        parts.append(again.select(F.floor(F.col("_at") / k).cast("bigint").alias("batch_no"), F.lit(name).alias("source"), (F.col("_at") % k).alias("_in"), *sources[name].columns).where((F.col("batch_no") < last) & (F.col("batch_no") >= skip)))
    if not parts:
        raise ValueError("no source is large enough for a place in a batch")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("batch_no").orderBy(F.xxhash64("source", "_in", F.lit(seed)), "source", "_in")
    return rows.withColumn("slot", (F.row_number().over(w) - 1).cast("bigint")).drop("_in")


def trained_counts(mixed: DataFrame) -> DataFrame:
    return mixed.groupBy("source").agg(F.count("*").alias("n"))


def collate(df: DataFrame, max_length: int, ids: str = "input_ids") -> DataFrame:
    """input_ids cut to max_length, an attention_mask of ones, and labels equal to the inputs."""
    cut = F.slice(ids, 1, max_length)
    return df.withColumn("input_ids", cut.cast("array<int>")).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).withColumn("labels", F.col("input_ids"))


def freeze(blocks: DataFrame, path: str, max_length: int, mode: str = "errorifexists") -> None:
    """Writes what collate() makes of the blocks, as Parquet."""
    collate(blocks, max_length).select("input_ids", "attention_mask", "labels").write.mode(mode).option("compression", "zstd").parquet(path)


HEADER_BASE, HEADER_VERSION = 8, 1


def split_seq2seq(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """(input_ids, labels) of rows whose first integer v packs a version (v % 8 = 1) and the input's length (v // 8)."""
    head = F.get(F.col(ids), F.lit(0))
    packed = F.pmod(head, F.lit(HEADER_BASE)) == HEADER_VERSION
    n = F.floor(head / HEADER_BASE).cast("int")
    size = F.size(ids)
    return df.select(
        *[c for c in df.columns if c not in (ids, "labels")],
        F.when(packed, F.slice(ids, F.lit(2), n)).otherwise(F.col(ids)).alias("input_ids"),
        F.when(packed, F.slice(ids, n + 2, F.greatest(size - n - 1, F.lit(0)))).otherwise(F.col(ids)).alias("labels"),
    )


def join_seq2seq(inputs: Column, labels: Column) -> Column:
    return F.concat(F.array((F.size(inputs) * HEADER_BASE + HEADER_VERSION).cast("int")), inputs, labels)


def token_stat(df: DataFrame, vocab: DataFrame | None = None, ids: str = "input_ids") -> DataFrame:
    """token_id, count, of the inputs and of labels where there are any; with a vocabulary (token_id, token)
    every entry of it, also those never used."""
    every = F.concat(ids, F.coalesce("labels", F.array().cast("array<int>"))) if "labels" in df.columns else F.col(ids)
    n = df.select(F.explode(every).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("count"))
    if vocab is None:
        return n
    return vocab.join(n, "token_id", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))


def span_masks(df: DataFrame, sentinel: int, keep: set[int] | frozenset[int] = frozenset(), mean: float = 3.0, seed: int = 42, key: str = "block_id", ids: str = "input_ids") -> DataFrame:
    """input_ids and labels of blocks cut into spans of Poisson lengths, which go to the inputs and the labels by turns.

    Where a span goes to the labels, a sentinel stands for it in the inputs, and before it in the
    labels; sentinels count down from ``sentinel``. A span that holds one of the tokens to ``keep``
    (an end of text, a line break) goes to both. The lengths follow from the key and the seed.
    """

    def cut(row_key: int, tokens: np.ndarray) -> dict:
        rng = np.random.default_rng([seed, int(row_key) % 2**63])
        inputs, labels, at, turn, mark = [], [], 0, 0, sentinel
        while at < len(tokens):
            n = max(1, int(rng.poisson(mean)))
            span = [int(t) for t in tokens[at : at + n]]
            if turn % 2 == 0:
                inputs += span
            else:
                inputs.append(mark)
                labels += [mark, *span]
                mark -= 1
                if keep.intersection(span):
                    inputs += span
            at, turn = at + n, turn + 1
        return {"input_ids": inputs, "labels": labels}

    @F.pandas_udf("input_ids array<int>, labels array<int>")
    def run(k: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(a, b) for a, b in zip(k, tokens, strict=True)], columns=["input_ids", "labels"])

    made = df.withColumn("_cut", run(F.col(key), F.col(ids)))
    return made.withColumn(ids, F.col("_cut.input_ids")).withColumn("labels", F.col("_cut.labels")).drop("_cut")
