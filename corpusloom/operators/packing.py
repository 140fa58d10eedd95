"""Packing token sequences into blocks of fixed length, and the statistics of a run.

The plain packer needs no state: with a global prefix sum of lengths (two levels: within range
partitions and over their totals) every token knows its block, so that pieces of documents meet in a
shuffle by block. Padding, truncation and overlap make the carry depend on content; those run one
sequence per shard in ``pack_stateful``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import code_points, lists, slices
from ..functions.tokenizers import tokenizer
from .transforms import range_part


def encode(df: DataFrame, name: str = "char", eos: int = 0, column: str = "text") -> DataFrame:
    """ids: the tokens of each text and an end-of-sequence token; null texts give the latter alone."""
    if name == "char":

        @F.arrow_udf("array<int>")
        def run(t: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return code_points(t, eos)

        return df.withColumn("ids", run(F.col(column)))
    ids = F.coalesce(tokenizer(name)(F.col(column)), F.array().cast("array<int>"))
    return df.withColumn("ids", F.array_append(ids, F.lit(eos)))


def offsets(df: DataFrame, order: str, size: Column, name: str = "offset") -> DataFrame:
    """The sum of ``size`` over all rows before each row in the order, without a single-task window.

    Ranges of ``order`` have fixed bounds; their sums are few rows.
    """
    parted = df.withColumn("_size", size.cast("bigint")).withColumn("_part", range_part(df, order))
    totals = parted.groupBy("_part").agg(F.sum("_size").alias("_total"))
    before = totals.select("_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_before"))
    within = F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parted.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(before), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before", "_size")


def pack(df: DataFrame, block_size: int = 2048, order: str = "doc_id", ids: str = "ids") -> DataFrame:
    """block_id, input_ids: full blocks of the concatenation in order; the rest that fills none is left out.

    Rows come sorted by ranges, so most blocks are cut from neighbouring rows where they lie. Only the
    pieces of blocks at either end of a stretch of rows are moved and put together.
    """
    placed = offsets(df.select(order, ids), order, F.size(ids)).select("offset", ids)
    cut = placed.mapInArrow(lambda batches: cut_blocks(batches, block_size), "block_id long, at long, input_ids array<int>")
    whole = F.size("input_ids") == block_size
    ends = cut.where(~whole).groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("at", "input_ids"))).alias("parts"))
    ends = ends.select("block_id", F.flatten(F.transform("parts", lambda p: p["input_ids"])).alias("input_ids")).where(whole)
    return cut.where(whole).select("block_id", "input_ids").unionAll(ends)


def cut_blocks(batches: Iterator[pa.RecordBatch], block_size: int) -> Iterator[pa.RecordBatch]:
    """(block_id, at, input_ids) of rows (offset, ids): blocks, and pieces of blocks where rows don't follow one another."""
    held, start = np.zeros(0, np.int32), 0  # what is cut so far ends in these tokens, from this place on

    def rows(first: int, tokens: np.ndarray, last: bool) -> tuple[pa.RecordBatch, np.ndarray, int]:
        """The blocks of the tokens from the place ``first`` on, and what is left; a last piece of a block goes too."""
        bounds = np.arange(first // block_size + 1, (first + len(tokens)) // block_size + 1) * block_size
        end = first + len(tokens) if last else bounds[-1] if len(bounds) else first
        at = np.unique(np.concatenate([[first], bounds[bounds < end]])) if end > first else np.zeros(0, np.int64)
        made = lists(tokens[: end - first], np.diff(np.append(at, end))) if len(at) else lists(tokens[:0], np.zeros(0, np.int64))
        batch = pa.RecordBatch.from_arrays([pa.array(at // block_size, pa.int64()), pa.array(at, pa.int64()), made], names=["block_id", "at", "input_ids"])
        return batch, tokens[end - first :].copy(), int(end)

    for batch in batches:
        for at, n in slices(tuple(batch.columns), 0, batch.num_rows):
            part = batch.slice(at, n)
            offset = part.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, upto = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            breaks = np.flatnonzero(offset[1:] != offset[:-1] + sizes[:-1]) + 1
            for s, e in zip([0, *breaks.tolist()], [*breaks.tolist(), n], strict=True):
                if start + len(held) != offset[s]:
                    yield rows(start, held, last=True)[0]
                    held, start = np.zeros(0, np.int32), int(offset[s])
                made, held, start = rows(start, np.concatenate([held, tokens[upto[s] : upto[e]]]), last=False)
                yield made
    yield rows(start, held, last=True)[0]


@dataclass(frozen=True)
class Options:
    block_size: int = 2048
    truncate_size: int = 0
    padding_size: int = 0
    overlap_size: int = 0
    newline: int = 10
    eos: int = 0
    vocab_size: int = 1 << 20


class Packer:
    """One shard's sequential packer; carries the rest of a text over to the next."""

    def __init__(self, options: Options):
        self.o = options
        self.carry: list[int] = []
        self.stats = dict.fromkeys(("texts", "tokens", "blocks", "padding_tokens", "truncated_tokens", "overlap_tokens", "line_blocks"), 0)

    def _padded(self, part: list[int]) -> list[int]:
        missing = self.o.block_size - len(part)
        if not 0 < missing <= self.o.padding_size:
            return part
        self.stats["padding_tokens"] += missing
        fill = [self.o.eos] * missing
        if missing > 2:
            fill[1] = self.o.vocab_size - missing
        return part + fill

    def _next(self, tokens: list[int], end: int) -> int:
        view = tokens
        if self.o.overlap_size > 0:
            view = tokens[max(0, end - self.o.overlap_size) : end]
            for back, token in enumerate(reversed(view)):
                if token == self.o.newline:
                    self.stats["overlap_tokens"] += back
                    self.stats["line_blocks"] += 1
                    return end - back
        if 0 < end < len(view) - self.o.truncate_size and view[end - 1] == self.o.newline:
            self.stats["line_blocks"] += 1
        return end

    def add(self, tokens: list[int]) -> Iterator[list[int]]:
        self.stats["texts"] += 1
        self.stats["tokens"] += max(0, len(tokens) - 1)
        if not self.carry:
            self.stats["line_blocks"] += 1
        tokens, at, rest = self.carry + tokens, 0, []
        while at < len(tokens):
            rest = tokens[at : at + self.o.block_size]
            block = self._padded(rest)
            if len(block) == self.o.block_size:
                self.stats["blocks"] += 1
                yield block
                rest = []
            following = self._next(tokens, at + self.o.block_size)
            at = following if following > at else at + self.o.block_size
        if len(rest) < self.o.truncate_size:
            self.stats["truncated_tokens"] += len(rest)
            rest = []
        self.carry = rest


def pack_stateful(df: DataFrame, options: Options, order: str = "doc_id", shard: Column | None = None) -> DataFrame:
    """shard, block_no, input_ids with padding, truncation and overlap; each shard carries its own rest."""
    shard = F.lit(0) if shard is None else shard

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        packer, rows = Packer(options), []
        for ids in pdf.sort_values("k").ids:
            rows += packer.add(ids.tolist())
        return pd.DataFrame({"shard": pdf.shard.iloc[0], "block_no": range(len(rows)), "input_ids": rows})

    rows = df.select(shard.cast("int").alias("shard"), F.col(order).alias("k"), "ids")
    return rows.groupBy("shard").applyInPandas(run, "shard int, block_no long, input_ids array<int>")


def stateful_report(df: DataFrame, options: Options, order: str = "doc_id", shard: Column | None = None) -> DataFrame:
    """One row: the sums of the packers' counts, with the shares of padding, truncation and overlap among all tokens
    and of blocks that begin with a line or text."""
    shard = F.lit(0) if shard is None else shard
    names = list(Packer(options).stats)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(options)
        for ids in pdf.sort_values("k").ids:
            for _ in packer.add(ids.tolist()):
                pass
        return pd.DataFrame([packer.stats])

    rows = df.select(shard.cast("int").alias("shard"), F.col(order).alias("k"), "ids")
    each = rows.groupBy("shard").applyInPandas(run, ", ".join(f"{n} long" for n in names))
    total = each.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    share = lambda n, of: F.when(F.col(of) != 0, F.col(n) / F.col(of)).otherwise(0.0)
    shares = {f"{n}_share": share(f"{n}_tokens", "tokens") for n in ("padding", "truncated", "overlap")}
    return total.withColumns({**shares, "line_block_share": share("line_blocks", "blocks")})


def noise(df: DataFrame, ratio: float = 0.05, mask: int | None = None, seed: int = 42, key: str = "doc_id", special: dict[int, float] | None = None) -> DataFrame:
    """Drops tokens by chance, or with a mask id puts one mask for each run of them.

    The chance is a hash of (key, position, seed), so a rerun drops the same tokens. The first token of
    a text always stays; ``special`` gives single tokens a ratio of their own (an EOS token 0).
    """

    @F.arrow_udf("array<int>")
    def run(rows: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for tokens, keys in rows:
            for at, n in slices((tokens,), 0, len(tokens)):
                yield thinned(tokens.slice(at, n), keys.slice(at, n).to_numpy(zero_copy_only=False), ratio, mask, seed, special or {})

    return df.withColumn("ids", run(F.col("ids"), F.xxhash64(F.col(key))))


def thinned(tokens: pa.Array, keys: np.ndarray, ratio: float, mask: int | None, seed: int, special: dict[int, float]) -> pa.Array:
    """noise() of some rows; keys: xxhash64 of their keys, which goes on over (position, seed) as Spark's own does."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.list_flatten(tokens).to_numpy(zero_copy_only=False).astype(np.int32)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = np.arange(len(x)) - first
    h = xxhash_next(np.full(len(x), seed), xxhash_next(i, np.repeat(keys.view(np.uint64), sizes)), not -(1 << 31) <= seed < 1 << 31)
    chance = np.full(len(x), float(ratio))
    for token, own in special.items():
        chance[x == token] = own
    gone = (i > 0) & ((h & np.uint64((1 << 30) - 1)).astype(np.float64) / float(1 << 30) < chance)
    keep = ~gone
    if mask is not None:  # of a run of dropped tokens the first becomes the mask; none begins a text
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        x, keep = np.where(begins, mask, x), keep | begins
    kept = np.concatenate([[0], np.cumsum(keep)])
    end = np.cumsum(sizes)
    return lists(x[keep], kept[end] - kept[end - sizes], tokens.is_null())


_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash_next(values: np.ndarray, h: np.ndarray, long: bool = False) -> np.ndarray:
    """Spark's xxhash64 of 32-bit numbers (or of 64-bit ones), going on from the hashes h."""
    turned = lambda v, k: v << np.uint64(k) | v >> np.uint64(64 - k)
    v = values.astype(np.int64).view(np.uint64)
    if long:
        h = h + _P5 + np.uint64(8) ^ turned(v * _P2, 31) * _P1
        h = turned(h, 27) * _P1 + _P4
    else:
        h = h + _P5 + np.uint64(4) ^ (v & np.uint64(0xFFFFFFFF)) * _P1
        h = turned(h, 23) * _P2 + _P3
    for shift, times in ((33, _P2), (29, _P3)):
        h = (h ^ h >> np.uint64(shift)) * times
    return h ^ h >> np.uint64(32)


def report(df: DataFrame, block_size: int = 2048, column: str = "text", ids: str = "ids") -> DataFrame:
    """One row: texts, chars, tokens (without the end tokens), tokens_per_char, blocks, left_over_tokens, effective."""
    s = df.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.length(column)), F.lit(0)).cast("bigint").alias("chars"), F.coalesce(F.sum(F.size(ids) - 1), F.lit(0)).cast("bigint").alias("tokens"))
    total = F.col("tokens") + F.col("texts")
    blocks = F.floor(total / block_size).cast("bigint")
    return s.select(
        "texts", "chars", "tokens", (F.col("tokens") / F.col("chars")).alias("tokens_per_char"), blocks.alias("blocks"),
        (total - blocks * block_size).alias("left_over_tokens"), (blocks * block_size / total).alias("effective"),
    )
