"""Benchmark decontamination on canonical templates.

Tokens are folded; numbers, names (capitalised within a sentence, and never in lower case, in the
same text; and as a second reading, within NEAR tokens) and units (after a number) become typed placeholders, so that a question with other numbers and
names has the template of the original. Hashes of template windows are joined with those of the
benchmark. A document is contaminated by an item if windows on one alignment (several together, if
they agree) cover ``coverage`` of the item's windows and the slots are consistent: within a type one
item value always stands for one document value and different ones for different ones. Apart from
that, windows of the plain folded tokens, values included, are compared in the same way, so that a
verbatim copy is found whatever its case, what the rest of the document makes of its names, and
however few its literals.

The benchmark is taken in blocks of about ``block_tokens`` tokens, items being assigned to them by hash:
a block's windows go to every executor and meet the windows of all documents there, so that no document
window is shuffled. A benchmark that fits one block, as all known ones do, takes one pass over the
documents; a larger one takes a pass a block, by the same plan.

Defined results. Null texts count as empty, empty texts and items match nothing. Items shorter than
the window are compared as one window of their own length, those under MIN_ITEM tokens not at all
(``uncompared`` reports them); items with few literals are found verbatim, not re-parameterised.
Rows with a null doc_id or item_id take no part in ``matches`` and stay in ``drop_contaminated``.
Repeated rows match once. Empty tables give empty results. Columns other than the ids and texts are
not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .spark_util import DOCUMENT_COLUMNS, texts
from .substring_dedup import rolling

WINDOW = 8
MIN_ITEM = 4
COVERAGE = 0.5
#: Literal tokens that a window needs, so that a row of placeholders is no evidence.
LITERALS = 4
#: Tokens to either side that decide whether a capitalised token is a name.
NEAR = 40
BLOCK_TOKENS = 2_000_000
NUMBER, NAME, UNIT = 1, 2, 3
UNITS = frozenset(
    "kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles inch inches ft feet foot yard yards l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years km/h mph m/s kmh hz khz mhz ghz kb mb gb tb "
    "dollar dollars cent cents euro euros pound pounds usd eur percent % degrees celsius fahrenheit watt watts kw kwh volt volts joule joules calories "
    "stunde stunden tag tage jahr jahre minuten meter kilometer gramm heure heures jour jours ans an mètre mètres hora horas día días año años metro metros".split()
)
_NUMBER = r"^[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?[%€$£]?$"


@dataclass
class Template:
    """Canonical token sequences of several texts: values (hashes), slot types (0: literal), words."""

    offsets: np.ndarray
    values: np.ndarray
    kinds: np.ndarray
    code: np.ndarray
    words: pa.Array
    plain: np.ndarray  # hashes of the folded tokens, slots or not

    def exact(self) -> Template:
        """The same texts without placeholders."""
        return Template(self.offsets, self.plain, np.zeros_like(self.kinds), self.code, self.words, self.plain)

    def word(self, at: int) -> str:
        return self.words[int(self.code[at])].as_py()


def _near(key: np.ndarray, among: np.ndarray, reach: int) -> np.ndarray:
    """Whether one of the sorted keys is at most ``reach`` away."""
    if not len(among):
        return np.zeros(len(key), bool)
    at = np.searchsorted(among, key)
    return (np.abs(among[np.minimum(at, len(among) - 1)] - key) <= reach) | (np.abs(among[np.maximum(at - 1, 0)] - key) <= reach)


def canonical(text: pa.Array, reach: int | None = None) -> Template:
    """Names are decided within ``reach`` tokens, or from the whole text."""
    tok = tk.tokenise(text)
    folded_all = tk.fold(tok.words)
    enc = folded_all.dictionary_encode()
    to, words = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary
    raw, off = tk.string_bytes(tok.words)
    n_words = len(tok.words)
    owner = tok.owner
    number = pc.match_substring_regex(words, _NUMBER).to_numpy(zero_copy_only=False)
    unit = pc.is_in(words, pa.array(sorted(UNITS))).to_numpy(zero_copy_only=False)
    lead = pc.utf8_ltrim(tok.words, characters=tk.PUNCTUATION)
    capital = pc.and_(pc.utf8_is_upper(pc.utf8_slice_codeunits(lead, 0, 1)), pc.match_substring_regex(lead, r"^\p{L}")).to_numpy(zero_copy_only=False) if n_words else np.zeros(0, bool)
    ends = pc.match_substring_regex(tok.words, r"[.!?:…][\"'»”)\]]*$").to_numpy(zero_copy_only=False) if n_words else np.zeros(0, bool)
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)

    f = to[tok.codes] if n_words else tok.codes
    cap = capital[tok.codes] if n_words else np.zeros(0, bool)
    first = np.zeros(len(f), bool)
    first[tok.offsets[:-1][np.diff(tok.offsets) > 0]] = True
    begins = first.copy()
    begins[1:] |= ends[tok.codes[:-1]] if n_words else False
    name = np.zeros(len(f), bool)
    mid = np.flatnonzero(cap & ~begins)
    if len(mid):
        n = max(len(words), 1)
        key = owner * n + f
        if reach is not None:
            key = key * (len(f) + reach + 1) + np.arange(len(f))
        at = np.flatnonzero(cap)
        name[at] = _near(key[at], np.sort(key[mid]), reach or 0) & ~_near(key[at], np.sort(key[~cap]), reach or 0)
    num = number[f] if len(f) else np.zeros(0, bool)
    after = np.zeros(len(f), bool)
    after[1:] = num[:-1] & (owner[1:] == owner[:-1])
    is_unit = after & unit[f] if len(f) else after
    kinds = np.where(num, NUMBER, np.where(is_unit, UNIT, np.where(name, NAME, 0))).astype(np.int8)
    literal = tk.hash_strings(words, 5)
    slots = tk.mix64(np.arange(4, dtype=np.uint64) + tk.U64(77))
    plain = literal[f] if len(f) else np.zeros(0, tk.U64)
    values = np.where(kinds == 0, plain, slots[kinds])
    keep = ~blank[f] if len(f) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(keep)])[tok.offsets]
    return Template(offsets, values[keep], kinds[keep], f[keep], words, plain[keep])


def windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start within the whole, hash) of the windows with enough literals; a whole text if ``width`` is longer."""
    fits = np.maximum(np.diff(t.offsets) - width + 1, 0)
    total = fits.sum()
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, tk.U64)
    at = np.repeat(t.offsets[:-1], fits) + np.arange(total) - np.repeat(np.cumsum(fits) - fits, fits)
    literals = np.concatenate([[0], np.cumsum(t.kinds == 0)])
    enough = literals[at + width] - literals[at] >= min(LITERALS, width)
    owner = np.repeat(np.arange(len(fits)), fits)
    return owner[enough], at[enough], rolling(t.values, width)[at[enough]]


class Benchmark:
    """Canonical items and the sorted hashes of their windows, by window width."""

    def __init__(self, ids: np.ndarray, template: Template, width: int):
        self.ids, self.template = ids, template
        lengths = np.diff(self.template.offsets)
        self.width = np.where(lengths >= width, width, lengths)
        self.count = np.zeros(len(ids), np.int64)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in sorted({int(x) for x in self.width if x >= MIN_ITEM}):
            owner, at, h = windows(self.template, w)
            mine = self.width[owner] == w
            owner, at, h = owner[mine], at[mine], h[mine]
            self.count += np.bincount(owner, minlength=len(ids))
            order = np.argsort(h, kind="stable")
            self.by_width[w] = (h[order], owner[order], at[order])


def _consistent(pairs: set[tuple[int, str, str]]) -> bool:
    there, back = defaultdict(set), defaultdict(set)
    for kind, a, b in pairs:
        there[kind, a].add(b)
        back[kind, b].add(a)
    return all(len(x) == 1 for x in there.values()) and all(len(x) == 1 for x in back.values())


def _readings(text: pa.Array) -> tuple[Template, ...]:
    """With the names of the whole text, with those of the neighbourhood, and without placeholders."""
    t = canonical(text)
    return t, canonical(text, NEAR), t.exact()


def _layers(ids: np.ndarray, text: pa.Array, width: int) -> tuple[Benchmark, ...]:
    """The benchmark in each reading."""
    return tuple(Benchmark(ids, t, width) for t in _readings(text))


def _hits(t: Template, bench: Benchmark) -> np.ndarray:
    """Rows (owner, item, place, item's place, width) of equal windows."""
    found = []
    for w, (h, owner, at) in bench.by_width.items():
        d_owner, d_at, d_h = windows(t, w)
        lo = np.searchsorted(h, d_h)
        some = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == d_h) if len(h) else lo[:0]
        lo, hi = lo[some], np.searchsorted(h, d_h[some], side="right")
        size = hi - lo
        b = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mine = np.repeat(some, size)
        found.append(np.stack([d_owner[mine], owner[b], d_at[mine], at[b], np.full(len(b), w)], 1))
    rows = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
    return rows[np.lexsort((rows[:, 3] - rows[:, 2], rows[:, 1], rows[:, 0]))]


def _verify(t: Template, bench: Benchmark, rows: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(owner, item, matched windows, windows, slots, changed slots) of the contaminations among hits."""
    cut = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1 if len(rows) else []
    for group in np.split(rows, cut) if len(rows) else []:
        owner, item, width = int(group[0, 0]), int(group[0, 1]), int(group[0, 4])
        total = int(bench.count[item])
        if len(np.unique(group[:, 3])) < coverage * total:
            continue
        shift = group[:, 3] - group[:, 2]
        for part in [group] + [group[shift == s] for s in np.unique(shift)]:
            matched = len(np.unique(part[:, 3]))
            if matched < coverage * total:
                continue
            slots = {(int(a) + k, int(b) + k) for a, b in part[:, 2:4] for k in range(width) if bench.template.kinds[b + k]}
            pairs = {(int(bench.template.kinds[b]), bench.template.word(b), t.word(a)) for a, b in slots}
            if _consistent(pairs):
                yield owner, item, matched, total, len(slots), sum(bench.template.word(b) != t.word(a) for a, b in slots)
                break


def _found(text: pa.Array, layers: tuple[Benchmark, ...], coverage: float) -> list[tuple[int, ...]]:
    """_verify()'s rows in all readings; what several find is reported by the first."""
    got = {}
    for t, bench in reversed(list(zip(_readings(text), layers, strict=True))):
        got |= {row[:2]: row for row in _verify(t, bench, _hits(t, bench), coverage)}
    return [got[k] for k in sorted(got)]


def _columns(ids: pa.Array, bench: Benchmark, found: list[tuple[int, ...]]) -> pa.RecordBatch:
    a = np.array(found, np.int64).reshape(-1, 6)
    cols = [ids.take(pa.array(a[:, 0])), pa.array(bench.ids[a[:, 1]]), *(pa.array(np.ascontiguousarray(a[:, k])) for k in (2, 3, 4, 5))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "matched_windows", "item_windows", "slots", "changed_slots"])


SCHEMA = "doc_id long, item_id long, matched_windows long, item_windows long, slots long, changed_slots long"


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))


def uncompared(benchmark: DataFrame) -> DataFrame:
    """item_id, n_tokens of the items with fewer than MIN_ITEM tokens, which are never compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(canonical(tk.as_string(batch.column("text"))).offsets)
            few = np.flatnonzero(n < MIN_ITEM)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(few)), pa.array(n[few])], names=["item_id", "n_tokens"])

    return _items(benchmark).mapInArrow(run, "item_id long, n_tokens long")


def _blocks(items: DataFrame, width: int, block_tokens: int) -> Iterator[tuple[Benchmark, ...]]:
    """The benchmark block by block; each is bounded, and the driver makes the next when it is asked for."""
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    n = -(-size // block_tokens)
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").toArrow().combine_chunks()
        yield _layers(got.column("item_id").to_numpy(), tk.as_string(got.column("text")), width)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, slots, changed_slots of each contamination."""
    spark = docs.sparkSession
    one = texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = spark.createDataFrame([], SCHEMA)
    for block in _blocks(_items(benchmark), width, block_tokens):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tk.slices(batch):
                    yield _columns(part.column("doc_id"), held.value[0], _found(part.column("text"), held.value, coverage))

        found = found.unionAll(one.mapInArrow(run, SCHEMA))
    return found.distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The document columns of the rows of docs that no benchmark item contaminates."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    for block in _blocks(_items(benchmark), width, block_tokens):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(block), coverage)
        rows = rows.where(F.col("doc_id").isNull() | F.col("text").isNull() | clean("text"))
    return rows


def _clean(held: Broadcast, coverage: float) -> Callable[..., Column]:
    """Whether no item of the block contaminates a text."""

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        good = np.ones(len(text), bool)
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["text"])
        start = 0
        for part in tk.slices(batch):
            for owner, *_ in _found(part.column("text"), held.value, coverage):
                good[start + owner] = False
            start += part.num_rows
        return pd.Series(good)

    return clean
