"""Similarity of texts, evaluation metrics with confidence intervals, leaderboard."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from ..functions.scores import ratio


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length, in code points; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b).cast("double") / longest)


_OPERATORS = frozenset("+-*/=<>|&~^_")


def _class(c: str) -> str:
    if c < "Ā":
        return "alpha" if c.isalpha() else "digit" if c.isdigit() else "op" if c in _OPERATORS else c
    category, name = unicodedata.category(c)[0], unicodedata.name(c, "")
    if category in "PS":
        return category
    for prefix in ("HIRAGANA", "KATAKANA", "CJK UNIFIED IDEOGRAPH", "FULL"):
        if name.startswith(prefix):
            return prefix
    return "other"


def character_runs(s: str) -> list[str]:
    """Runs of characters of one class; single blanks are left out, longer ones kept."""
    return [t for t in ("".join(g) for _, g in groupby(s, _class)) if t != " "]


@F.pandas_udf(ArrayType(StringType()))
def _runs_udf(t: pd.Series) -> pd.Series:
    return t.map(character_runs, na_action="ignore")


_ASCII_RUNS = r"[A-Za-zª-ºÀ-ÖØ-öø-ÿ]+|[0-9]+|[+\-*/=<>|&~^_]+|([^A-Za-z0-9+\-*/=<>|&~^_])\1*"


def simple_tokens(t: Column, ascii_only: bool = False) -> Column:
    """character_runs; for ASCII texts as a plain expression, without Python."""
    if ascii_only:
        return F.filter(F.regexp_extract_all(t, F.lit(_ASCII_RUNS), F.lit(0)), lambda w: w != " ")
    return _runs_udf(t)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays' sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def cosine(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, cosine: of the term frequencies of two token arrays, 0 if either is empty."""
    side = lambda c, n: df.select(key, F.explode(c).alias("w")).groupBy(key, "w").agg(F.count("*").cast("double").alias(n))
    both = side(a, "x").join(side(b, "y"), [key, "w"], "full_outer").fillna(0.0, ["x", "y"])
    s = both.groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sqrt(F.sum(F.col("x") ** 2)).alias("nx"), F.sqrt(F.sum(F.col("y") ** 2)).alias("ny"))
    return df.select(key).join(s, key, "left").select(key, F.coalesce(ratio(F.col("xy"), F.col("nx") * F.col("ny")), F.lit(0.0)).alias("cosine"))


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[k:] for k in range(n)), strict=False))


def bleu_score(candidate: list[str], reference: list[str], max_n: int = 4) -> float:
    """Geometric mean of the clipped 1- to max_n-gram precisions times the brevity penalty; 0 if one is 0."""
    logs = 0.0
    for n in range(1, max_n + 1):
        mine = _grams(candidate, n)
        clipped = sum((mine & _grams(reference, n)).values())
        if not clipped:
            return 0.0
        logs += math.log(clipped / mine.total()) / max_n
    short = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / len(candidate))
    return short * math.exp(logs)


def rouge_l_score(candidate: list[str], reference: list[str]) -> float:
    """F1 of the longest common subsequence."""
    row = [0] * (len(reference) + 1)
    for x in candidate:
        diagonal = 0
        for j, y in enumerate(reference, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    common = row[-1]
    return 2 * common / (len(candidate) + len(reference)) if common else 0.0


def _pairwise(score: Callable[[list[str], list[str]], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(character_runs(x), character_runs(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


bleu, rouge_l = _pairwise(bleu_score), _pairwise(rouge_l_score)


def exact_match(output: Column, reference: Column, strict: bool = True) -> Column:
    """Mean over an array of outputs. A reference of digits is compared with an output's first number,
    leading zeros aside; strict is equality, otherwise the reference has to occur in the output."""
    first = lambda o: F.regexp_replace(F.regexp_extract(o, "([0-9]+)", 1), "^0+(?=.)", "")
    digits = reference.rlike("^[0-9]+$")
    hit = (lambda o: F.when(digits, first(o) == reference).otherwise(o == reference)) if strict else (lambda o: F.contains(o, reference))
    return ratio(F.aggregate(output, F.lit(0), lambda acc, o: acc + hit(o).cast("int")), F.size(output))


@F.pandas_udf(LongType())
def _zlib_len(t: pd.Series) -> pd.Series:
    return t.map(lambda s: len(zlib.compress(s.encode("utf-8"))), na_action="ignore").astype("Int64")


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def perplexity_per_zlib(loss: Column, t: Column) -> Column:
    return F.exp(loss) / F.greatest(F.lit(1), _zlib_len(t))


def min_k(log_probs: Column, k: int = 20) -> Column:
    """Minus the mean of the lowest k percent (at least one) of an array of token log-probabilities."""
    n = F.greatest(F.floor(F.size(log_probs) * k / 100), F.lit(1)).cast("int")
    low = F.slice(F.array_sort(log_probs), F.lit(1), n)
    return F.when(F.size(log_probs) > 0, -F.aggregate(low, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(low))


def min_k_plus(log_probs: Column, mu: Column, sigma: Column, k: int = 20) -> Column:
    """min_k of (log-probability - mu) / sigma, token by token."""
    z = F.transform(F.arrays_zip(log_probs.alias("p"), mu.alias("m"), sigma.alias("s")), lambda x: (x["p"] - x["m"]) / x["s"])
    return min_k(z, k)


def best_choice(losses: Column) -> Column:
    """Index of the least loss, the first of equal ones."""
    return (F.array_position(losses, F.array_min(losses)) - 1).cast("bigint")


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t distribution, by bisection of its distribution function."""
    cdf = lambda t: 1 - 0.5 * _beta_tail(df / (df + t * t), df / 2, 0.5)
    lo, hi = 0.0, 1e6
    q = max(p, 1 - p)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)


def metric_summary(df: DataFrame, score: str, by: list[str], scale: float = 100.0, level: float = 0.95) -> DataFrame:
    """by…, n, mean, stderr, ci_low, ci_high. Rows without a score don't count; one row has no interval.

    The t quantile depends on n alone, so it comes from a small table of the group sizes that occur.
    """
    s = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), (F.avg(score) * scale).alias("mean"), (F.stddev_samp(score) / F.sqrt(F.count("*")) * scale).alias("stderr"))

    @F.pandas_udf(DoubleType())
    def t_of(n: pd.Series) -> pd.Series:
        table = {k: t_quantile(0.5 + level / 2, int(k) - 1) if k > 1 else None for k in n.unique()}
        return n.map(table).astype("float64")

    t = t_of("n")
    return s.select(*by, "n", F.round("mean", 2).alias("mean"), F.round("stderr", 2).alias("stderr"), (F.col("mean") - t * F.col("stderr")).alias("ci_low"), (F.col("mean") + t * F.col("stderr")).alias("ci_high"))


METRICS: dict[str, tuple[tuple[str, ...], float, Callable[..., Column]]] = {
    "exact_match": (("output", "reference"), 100.0, lambda strict="true": exact_match(F.col("output"), F.col("reference"), strict == "true")),
    "editsim": (("output", "reference"), 100.0, lambda: ratio(F.aggregate("output", F.lit(0.0), lambda a, o: a + edit_similarity(o, F.col("reference"))), F.size("output"))),
    "perplexity": (("loss",), 1.0, lambda: perplexity(F.col("loss"))),
    "ppl": (("loss",), 1.0, lambda: perplexity(F.col("loss"))),
    "ppl_zlib": (("loss", "input"), 1.0, lambda: perplexity_per_zlib(F.col("loss"), F.col("input"))),
    "loss": (("loss",), 1.0, lambda: F.col("loss")),
    "mink_prob": (("mink_prob",), 1.0, lambda k="20": F.try_element_at("mink_prob", F.lit(k))),
    "mink_plus": (("mink_plus",), 1.0, lambda k="20": F.try_element_at("mink_plus", F.lit(k))),
}


def evaluate(df: DataFrame, metric: str) -> DataFrame:
    """df with a score column for a metric by name (``mink_prob?k=10``); null where what it needs is null."""
    name, _, query = metric.replace("@", "_at_").replace("/", "_").partition("?")
    if name not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    needs, _, make = METRICS[name]
    options = dict(p.split("=", 1) for p in query.split("&") if p)
    there = F.lit(True)
    for c in needs:
        there &= F.col(c).isNotNull()
    return df.withColumn("score", F.when(there, make(**options)))


def leaderboard(scores: DataFrame, tests: list[str] | None = None) -> DataFrame:
    """model, score (mean of its tests), one column per test, best first; from rows (model, test, mean)."""
    wide = scores.groupBy("model").pivot("test", tests).agg(F.first("mean"))
    named = [c for c in wide.columns if c != "model"]
    present = F.array_compact(F.array(*(F.col(c) for c in named)))
    mean = ratio(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))
    return wide.select("model", mean.alias("score"), *named).orderBy(F.desc("score"), "model")


def upsert_scores(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("model", "test")) -> DataFrame:
    """Rows of old whose key isn't in new, and those of new."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)
