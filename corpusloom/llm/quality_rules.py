"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the integer measurements and one bit per
failed rule; a policy is a versioned bitmask over the same bits, so that applying another policy, or
asking what a rule alone rejects, never reads a text again: ``stored`` writes the ledger of a table once,
and what asks for it later, as the ablation does, reads the written one.

Definitions. Words are maximal runs of non-blank characters (ASCII blanks). A null text counts as an
empty text: zero words, so it fails ``few_words``. Rows are judged one by one, hence repeated rows
get equal ledgers and an empty table an empty ledger; a null doc_id is carried through. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import DOCUMENT_COLUMNS, file_states, stage, texts


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL predicate over the measurements that Spark and DuckDB read alike."""

    bit: int
    name: str
    fails: str


#: Integer measurements only: ratios are compared by cross-multiplication, so that no rounding enters.
RULES = (
    Rule(0, "few_words", "n_words < 1"),
    Rule(1, "many_words", "n_words > 10000000"),
    Rule(2, "long_words", "n_word_chars > 16 * n_words"),
    Rule(3, "symbols", "n_words >= 8 AND 2 * n_symbols > n_words"),
    Rule(4, "pipes", "n_words >= 8 AND 5 * n_pipes > n_words"),
    Rule(5, "shouting", "n_words >= 8 AND 2 * n_upper > n_letters"),
    Rule(6, "exclaiming", "n_words >= 8 AND 2 * n_exclaim > n_words"),
    Rule(7, "repeating", "n_words >= 40 AND 10 * (n_words - n_repeats) < 5 * n_words"),
    Rule(8, "few_letters", "n_words >= 8 AND 2 * n_letters < n_word_chars"),
    Rule(9, "digits", "n_words >= 20 AND 5 * n_digits > n_word_chars"),
    Rule(10, "ellipses", "n_lines >= 4 AND 10 * n_ellipsis_lines > 5 * n_lines"),
    Rule(11, "bullets", "n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines"),
    Rule(12, "braces", "n_words >= 8 AND 10 * n_braces > n_words"),
)

#: Versioned policies: the rules whose failure rejects a document. Never edit one, add a version.
POLICIES = {
    "v1": ("few_words", "symbols", "pipes", "shouting", "few_letters"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v2"

def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


_WORD = r"[^ \t\n\r\f]+"

# (Spark, DuckDB) expressions over t (the text, never null), words and lines. Deleting a class of
# characters and comparing lengths counts it in one pass; single characters need no regex.
_MEASURE_SQL = {
    "n_words": ("size(words)", "len(words)"),
    "n_word_chars": ("length(translate(t, ' \\t\\n\\r\\u000C', ''))", "length(translate(t, ' ' || chr(9) || chr(10) || chr(13) || chr(12), ''))"),
    "n_letters": (r"length(t) - length(regexp_replace(t, r'\p{L}+', ''))", r"length(t) - length(regexp_replace(t, '\p{L}+', '', 'g'))"),
    "n_upper": (r"length(t) - length(regexp_replace(t, r'\p{Lu}+', ''))", r"length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g'))"),
    "n_digits": ("length(t) - length(translate(t, '0123456789', ''))",) * 2,
    "n_symbols": (r"regexp_count(t, r'[#$%&*^~<>=+@]+')", r"len(regexp_extract_all(t, '[#$%&*^~<>=+@]+'))"),
    "n_pipes": ("length(t) - length(translate(t, '|', ''))",) * 2,
    "n_exclaim": ("regexp_count(t, '!+')", "len(regexp_extract_all(t, '!+'))"),
    "n_braces": ("length(t) - length(translate(t, '{}', ''))",) * 2,
    "n_repeats": ("size(filter(words, (x, i) -> i > 0 AND x = get(words, i - 1)))", "len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))"),
    "n_lines": ("size(lines)", "len(lines)"),
    "n_ellipsis_lines": ("size(filter(lines, x -> endswith(x, '...') OR endswith(x, '…')))", "len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…')))"),
    "n_bullet_lines": ("size(filter(lines, x -> startswith(x, '- ') OR startswith(x, '* ') OR startswith(x, '• ')))", "len(list_filter(lines, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '• ')))"),
}
MEASURES = list(_MEASURE_SQL)
_BITS = "CAST(" + " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES) + " AS BIGINT)"


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """The measurements as BIGINT columns, with doc_id and the named further columns."""
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), *more)
    words = words.select("*", F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)).alias("words"), F.split("t", "\n", -1).alias("lines"))
    return words.select("doc_id", *more, *(F.expr(f"CAST({spark} AS BIGINT)").alias(k) for k, (spark, _) in _MEASURE_SQL.items()))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits and keep_<version> for each policy: one row per input row."""
    bits = measured(texts(docs)).withColumn("fail_bits", F.expr(_BITS))
    return bits.select("*", *((F.col("fail_bits").bitwiseAND(F.lit(mask(v)).cast("long")) == 0).alias(f"keep_{v}") for v in POLICIES))


#: Application and files (with sizes and times) of a table, and its ledger as written.
_STORED: dict[tuple[str, ...], DataFrame] = {}


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of a table of files, written into the shared folder at the first call and read there at
    later ones, as long as the application runs and the files are the same."""
    key = (docs.sparkSession.sparkContext.applicationId, *file_states(docs))
    if key not in _STORED:
        _STORED[key] = stage(ledger(docs))
    return _STORED[key]


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs (their document columns) that pass the policy."""
    # The row number, which is not a function of the columns, keeps Catalyst from moving the filter
    # below the projection and so evaluating each measurement once per mention in a rule.
    kept = measured(docs.select(*DOCUMENT_COLUMNS), "text", "lang", "source", "n_chars").withColumn("row", F.monotonically_increasing_id())
    failed = F.expr(_BITS).bitwiseAND(F.lit(mask(policy)).cast("long"))
    return kept.where((failed == 0) & (F.col("row") >= 0)).select(*DOCUMENT_COLUMNS)


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """What each rule of the policy does, from a ledger alone.

    n_failed: documents that fail it; n_only: documents that only this rule rejects, i.e. those that
    dropping the rule would bring back. A row per rule of the policy, also when nothing fails it.
    """
    m = mask(policy)
    sums = []
    for r in RULES:
        if m >> r.bit & 1:
            failed = F.col("fail_bits").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0
            only = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) == F.lit(1 << r.bit)
            sums += [F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).cast("long").alias("bit"), F.count_if(failed).alias("n_failed"), F.count_if(only).alias("n_only"))]
    return book.agg(F.array(*sums).alias("rules")).select(F.inline("rules"))


def _duck_ledger(docs: str, more: str = "") -> str:
    measures = ", ".join(f"CAST({duck} AS BIGINT) AS {k}" for k, (_, duck) in _MEASURE_SQL.items())
    keeps = ", ".join(f"(fail_bits & {mask(v)}) = 0 AS keep_{v}" for v in POLICIES)
    return (
        f"SELECT *, {keeps} FROM (SELECT *, {_BITS} AS fail_bits FROM (SELECT doc_id{more}, {measures} FROM "
        f"(SELECT doc_id{more}, t, regexp_extract_all(t, '{_WORD}') AS words, string_split(t, chr(10)) AS lines "
        f"FROM (SELECT *, coalesce(text, '') AS t FROM {docs}))))"
    )


def ledger_sql(docs: str = "documents") -> str:
    return _duck_ledger(docs)


def ablation_sql(docs: str = "documents", policy: str = CURRENT) -> str:
    m = mask(policy)
    rows = [
        f"SELECT '{r.name}' AS rule, CAST({r.bit} AS BIGINT) AS bit, count(*) FILTER ((fail_bits & {1 << r.bit}) <> 0) AS n_failed, count(*) FILTER ((fail_bits & {m}) = {1 << r.bit}) AS n_only FROM book"
        for r in RULES
        if m >> r.bit & 1
    ]
    return f"WITH book AS ({_duck_ledger(docs)}) " + " UNION ALL ".join(rows)
