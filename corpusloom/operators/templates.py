"""Prompt templates sniffed from the columns of a test set, generation inputs and sample handling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import contains_cjk
from .transforms import format_columns, format_keys

SECTION_IN, SECTION_OUT = "### instruction\n", "\n### output\n"
_CHECK = "\n{test}\n\ncheck({entry_point})\n"
_TYPED = "\n\n{text}\n\nfrom typing import List, Tuple, Optional\n\ndef {function_signature}:\n"


@dataclass(frozen=True)
class Template:
    """Formats by name over the columns in ``needs``; ``local`` ones replace them where ``local_if`` holds CJK text."""

    name: str
    needs: tuple[str, ...]
    formats: dict[str, str]
    choice: tuple[str, ...] = ()
    local: dict[str, str] = field(default_factory=dict)
    local_if: str | None = None

    def column(self, part: str) -> Column:
        if part not in self.formats:
            raise ValueError(f"template {self.name} has no {part}")
        usual = format_columns(self.formats[part])
        if part in self.local and self.local_if:
            return F.when(contains_cjk(F.col(self.local_if)), format_columns(self.local[part])).otherwise(usual)
        return usual


def _choices(name: str, needs: str, letters: str, prefix: str, reference: str) -> Template:
    columns = [f"{prefix}{x}" for x in letters]
    listed = " ".join(f"[@({x})|{x}.|[{x}]] {{{c}}}" for x, c in zip(letters, columns, strict=True))
    end = "\n" if prefix else " \n"
    each = {f"prompt_{x}": f"{{question}}\n{{{c}}}" for x, c in zip(letters, columns, strict=True)}
    return Template(name, tuple(needs.split()), {"prompt": "{question}\n[選択肢|Choice]: " + listed + end, "reference": reference, **each}, tuple(letters))


_ANSWER = {"prompt": "{question}\nThe answer is ", "prompt_n": "{question}\nThe answer is ", "reference": "{answer_number}"}
TEMPLATES = (
    Template(
        "code_spec", ("instruction", "text", "function_signature", "test", "entry_point"),
        {"prompt": "Complete a Python function to meet the following specifications." + _TYPED, "reference": "{prompt}{canonical_solution}", "test": _CHECK},
        local={"prompt": "次の仕様を満たすようにPython関数を完成させてください。" + _TYPED}, local_if="text",
    ),
    Template("instruction", ("instruction", "input", "output"), {"prompt": "{instruction}\n{input}", "reference": "{output}"}),
    Template("maths", ("question", "answer", "answer_number", "equation_solution"), _ANSWER, local={k: "{question}\n答えは、" for k in ("prompt", "prompt_n")}, local_if="question"),
    Template("code", ("prompt", "test", "entry_point", "canonical_solution"), {"prompt": "{prompt}", "reference": "{canonical_solution}\n", "test": _CHECK, "back_translation": "{instruction}\n\n{prompt}{canonical_solution}\n"}),
    _choices("five_choices", "question choice0 choice1 choice2 choice3 choice4 label", "01234", "choice", "{label}"),
    _choices("four_choices", "question A B C D answer", "ABCD", "", "{answer}"),
    Template("text", ("text",), {"prompt": "{text}", "reference": ""}),
    Template("prompt", ("prompt",), {"prompt": "{prompt}"}),
)


def guess(columns: list[str]) -> Template | None:
    """The first template all of whose columns are there."""
    return next((t for t in TEMPLATES if set(t.needs) <= set(columns)), None)


def _chosen(df: DataFrame, template: Template | None) -> Template:
    found = template or guess(df.columns)
    if found is None:
        raise ValueError(f"no template fits the columns {df.columns}")
    missing = {k for part in found.formats.values() for k in format_keys(part)} - set(df.columns) - {"instruction"}
    if missing - {"prompt", "canonical_solution"}:
        raise ValueError(f"template {found.name} needs the columns {sorted(missing)}")
    return found


def generation(df: DataFrame, template: Template | None = None) -> DataFrame:
    """df with input, reference and, if the template has one, test."""
    t = _chosen(df, template)
    named = {"input": t.column("prompt")} | {p: t.column(p) for p in ("reference", "test") if p in t.formats}
    return df.withColumns(named)


def loss_input(df: DataFrame, template: Template | None = None) -> DataFrame:
    """df with input: the prompt with its reference, for a loss over both."""
    t = _chosen(df, template)
    return df.withColumn("input", F.concat(t.column("prompt"), t.column("reference")))


def choice_inputs(df: DataFrame, template: Template | None = None) -> DataFrame:
    """df with choice, input (an array of one prompt per choice) and reference."""
    t = _chosen(df, template)
    if not t.choice:
        raise ValueError(f"template {t.name} has no choices")
    return df.withColumns({"choice": F.array(*map(F.lit, t.choice)), "input": F.array(*(t.column(f"prompt_{c}") for c in t.choice)), "reference": t.column("reference")})


def number_choices(df: DataFrame, key: str, template: Template | None = None, seed: int = 42) -> DataFrame:
    """Choices for a question whose answer is a number: itself and four of its near misses, in hashed order."""
    t = _chosen(df, template)
    ref = t.column("reference")
    n = ref.cast("bigint")
    near = F.array_distinct(F.array(n - 1, n + 1, n * 2, F.floor(n / 2), n * 10, F.floor(n / 10)))
    fill = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), n * 3 + 2))
    other = F.filter(near, lambda x: x != n)
    ranked = F.array_sort(F.transform(other, lambda x: F.struct(F.xxhash64(F.col(key), x, F.lit(seed)).alias("h"), x.alias("x"))))
    spare = F.filter(F.array_distinct(fill), lambda x: (x != n) & ~F.array_contains(other, x))
    four = F.slice(F.concat(F.transform(ranked, lambda s: s["x"]), spare), 1, 4)
    numbers = F.concat(F.array(n), four)
    return df.withColumns({"choice": F.transform(numbers, lambda x: x.cast("string")), "input": F.transform(numbers, lambda x: F.concat(t.column("prompt_n"), x.cast("string"), F.lit("\n"))), "reference": ref})


def instruction(df: DataFrame, template: Template | None = None) -> DataFrame:
    """df with text: prompt and reference between section markers, for a trainer."""
    t = _chosen(df, template)
    return df.withColumn("text", F.concat(F.lit(SECTION_IN), t.column("prompt"), F.lit(SECTION_OUT), t.column("reference")))


def within_lengths(df: DataFrame, size, max_prompt: int | None = None, min_total: int | None = None, max_total: int | None = None, head: int | None = None, prompt: str = "input", reference: str = "reference") -> DataFrame:  # noqa: ANN001
    """Rows whose token counts (``size`` maps a text Column to one) are within the limits."""
    p = size(F.col(prompt))
    total = size(F.concat(F.col(prompt), F.col(reference)))
    for limit, ok in ((max_prompt, lambda x: p <= x), (max_total, lambda x: total <= x), (min_total, lambda x: total >= x)):
        if limit is not None:
            df = df.where(ok(limit))
    return df.limit(head) if head else df


def length_bounds(df: DataFrame, size, q: float = 95, column: str = "input") -> DataFrame:  # noqa: ANN001
    """One row: the q-th percentile of token counts plus one, and new_tokens, the maximum if that is under 512."""
    n = size(F.col(column)).cast("double")
    s = df.select(n.alias("n")).agg((F.percentile("n", q / 100) + 1).cast("bigint").alias("length"), F.max("n").cast("bigint").alias("most"))
    return s.select("length", F.when(F.col("most") < 512, F.col("most")).otherwise(F.col("length")).alias("new_tokens"))


def unique_key(columns: list[str]) -> str | None:
    """The first column that has ``id`` in its name."""
    return next((c for c in columns if "id" in c.lower()), None)


def to_generate(samples: DataFrame, result: str = "output") -> DataFrame:
    """Rows that still lack a result."""
    return samples.where(F.col(result).isNull()) if result in samples.columns else samples


def backup(df: DataFrame, column: str) -> DataFrame:
    """A copy of a column under the first free name column_0 … column_9."""
    free = next((f"{column}_{k}" for k in range(10) if f"{column}_{k}" not in df.columns), None)
    return df.withColumn(free, F.col(column)) if free else df


def append_texts(df: DataFrame, path: str, template: str, source: str | None = None) -> None:
    """Appends a row text by the template (and its source) to a folder of JSON lines."""
    made = df.select(format_columns(template).alias("text"))
    (made.withColumn("source", F.lit(source)) if source else made).write.mode("append").json(path)


def save_scores(scores: DataFrame, path: str) -> None:
    """Appends rows of scores to a folder of JSON lines."""
    scores.write.mode("append").json(path)
