"""Source code and Markdown: splitting documentation from code, placeholders, emphasis, augmentation notation.

These walk a text with state or nested syntax, for which Java's regexes don't suffice, and run as
Arrow-batched functions.
"""

from __future__ import annotations

import ast
import os.path
import random
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..functions import rewrite
from ..functions.arrow import by_rows
from ..functions.scores import ratio

_STRINGS = re.compile(r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''")


def _is_code(comment_lines: list[str]) -> bool:
    """Whether commented-out lines parse as Python once their common prefix is gone."""
    if len(comment_lines) > 1:
        cut = len(os.path.commonprefix(comment_lines))
        body = "\n".join(x[cut:] for x in comment_lines)
    else:
        body = comment_lines[0].lstrip().removeprefix("#")
    try:
        ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def split_python(source: str) -> tuple[str, str]:
    """(documentation, code): docstrings and comments in prose, and the source without leading comments and dead code."""
    docs: list[str] = []
    held: list[str] = []

    def hide(m: re.Match) -> str:
        held.append(m[0])
        docs.append(m[0][3:-3])
        return f"\0{len(held) - 1}\0"

    kept: list[str] = []
    block: list[str] = []
    indent = ""

    def close() -> None:
        if block and not _is_code(block):
            kept.extend(f"{indent}#{c}" for c in block)
            docs.append("\n".join(block))
        block.clear()

    started = False
    for line in _STRINGS.sub(hide, source).split("\n"):
        if not started and line[:1] in ("#", "<"):
            continue
        started = True
        code, mark, comment = line.partition("#")
        if block and code != indent:
            close()
        if not mark:
            kept.append(line)
        elif code.strip():
            kept.append(line)
            if not any(q in code and q in comment for q in "\"'"):
                docs.append(comment)
        else:
            indent = code
            block.append(comment)
    close()
    return "\n".join(docs), re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], "\n".join(kept))


@F.arrow_udf(StructType().add("doc", StringType()).add("code", StringType()))
def python_parts(t: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """struct(doc, code) of Python sources; null for null."""
    return by_rows(lambda s: dict(zip(("doc", "code"), split_python(s), strict=True)), pa.struct([("doc", pa.string()), ("code", pa.string())]), t)


@F.arrow_udf(StructType().add("doc", LongType()).add("code", LongType()))
def python_lengths(t: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """struct(doc, code): the characters of each of python_parts()."""
    return by_rows(lambda s: dict(zip(("doc", "code"), map(len, split_python(s)), strict=True)), pa.struct([("doc", pa.int64()), ("code", pa.int64())]), t)


def doc_fraction(t: Column) -> Column:
    parts = python_lengths(t)
    return ratio(parts["doc"], parts["code"])


def shorten(block: str, limit: int, dots: str = "...") -> str:
    """The first lines within ``limit`` characters, dots, and the last line."""
    out, used = [], 0
    rows = block.split("\n")
    for row in rows:
        used += len(row)
        if used > limit:
            out.append(dots)
            break
        out.append(row)
    return "\n".join([*out, rows[-1]])


_FENCES = re.compile(r"```[\s\S]+?```|\$\$[\s\S]+?\$\$")
_INLINE = re.compile(r"`[^`]+?`")
_URL = re.compile(r"https?://[\w/:%#$&?~.,=+\-\\]+")
_EMAIL = re.compile(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z|]{2,7}|<EMAIL>", re.I)
_UUID = re.compile(r"\b[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\b")


def clean_snippet(block: str, limit: int = 512) -> str:
    block = re.sub(r"(```\S*)[^\n]*\n", r"\1\n", block)
    for pattern, new in ((_URL, "<url>"), (_EMAIL, "<email>"), (_UUID, "<uuid>")):
        block = pattern.sub(new, block)
    block = re.sub(r"(\.\d{4})\d+", r"\1", block)
    return shorten(block, limit // 2) if len(block) > limit else block


def with_code_aside(text: str, work: Callable[[str], str], max_code_length: int = 4096) -> str:
    """work applied to a Markdown text whose code is out of reach, with the code, cleaned, put back."""
    held: list[str] = []

    def hide(m: re.Match) -> str:
        block = m[0] if len(m[0]) <= max_code_length else shorten(m[0], max_code_length // 2)
        held.append(block)
        return f"<{len(held) - 1:02}pH>"

    done = work(_INLINE.sub(hide, _FENCES.sub(hide, text)))
    for k in reversed(range(len(held))):
        done = done.replace(f"<{k:02}pH>", clean_snippet(held[k]))
    return done


def strip_markdown(t: Column) -> Column:
    """Without front matter, tags, tables and link targets; URLs, addresses and dates become placeholders."""
    t = F.regexp_replace(t, r"---\n[\s\S]*?\n---", "")
    t = F.regexp_replace(t, r"<[A-Za-z/][^>]*>|<![^>]*>|\{%[^%]+%\}|~~[\s\S]+?~~", "")
    for _ in range(2):  # neighbouring tables share a line break
        t = F.regexp_replace(t, r"\n\s*\|[\s\S]*?\|\s*\n", "\n")
    t = F.regexp_replace(t, r"!?\[([^\[\]]*?)\]\([^()]*?\)|\[([^\[\]]*?)\]\[[^\[\]]*?\]|\[!(.*?)\]", "$1$2$3")
    for name in ("url", "email"):
        t = rewrite.rewriter(name)[0](t, f"<{name}>")
    return rewrite.datetime(t)


def strip_emphasis(t: Column) -> Column:
    for n in (3, 2, 1):
        t = F.regexp_replace(t, rf"\*{{{n}}}(.*?)\*{{{n}}}|_{{{n}}}(.*?)_{{{n}}}", "$1$2")
    return t


def filter_markdown(t: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Markdown-free text of the sections (cut at line breaks before #) that ``keep`` accepts; code fences stay, cleaned."""

    def hidden(x: str) -> dict:
        held: list[str] = []

        def hide(m: re.Match) -> str:
            held.append(clean_snippet(m[0]))
            return f"\ue000{len(held) - 1}\ue001"

        return {"text": _INLINE.sub(hide, _FENCES.sub(hide, x)), "held": held}

    @F.arrow_udf(StructType().add("text", StringType()).add("held", ArrayType(StringType())))
    def aside(s: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_rows(hidden, pa.struct([("text", pa.string()), ("held", pa.list_(pa.string()))]), s)

    @F.arrow_udf(StringType())
    def back(both: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return by_rows(lambda x, h: re.sub("\ue000(\\d+)\ue001", lambda m: h[int(m[1])], x), pa.string(), both)

    parts = aside(t)
    sections = F.split(strip_markdown(parts["text"]), "\n#", -1)
    kept = F.filter(sections, keep) if keep else sections
    return back(F.array_join(F.transform(kept, strip_emphasis), "\n#"), parts["held"])


def _closing(s: str, at: int) -> int:
    depth = 0
    for k in range(at, len(s)):
        depth += (s[k] == "[") - (s[k] == "]")
        if not depth:
            return k
    return -1


def augment_text(s: str, seed: int = 0, choose: bool = True) -> str:
    """Resolves ``[a|b]`` (one of them), ``[a/b]`` (all, in some order) and ``[@a|b]`` (the one that the seed picks
    everywhere), innermost first; brackets without a bar or a slash stay. Equal brackets resolve alike."""
    rng = random.Random(seed)
    known: dict[str, str] = {}

    def resolve(x: str) -> str:
        out, k = [], 0
        while k < len(x):
            end = _closing(x, k) if x[k] == "[" else -1
            if end < 0:
                out.append(x[k])
                k += 1
                continue
            whole = x[k : end + 1]
            if "|" not in whole and "/" not in whole:
                out.append(whole)
            else:
                if whole not in known:
                    known[whole] = pick(resolve(whole[1:-1]), whole)
                out.append(known[whole])
            k = end + 1
        return "".join(out)

    def pick(inner: str, whole: str) -> str:
        if "/" in inner and "|" not in inner:
            items = inner.split("/")
            if choose:
                rng.shuffle(items)
            return "".join(items)
        if "|" in inner:
            if inner.startswith("@"):
                items = inner[1:].split("|")
                return items[seed % len(items)]
            items = inner.split("|")
            return items[rng.randrange(len(items))] if choose else items[0]
        return f"[{inner}]" if whole.count("[") > 1 else inner

    return resolve(s)


def augment(t: Column, key: Column, seed: int = 42, choose: bool = True) -> Column:
    """augment_text with a seed hashed from the row's key, so that a rerun chooses alike."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else augment_text(x, int(n), choose) for x, n in zip(s, k, strict=True)])

    return run(t, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 31)))


def first_code(output: str) -> str:
    """The longest tail-trimmed part of a model's output that parses as Python, from a fence if there is one."""
    m = re.search(r"```(?:python)?\n([\s\S]*?)(?:```|\Z)", output)
    code = m[1] if m else output
    rows = code.split("\n")
    while rows:
        for end in range(len(rows), 0, -1):
            try:
                ast.parse("\n".join(rows[:end]))
            except (SyntaxError, ValueError):
                continue
            return "\n".join(rows[:end]).rstrip()
        rows = rows[1:]
    return ""


def cut_at_stops(code: str, stops: tuple[str, ...] = ("\nclass ", "\ndef ", "\n#", "\n@", "\nprint", "\nif ", "\n```")) -> str:
    """A completion up to the first stop sequence."""
    return code[: min((i for i in map(code.find, stops) if i >= 0), default=len(code))]


@F.pandas_udf(StringType())
def extract_code(t: pd.Series) -> pd.Series:
    return t.map(first_code, na_action="ignore")
