"""Text primitives as Column expressions: trimming, words, lines, chunks, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A maximal run of letters, digits and underscores in any script (Java's own \\w is ASCII only).
WORD = r"[\p{L}\p{N}_]+"


def big(c: Column) -> Column:
    return c.cast("bigint")


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def lines(c: Column, sep: str = "\n") -> Column:
    return F.split(c, "\\Q" + sep + "\\E", -1)


def distinct_chars(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def chunks(c: Column, max_length: int = 200) -> Column:
    """Array of chunks of whole lines.

    A blank line closes the running chunk. Otherwise a line that would carry it beyond max_length
    (each line counts one more for its break) closes it, empty or not, and opens the next; so an
    over-long first line leaves an empty chunk in front of it.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        joined = F.array_join(acc["run"], "\n")
        size = F.length(line)
        nothing = F.array().cast("array<string>")
        blank = F.when(F.size(acc["run"]) > 0, F.struct(F.array_append(acc["done"], joined).alias("done"), nothing.alias("run"), F.lit(0).alias("n"))).otherwise(acc)
        full = F.struct(F.array_append(acc["done"], joined).alias("done"), F.array(line).alias("run"), size.alias("n"))
        more = F.struct(acc["done"].alias("done"), F.array_append(acc["run"], line).alias("run"), (acc["n"] + size + 1).alias("n"))
        return F.when(strip(line) == "", blank).when(acc["n"] + size + 1 > max_length, full).otherwise(more)

    def close(acc: Column) -> Column:
        return F.when(F.size(acc["run"]) > 0, F.array_append(acc["done"], F.array_join(acc["run"], "\n"))).otherwise(acc["done"])

    return F.aggregate(lines(c), start, step, close)


_SECTIONS = {
    "line": r"(?<=\n)(?=[^\n])",
    "doc": r"(?<=\n\n)(?=[^\n])",
    "python": r"(?<=\n)(?=(?:    )?(?:def|class|async|@) |\nif |\ntry |\n# |\n[A-Za-z0-9_]+\s= )",
    "markdown": r"(?<=\n)(?=#)",
    "none": r"(?!)",
}


def sections(c: Column, kind: str) -> Column:
    """Array of sections cut in front of the boundaries of a kind: line, doc, python, markdown or none."""
    if kind not in _SECTIONS:
        raise ValueError(f"unknown section kind {kind!r}; known: {', '.join(_SECTIONS)}")
    return F.array(c) if kind == "none" else F.split(c, _SECTIONS[kind], -1)


def without_duplicate_lines(c: Column, prefix_length: int = 8) -> Column:
    """Drops lines that share a prefix with the line kept before them.

    A line of more than prefix_length and fewer than 80 characters whose first prefix_length
    characters begin the previous kept line only replaces it if longer. Runs of blank lines shrink to
    none after an empty line, and a short heading before a long paragraph of several 。 gets a blank
    line in front.
    """
    start = F.array(F.lit(""))

    def step(acc: Column, line: Column) -> Column:
        prev = F.element_at(acc, -1)
        n, p = F.length(line), F.length(prev)
        init = F.slice(acc, F.lit(1), F.size(acc) - 1)
        similar = (n > prefix_length) & (n < 80) & F.startswith(prev, F.substring(line, 1, prefix_length))
        longer = F.when(n > p, F.array_append(init, line)).otherwise(acc)
        stops = lambda x: n - F.length(F.replace(x, F.lit("。"), F.lit("")))
        heading = (p > 1) & (p < 40) & ~F.endswith(prev, F.lit("。")) & (n > 80) & (stops(line) > 1)
        spaced = F.array_append(F.array_append(init, F.concat(F.lit("\n"), prev)), line)
        return F.when(similar, longer).when((strip(line) == "") & (prev == ""), acc).when(heading, spaced).otherwise(F.array_append(acc, line))

    return F.array_join(F.aggregate(lines(c), start, step, lambda acc: F.slice(acc, F.lit(2), F.greatest(F.size(acc) - 1, F.lit(0)))), "\n")


_FOOTNOTES = ("脚注|関連項目|日本国内の関連項目|出典|出典・脚注|参照|外部リンク|参考文献|その他関連事項").split("|") + ["Notes", "Sources", "See also", "Citations", "References", "Bibliography", "External links", "Footnotes", "Further reading"]


def alternation(listed: list[str] | str) -> str:
    """Java regex of any of the words (a list, or a string separated by |), the longest tried first."""
    items = listed.split("|") if isinstance(listed, str) else listed
    return "|".join("\\Q" + w + "\\E" for w in sorted({w for w in items if w}, key=lambda w: (-len(w), w)))


def without_footnotes(c: Column, headings: list[str] | None = None) -> Column:
    """The text up to the first footnote heading, wherever it stands."""
    return F.regexp_extract(c, rf"(?s)^(.*?)(?:{alternation(headings or _FOOTNOTES)}|\z)", 1)
