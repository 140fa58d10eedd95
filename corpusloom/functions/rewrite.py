"""Rewriters: named functions from (text, placeholder) Columns to a text Column.

Patterns are in Java's dialect. A strict pattern keeps known quirks of the format it stands for, the
``fixed`` table mends them. Letters and digits inside classes are spelled out by Unicode property,
since Java's own shorthands are ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrow import by_rows

Rewriter = Callable[[Column, str], Column]

_D = r"\p{Nd}"
_W = r"[\p{L}\p{N}_]"
_DAY, _YEAR = rf"{_D}{{1,2}}", rf"{_D}{{4}}"
_NOT_PARTICLE = "(?![はにかまのも、])"
_MONTHS = "Jan uary,Feb ruary,Mar ch,Apr il,May,Jun e,Jul y,Aug ust,Sep tember,Oct ober,Nov ember,Dec ember"
_MONTH = ["(?:{}(?:{})?)".format(*m.split()) if " " in m else m for m in _MONTHS.split(",")]


def _any(*patterns: str, flags: str = "") -> str:
    return flags + "|".join(patterns)


def _dates(fixed: bool) -> str:
    year = f"(?:19|20){_D}{{2}}"
    numeric = lambda *parts: r"[-/.]".join(parts)
    kanji = lambda head: rf"{head}\s?年\s?{_DAY}\s?月\s?{_DAY}\s?日{_NOT_PARTICLE}"
    # strict: from February on the day number itself stays in front of the placeholder
    british = [rf"{_DAY}\s+{_MONTH[0]}\s+{_YEAR}\b"] + [rf"{_DAY if fixed else chr(92) + 'b'}\s+(?:{'|'.join(_MONTH[1:])})\s+{_YEAR}\b"]
    return _any(
        numeric(year, _DAY, _DAY),
        kanji(year),
        kanji(rf"(?:令和|平成|昭和)\s?{_DAY}"),
        "[HRS]" + numeric(_DAY, _DAY, _DAY),
        numeric(_DAY, _DAY, year),
        rf"\b(?:{'|'.join(_MONTH)})\s+{_DAY},?\s+{_YEAR}\b",
        *british,
        "<date>",
        r"\(date\)",
        flags="(?iu)",
    )


_CLOCK = rf"{_DAY}:{_DAY}(?::{_DAY})?"
STRICT = {
    "url": r"https?://(?:" + _W + r"|[/:%#$&?~.,=+\-\\])+",
    "date": _dates(False),
    "time": _any(rf"{_CLOCK}(?:\.{_D}{{2,3}})?(?:\s*[AP]M)?", rf"\({_CLOCK}\)", rf"{_DAY}時\s?{_DAY}\s?分\s?{_DAY}\s?秒", rf"{_DAY}時\s?{_DAY}\s?分{_NOT_PARTICLE}", rf"[(<]time[)>]\.{_D}{{2,3}}"),
    "email": _any(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z|]{2,7}", "<EMAIL>", flags="(?i)"),
    "phone": _any(rf"\(0{_D}{{1,4}}\)\s*{_D}{{2,4}}-{_D}{{3,4}}", rf"(?:0{_D}{{1,4}}|\+81-{_D}{{1,4}})-{_D}{{2,4}}-{_D}{{3,4}}", rf"\+{_D}{{10,}}\(phone\)", "<phone>"),
    "address": rf"〒{_D}{{3}}-{_D}{{4}}[\s|][^\p{{Nd}}]{{0,40}}{_D}{{1,4}}(?:[−\-ー]{_D}{{1,4}}){{0,2}}",
    "uuid": r"\b[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\b",
    "hash": "|".join(rf"\b{a}+{b}+{a}+{b}+[{x}0-9]{{3,}}\b" for x in ("a-f", "A-F") for a, b in ((f"[{x}]", "[0-9]"), ("[0-9]", f"[{x}]"))),
    "base64": _any(
        *(rf"\b[0-9+/]+[{a}]+[0-9+/{b}]+[{a}]+[0-9+/{b}]+[0-9A-Za-z+/]*={{0,2}}\b" for a, b in (("a-z", "A-Z"), ("A-Z", "a-z"))),
        r"\b[0-9A-Za-z+/]{4,}={1,2}\b",
    ),
    "product_id": _any(
        r"\b[Nn][Oo][:.][\w\-+./]{3,}",
        r"\b[A-Z]+[_\-0-9][A-Z0-9_\-]+",
        r"\b[0-9]{2,}[A-Z\-][A-Z0-9_\-]+",
        r"\b[A-Z0-9]+-[0-9]{5,}[A-Z0-9\-]*",
        r"[0-9]+[A-Z_/\-]+[A-Z0-9]+",
        r"\b[A-Z]{4,}[_/.0-9][A-Z0-9_/.=]*",
        r"[0-9]{6,}",
    ),
    "number": _any(rf"{_D}{{5,}}", rf"{_D}*\.{_D}{{4,}}\(num\)"),
    "article": rf"(\n#?|>\s*){_D}{{2,}}[:.]?\b",
    "menu": _any(r"\s+[|｜>＞/／«»].{0,256}\n", r"[|｜＞／«»].{0,256}\n", r"\b12345678910\b"),
}
FIXED = STRICT | {
    "date": _dates(True),
    "phone": STRICT["phone"].replace(r"{10,}\(phone\)", r"{10,}|\(phone\)"),
    "number": _any(rf"{_D}{{5,}}", rf"{_D}*\.{_D}{{4,}}", r"\(num\)"),
}

_ENCLOSED = ((r"<<[\s\S]+?>>|\[\[[\s\S]+?\]\]|\{\{[\s\S]+?\}\}|\(\([\s\S]+?\)\)|【【[\s\S]+?】】"), "|".join(rf"\{a}[^\{b}]+?\{b}" for a, b in ("[]", "()", "{}")) + "|" + "|".join(f"{a}[^{b}]+?{b}" for a, b in ("【】", "（）", "〔〕", "《》")), rf"&(?:#|{_W})+;\s*")


def _sub(t: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(t, pattern, new)


def literal(placeholder: str) -> str:
    """A placeholder as a Java replacement string."""
    return placeholder.replace("\\", "\\\\").replace("$", "\\$")


def bar(t: Column, placeholder: str = "") -> Column:
    """Five or more of one character become three."""
    return _sub(t, r"([^\s])\1{4,}", "$1$1$1")


def enclose(t: Column, placeholder: str = "") -> Column:
    for p in _ENCLOSED:
        t = _sub(t, p, "")
    return t


def float_(t: Column, placeholder: str = "") -> Column:
    """Decimals keep three places."""
    return _sub(t, rf"({_D}*\.{_D}{{3}}){_D}{{2,}}", "$1")


def longstring(t: Column, placeholder: str = "") -> Column:
    """Long quoted strings keep eight characters at either end."""
    ends = r"(?:" + _W + r"|[/.\-]){8}"
    return _sub(t, "|".join(rf"({q}{ends})[^{q}\n\s]{{16,}}({ends}{q})" for q in ('"', "'")), "$1$3(...)$2$4")


def repeated(t: Column, placeholder: str = "") -> Column:
    """Two or more of one <tag> in a row become three."""
    return _sub(t, rf"(<{_W}+>)(?:\s*\1)+", "$1$1$1")


def identifiers(t: Column, placeholder: str = "") -> Column:
    for name, new in (("uuid", "<uuid>"), ("hash", "<hash>"), ("base64", "<base64>"), ("product_id", "<id>")):
        t = _sub(t, STRICT[name], new)
    return t


def cleanup(t: Column, placeholder: str = "") -> Column:
    """Drops short lines with several tags, menus and copyright lines, then runs of line breaks and <url>.

    As the list of kept lines begins with an empty one, the result begins with a line break.
    """
    count = lambda line, x: F.length(line) - F.length(F.replace(line, F.lit(x), F.lit("")))

    def kept(line: Column) -> Column:
        ignored = line.rlike(r"(?iu)<menu>|copyright|\(c\)|\s[|/]\s")
        long = (F.length(line) > 128) & F.contains(line, F.lit("。"))
        without_tail = F.regexp_replace(line, r"(?s)[^。]*\z", "")
        none = F.array().cast("array<string>")
        return (
            F.when((F.length(line) < 40) & (count(line, "<") > 1), none)
            .when(ignored & long & ~F.contains(line, F.lit("<menu>")), F.array(line))
            .when(ignored & long, F.array(without_tail, F.lit("")))
            .when(ignored, F.array(F.lit("")))
            .otherwise(F.array(line))
        )

    joined = F.concat(F.lit("\n"), F.array_join(F.flatten(F.transform(F.split(t, "\n", -1), kept)), "\n"))
    # with no line kept there is nothing to join the leading empty line to
    none_left = F.size(F.flatten(F.transform(F.split(t, "\n", -1), kept))) == 0
    joined = F.when(none_left, F.lit("")).otherwise(joined)
    return F.replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), F.lit("<url>"), F.lit(""))


def normalize(t: Column, form: str = "NFKC") -> Column:
    """Unicode normalisation, batch-wise in Python: Spark has no function for it."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normalisation form {form!r}")

    @F.arrow_udf(StringType())
    def run(t: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_rows(lambda s: unicodedata.normalize(form, s), pa.string(), t)

    return run(t)


_REGISTRY: dict[str, tuple[Rewriter, str | None]] = {}


def register_rewriter(name: str, rewrite: Rewriter, placeholder: str | None = None) -> None:
    """Adds a rewriter; without a default placeholder it is <name up to _>."""
    _REGISTRY[name] = (rewrite, placeholder)


def _pattern(name: str, table: dict[str, str] = STRICT) -> Rewriter:
    return lambda t, placeholder: _sub(t, table[name], literal(placeholder))


def date(t: Column, placeholder: str = "<date>", table: dict[str, str] = STRICT) -> Column:
    return _sub(t, table["date"], literal(placeholder))


def datetime(t: Column, placeholder: str = "<date>") -> Column:
    """Dates, then times, then a date closely followed by a time or a line's end as one."""
    t = _sub(date(t, placeholder), STRICT["time"], "<time>")
    return _sub(t, r"<date>[^\n]{0,8}<time>|[(<]date[)>][^\n]{0,8}\n", literal(placeholder))


for _name in ("url", "date", "time", "email", "phone", "address", "uuid", "hash", "base64", "number"):
    register_rewriter(_name, _pattern(_name), f"<{_name}>")
    if FIXED[_name] != STRICT[_name]:
        register_rewriter(f"{_name}-fixed", _pattern(_name, FIXED), f"<{_name}>")
register_rewriter("product_id", _pattern("product_id"), "<id>")
register_rewriter("datetime", datetime, "<date>")
register_rewriter("id", identifiers, "")
register_rewriter("bar", bar, "")
register_rewriter("enclose", enclose, "")
register_rewriter("menu", lambda t, p: _sub(t, STRICT["menu"], "<menu>\n"), "<menu>")
register_rewriter("article", lambda t, p: _sub(t, STRICT["article"], "$1" + literal(p)), "<article>")
register_rewriter("float", float_, "")
register_rewriter("longstring", longstring, "")
register_rewriter("repeated", repeated, "")
register_rewriter("cleanup", cleanup, "")


def rewriter(name: str) -> tuple[Rewriter, str | None]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown rewriter {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def rewrite(t: Column, patterns: str = "url:<URL>|date", uppercase: bool = True) -> Column:
    """Applies rewriters from left to right, then shortens repeated tags.

    Each is ``name:placeholder``; without a placeholder it is the name up to its first underscore,
    in angle brackets and, by default, in capitals.
    """
    for item in filter(None, patterns.split("|")):
        name, colon, placeholder = item.partition(":")
        prefix = name.partition("_")[0]
        new = placeholder if colon else f"<{prefix.upper() if uppercase else prefix}>"
        t = rewriter(name)[0](t, new)
    return repeated(t)


def clean_code_tags(t: Column) -> Column:
    """URLs, UUIDs, bars, decimals and long strings of a code corpus; its anonymising tags in lower case."""
    t = longstring(float_(bar(_sub(_sub(t, STRICT["url"], "<url>"), STRICT["uuid"], "<uuid>"))))
    for tag in ("EMAIL", "NAME", "PASSWORD"):
        t = F.replace(t, F.lit(f"<{tag}>"), F.lit(f"<{tag.lower()}>"))
    return t
