"""Secret scan with multipart credential linking.

Parts are access identifiers, secrets and endpoints. Strong parts carry their format (access key ids,
private-key headers, prefixed service tokens, long random values assigned to a secret's name) and are
reported alone; weak ones (short assigned values, bare hexadecimal strings, e-mail addresses, hosts)
only if complementary parts co-occur: a secret with an identifier or an endpoint, an identifier or
an endpoint with a secret. Two parts co-occur if they stand in one document and their intervals,
each widened by ``reach`` characters, overlap. That is an interval join on buckets of positions.

Defined results. Positions count code points, end exclusive. A null or empty text has no parts; where
two patterns of one role overlap the earlier in PATTERNS wins, then the first and longest match. No
string is both a secret and an identifier (again the earlier wins), and an endpoint that begins within
a secret is part of it; but an endpoint around a secret or an identifier (a URL with a password, token,
user or key id in it) is a part beside them, at distance 0. A null doc_id
can't be joined on: its rows are left out. Rows of one doc_id are one document, equal parts of
repeated rows count once. An empty table gives an empty result; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import cut, texts

REACH = 300
_NAMES = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret|private[_-]?key)"

#: (kind, role, strong, pattern); the part is group 1.
PATTERNS = (
    ("private_key", "secret", True, re.compile(r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----)")),
    ("service_token", "secret", True, re.compile(r"(?<![A-Za-z0-9_])((?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20}|sk_live_[A-Za-z0-9]{16,}))(?![A-Za-z0-9_])")),
    ("access_key_id", "identifier", True, re.compile(r"(?<![A-Z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Z0-9])")),
    ("url_password", "secret", False, re.compile(r"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")),
    ("assigned", "secret", None, re.compile(rf"(?i)[?&](?:[a-z]+[_-])*{_NAMES}=([^\s\"'<>,;&#]{{4,}})")),
    ("assigned", "secret", None, re.compile(rf"(?i)(?<![a-z]){_NAMES}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([^\s\"',;]{{4,}})")),
    ("hex", "secret", False, re.compile(r"(?<![0-9A-Za-z])([0-9a-f]{32,128})(?![0-9A-Za-z])")),
    ("url", "endpoint", False, re.compile(r"((?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+)")),
    ("url_user", "identifier", False, re.compile(r"://([^\s/:@\"'<>]+)(?::[^\s/@\"'<>]*)?@")),
    ("email", "identifier", False, re.compile(r"(?<![\w.+-])([\w.+-]+@[\w-]+(?:\.[\w-]+)+)")),
    ("ipv4", "endpoint", False, re.compile(r"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?)(?![\d.]*\d)")),
    ("user", "identifier", False, re.compile(r"(?i)(?<![a-z])(?:user(?:name)?|login|account)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([\w.@+-]{2,})")),
)
#: A text with a part that can be reported holds one of these strings, or both a bare hexadecimal string
#: and a numeric address; the others never reach Python.
HOLDS = ("@", "=", ":", "-----BEGIN ", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "glpat-", "sk_live_")
SCHEMA = "doc_id long, kind string, role string, strong boolean, start long, end long"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def apart(spans: list[tuple[int, int]], spots: list[tuple[int, int]]) -> list[bool]:
    """Whether each of the ascending spans overlaps none of the spots, which don't overlap each other."""
    spots = sorted(spots)
    k, out = 0, []
    for a, b in spans:
        while k < len(spots) and spots[k][1] <= a:
            k += 1
        out.append(k == len(spots) or spots[k][0] >= b)
    return out


def parts(text: str) -> list[tuple[str, str, bool, int, int]]:
    """(kind, role, strong, start, end) of a text's parts, in order of position."""
    found: list[tuple[str, str, bool, int, int]] = []
    taken: dict[str, list[tuple[int, int]]] = {"secret": [], "identifier": [], "endpoint": []}
    for kind, role, strong, pattern in PATTERNS:
        got = [(*m.span(1), m[1]) for m in pattern.finditer(text)]
        if not got:
            continue
        spans = [(a, b) for a, b, _ in got]
        if role == "endpoint":
            free = [x and y for x, y in zip(apart(spans, taken[role]), apart([(a, a + 1) for a, _ in spans], taken["secret"]), strict=True)]
        else:
            free = apart(spans, taken["secret"] + taken["identifier"])
        for (a, b, part), good in zip(got, free, strict=True):
            if good:
                sure = strong if strong is not None else b - a >= 16 and entropy(part) >= 3
                found.append((kind, role, sure, a, b))
                taken[role].append((a, b))
    return sorted(found, key=lambda p: (p[3], p[4]))


def all_parts(docs: DataFrame) -> DataFrame:
    """doc_id, kind, role, strong, start, end of the parts of all texts in which one may be reported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = parts(text)
                ids += [doc] * len(got)
                rows += got
            kind, role, strong, start, end = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kind, pa.string()), pa.array(role, pa.string()), pa.array(strong, pa.bool_()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "kind", "role", "strong", "start", "end"])

    t = F.col("text")
    some = t.rlike(r"[0-9]\.[0-9]") & t.rlike("[0-9a-f]{32}")
    for s in reversed(HOLDS):
        some = t.contains(s) | some
    likely = texts(docs).where("doc_id IS NOT NULL").where(some)
    return likely.mapInArrow(run, SCHEMA).distinct()


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The reported parts of all_parts(), with how many complementary parts each has and the nearest's distance."""
    width = 4 * reach + 1
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    left = found.select("*", bucket(F.col("start") - 2 * reach, F.col("end") - 1 + 2 * reach).alias("bucket"))
    other = found.select(F.col("doc_id").alias("o_doc"), F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), bucket(F.col("start"), F.col("end") - 1).alias("o_bucket"))
    complementary = (F.col("role") == "secret") != (F.col("o_role") == "secret")
    near = (F.col("o_start") - reach < F.col("end") + reach) & (F.col("start") - reach < F.col("o_end") + reach)
    on = (F.col("doc_id") == F.col("o_doc")) & (F.col("bucket") == F.col("o_bucket")) & complementary & near
    gap = F.greatest(F.lit(0), F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end")).cast("long")
    key = ["doc_id", "kind", "role", "strong", "start", "end"]
    linked = left.join(other, on, "left").select(*key, "o_role", "o_start", "o_end", F.when(F.col("o_doc").isNotNull(), gap).alias("gap"))
    per_part = linked.groupBy(*key).agg(
        F.count_distinct(F.when(F.col("gap").isNotNull(), F.struct("o_role", "o_start", "o_end"))).alias("n_linked"),
        F.array_join(F.array_sort(F.collect_set("o_role")), ",").alias("linked_roles"),
        F.min("gap").alias("nearest"),
    )
    return per_part.where("strong OR n_linked > 0")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, kind, role, strong, start, end, n_linked, linked_roles, nearest (null if nothing is linked)."""
    return link(cut(all_parts(docs)), reach)  # both sides of the join read the parts, and the texts are scanned once
