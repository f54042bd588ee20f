"""Secret scans with linking of multipart credentials.

Strong secrets stand alone: assignments, access keys, long hexadecimal runs. A weak candidate (a short key id or user name,
a random-looking word, an endpoint) is no secret by itself; it is reported when the parts that complement it stand near it
in the same scope, a block between blank lines.

The candidates of a text become narrow rows. An interval join finds for each of them whether a part of each role lies
within REACH characters in its scope: a row asks for the farthest end among the parts before it and the nearest start
among those after it, which two sorted sweeps over the scope answer, so no pair is ever made.

Scale: one pass over the texts, one shuffle of narrow rows by document row; a group holds what one text yields.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.llm.shared import bounded, pieces, text_or_empty

#: The kinds in the order in which spans of one start are listed, and the role of each in a credential.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "material": "secret", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")
#: What a weak candidate needs near it: each inner list must have one of its roles there.
NEEDS = {"identifier": [["secret"]], "material": [["identifier", "endpoint"]], "endpoint": [["identifier"], ["secret"]]}
#: Characters between two parts of one credential, at most.
REACH = 300

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_NAMED = re.compile(r"""(?<![A-Za-z0-9])(user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|(?:access_?)?key_?id|pwd|pass|auth|credential|host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{3,})""", re.I | re.A)
_SHORT_KEY = re.compile(r"(?<![A-Z0-9])A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{4,}")
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_PLACE = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}(?![0-9])""")
_BLANK = re.compile(r"\n[\x20\t\r]*\n\s*")
_CLASSES = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]
_NAMES = {"user": "identifier", "login": "identifier", "account": "identifier", "client": "identifier", "access": "identifier", "key": "identifier", "pwd": "material", "pass": "material", "auth": "material", "credential": "material"}


def _random(word: str) -> bool:
    """Looks drawn, not written: small and large letters and digits, or hexadecimal with many digits."""
    if all(c.search(word) for c in _CLASSES):
        return True
    return re.fullmatch(r"[0-9a-f]{16,23}", word) is not None and len(re.findall("[0-9]", word)) * 4 >= len(word)


def strong(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is a secret by its form alone: leftmost matches of each kind, those that are too
    short dropped without another try."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def weak(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates that touch no strong span, and of those that overlap one another the first, then the longest."""
    found = []
    if ":" in text or "=" in text:
        for m in _NAMED.finditer(text):
            name = re.match("[a-z]+", m[1].lower())[0]
            kind = next((k for n, k in _NAMES.items() if name.startswith(n)), "endpoint")
            if kind != "endpoint" or "." in m[2] or ":" in m[2]:
                found.append((*m.span(2), kind))
        found += [(*m.span(), "endpoint") for m in _PLACE.finditer(text)]
    if "A" in text:
        found += [(*m.span(), "identifier") for m in _SHORT_KEY.finditer(text)]
    found += [(*m.span(), "material") for m in _WORD.finditer(text) if _random(m[0])]
    if not found:
        return found
    out, last, k = [], -1, 0
    walls, furthest = sorted(taken), -1
    for span in sorted(found, key=lambda x: (x[0], -x[1], list(ROLES).index(x[2]))):
        while k < len(walls) and walls[k][0] < span[1]:
            furthest = max(furthest, walls[k][1])
            k += 1
        if span[0] >= last and span[0] >= furthest:
            out.append(span)
            last = span[1]
    return out


_PARTS = T.StructType().add("_row", "long").add("_scope", "long").add("_start", "long").add("_end", "long").add("_kind", "string")



def parts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each strong or weak candidate (_row, _scope, _start, _end, _kind), and one without a kind for each row of
    docs that carries its key. _row numbers the rows of docs, so rows with equal keys stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in pieces(batches, "text"):
            keys = batch.column("_key")
            of, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                of.append(i)
                out.append((row, None, None, None, None))
                base = strong(text)
                more = weak(text, base)
                if base or more:
                    breaks = [m.end() for m in _BLANK.finditer(text)]
                    of += [None] * (len(base) + len(more))
                    out += [(row, bisect_right(breaks, a), a, b, kind) for a, b, kind in (*base, *more)]
                row += 1
            arrays = [keys.take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:4]), pa.array([o[4] for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", *_PARTS.names])

    source = bounded(docs.select(F.col(key).alias("_key"), text_or_empty().alias("text")))
    return source.mapInArrow(run, T.StructType([T.StructField("_key", source.schema["_key"].dataType), *_PARTS.fields]))


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The interval join: adds `_near_<role>`, whether another part of that role lies within `reach` characters in the
    same scope, and `_kept`: strong kinds always, weak ones if all that complements them is near. Rows without a kind
    pass."""
    role = reduce(lambda c, kind: c.when(F.col("_kind") == kind, ROLES[kind]), ROLES, F.when(F.lit(False), ""))
    order = [F.col("_start"), F.col("_end"), F.col("_kind")]
    forward = Window.partitionBy("_row", "_scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("_row", "_scope").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    dealt = found.repartition("_row").withColumn("_role", role)
    names = sorted(set(ROLES.values()))
    swept = dealt.select("*", *[F.max(F.when(F.col("_role") == r, F.col("_end"))).over(forward).alias(f"_before_{r}") for r in names])
    swept = swept.select("*", *[F.min(F.when(F.col("_role") == r, F.col("_start"))).over(backward).alias(f"_after_{r}") for r in names])
    near = {r: F.coalesce(F.col("_start") - F.col(f"_before_{r}") <= reach, F.lit(False)) | F.coalesce(F.col(f"_after_{r}") - F.col("_end") <= reach, F.lit(False)) for r in names}
    any_of = lambda roles: reduce(Column.__or__, [F.col(f"_near_{r}") for r in roles])
    kept = F.col("_kind").isin(*BASE)
    for kind, needs in NEEDS.items():
        kept = kept | ((F.col("_kind") == kind) & reduce(Column.__and__, map(any_of, needs)))
    drop = [f"_{side}_{r}" for side in ("before", "after") for r in names]
    return swept.select("*", *[c.alias(f"_near_{r}") for r, c in near.items()]).withColumn("_kept", F.coalesce(kept, F.lit(False))).drop(*drop)


def scan_credentials(docs: DataFrame, key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """One row for each row of docs: its key and `spans`, an array of (start, kind_no, end, kind), by start, then kind as
    listed in ROLES; code points, the end exclusive.

    Null or empty text: no spans. Rows with equal or null keys are scanned apart, each in its own row. An empty table
    gives no rows. Columns of docs other than the key and text aren't read, so no name clashes. The rows of docs should
    come in the same order if a task is run again, as those of files and written tables do."""
    number = reduce(lambda c, x: c.when(F.col("_kind") == x[1], x[0]), enumerate(ROLES), F.when(F.lit(False), 0))
    span = F.when(F.col("_kept"), F.struct(F.col("_start").alias("start"), number.alias("kind_no"), F.col("_end").alias("end"), F.col("_kind").alias("kind")))
    grouped = link(parts(docs, key), reach).groupBy("_row").agg(F.max("_key").alias(key), F.array_sort(F.collect_list(span)).alias("spans"))
    return grouped.drop("_row")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_credential_linking(spark, sf_dir: str) -> DataFrame:
    found = scan_credentials(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
