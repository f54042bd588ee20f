"""Secrets in texts: kinds, spans, redaction and reports. Values never leave the text that holds them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Public formats of credentials. Long hex alone is never one: content addresses look the same.
PATTERNS = {
    "assistant_key": r"sk-ant-[A-Za-z0-9_-]{20,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "connection_string": r"[a-z][a-z0-9+]{2,15}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[^\s/]+",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "mail_key": r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "notes_token": r"ntn_[A-Za-z0-9]{30,}",
    "token_assignment": r"(?i)\b(?:token|secret|password|api_?key)\s*[=:]\s*[\"'][A-Za-z0-9_-]{16,}[\"']",
    "url_token": r"[?&](?:token|access_token|sig)=[A-Za-z0-9_%-]{16,}",
}
#: Placeholders aren't secrets.
PLACEHOLDER = r"(?i)your_|\$\{|<[a-z_ ]+>|user:pass|username:password|postgres:postgres|example_?(?:key|token)|x{8,}"


def scan_body(text: Column) -> Column:
    """Kinds found in the text, in name order; placeholders don't count."""
    found = []
    for kind, pattern in PATTERNS.items():
        hits = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: ~x.rlike(PLACEHOLDER))
        found.append(F.when(text.rlike(pattern), F.when(F.size(hits) > 0, F.lit(kind))))
    return F.array_compact(F.array(*found))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


@F.pandas_udf(_SPANS)
def scan_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Spans of secrets in code points, ordered, without overlaps; the earliest, then the longest wins."""
    compiled = [(k, re.compile(p)) for k, p in PATTERNS.items()]
    placeholder = re.compile(PLACEHOLDER)

    def one(text: str | None) -> list[tuple[int, int, str]]:
        spans = [(m.start(), m.end(), k) for k, p in compiled for m in p.finditer(text or "") if not placeholder.search(m[0])]
        out: list[tuple[int, int, str]] = []
        for s in sorted(spans, key=lambda x: (x[0], -x[1])):
            if not out or s[0] >= out[-1][1]:
                out.append(s)
        return out

    for series in texts:
        yield series.map(one)


def redact_text(text: Column) -> Column:
    """Each secret becomes [REDACTED:kind]; a match that is a placeholder stays, whatever stands beside it."""

    def without(kind: str, pattern: str):
        def step(t: Column) -> Column:
            found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
            shown = F.transform(found, lambda m: F.when(m.rlike(PLACEHOLDER), m).otherwise(F.lit(f"[REDACTED:{kind}]")))
            joined = F.array_join(F.zip_with(between, shown, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")
            return F.when(t.rlike(pattern), joined).otherwise(t)

        return step

    out = F.array(text)  # a list of one: each step names its text once, so steps don't multiply
    for kind, pattern in PATTERNS.items():
        out = F.transform(out, without(kind, pattern))
    return out[0]


def redact_at_ingest(body: Column) -> Column:
    kinds = scan_body(body)
    return F.when(F.size(kinds) > 0, F.concat(F.lit("[WITHHELD: "), F.array_join(kinds, ", "), F.lit("]"))).otherwise(body)


def secret_report(objects: DataFrame) -> DataFrame:
    """kind, object_class, source_id, n objects."""
    kinds = objects.select("object_class", "source_id", F.explode(scan_body(F.col("body"))).alias("kind"))
    return kinds.groupBy("kind", "object_class", "source_id").agg(F.count("*").alias("n"))


def redact_params(params: DataFrame, keys: str = r"(?i)password|secret|token|api_?key|auth|credential") -> DataFrame:
    """params: id, key, value (flattened paths). Values under telling keys, and values that look like secrets, are
    replaced; the keys are reported, the values never."""
    hit = F.col("key").rlike(keys) | (F.size(scan_body(F.coalesce("value", F.lit("")))) > 0)
    return params.withColumn("redacted", F.coalesce(hit, F.lit(False))).withColumn("value", F.when(F.col("redacted"), F.lit("[REDACTED]")).otherwise(F.col("value")))


def redact_objects(objects: DataFrame, indexes: DataFrame, at: str) -> dict[str, DataFrame]:
    """objects: object_id, version_num, body, classification. Redaction as history: every object whose body holds a secret
    gets a corrected version, is restricted, and has an event that names the kinds; all indexes are stale if there is one
    such object, since they still hold what went. Values stay in the evidence alone. The same again changes nothing."""
    kinds = scan_body(F.col("body"))
    hit = objects.withColumn("kinds", kinds).filter(F.size("kinds") > 0)
    when = F.lit(at).cast("timestamp")
    version = F.concat("object_id", F.lit(":v"), F.lpad((F.col("version_num") + 1).cast("string"), 2, "0"))
    versions = hit.select(version.alias("version_id"), "object_id", (F.col("version_num") + 1).alias("version_num"), redact_text(F.col("body")).alias("body"), F.lit("corrected").alias("change_type"), when.alias("created_at"))
    events = hit.select(F.concat(F.lit("EVT-"), version).alias("event_id"), "object_id", F.lit("MODIFIED").alias("operation"), F.concat(F.lit("redacted: "), F.array_join("kinds", ",")).alias("reason"), when.alias("timestamp"))
    gone = hit.select("object_id").distinct().withColumn("_hit", F.lit(True))
    met = objects.join(gone, "object_id", "left")
    after = met.select("object_id", F.when(F.col("_hit"), F.col("version_num") + 1).otherwise(F.col("version_num")).alias("version_num"), F.when(F.col("_hit"), redact_text(F.col("body"))).otherwise(F.col("body")).alias("body"), F.when(F.col("_hit"), "RESTRICTED").otherwise(F.col("classification")).alias("classification"))
    any_ = gone.agg((F.count("*") > 0).alias("_any"))
    stale = indexes.join(F.broadcast(any_)).withColumn("status", F.when(F.col("_any"), "STALE").otherwise(F.col("status"))).drop("_any")  # one row
    return {"objects": after, "versions": versions, "events": events, "indexes": stale}
