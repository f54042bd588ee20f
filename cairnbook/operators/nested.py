"""Values of unknown depth: a JSON document is taken apart level by level, cleaned, and put together again.

Each round opens the containers of one depth for all documents at once, so there are as many rounds as the deepest document
has levels. What is redacted is decided on the way down: nothing below a telling key is ever opened or kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.functions.lineage import fixed
from cairnbook.operators.secretscan import scan_body

# Fixed value: key names whose values are credentials.
SENSITIVE_KEY = r"(?i)(api[_-]?key|apikey|access[_-]?token|auth[_-]?token|bearer|password|passwd|secret|private[_-]?key|client[_-]?secret|webhook[_-]?secret|signature|authorization|credential|session[_-]?id|refresh[_-]?token)"
# Names that only exports of credentials hold.
CREDENTIAL_MARKERS = ["encryptedData", "oauthTokenData", "credentials_entity"]
BY_KEY, BY_VALUE = "[REDACTED: key]", "[REDACTED: value]"


def quoted(text: Column) -> Column:
    """A string as JSON."""
    made = F.to_json(F.array(text))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def json_kind(value: Column) -> Column:
    """object, array or leaf, of a variant."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("leaf")


def children(value: Column) -> Column:
    """What a variant holds, as array<struct<pos, key, value>>: the fields of an object in key order, the elements of an
    array without keys; of other values nothing."""
    null = F.parse_json(F.lit("null"))
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    elements = F.try_variant_get(value, "$", "array<variant>")
    one = lambda key, v, i: F.struct(i.alias("pos"), key.cast("string").alias("key"), F.coalesce(v, null).alias("value"))
    return F.when(json_kind(value) == "object", F.transform(fields, lambda x, i: one(x["key"], x["value"], i))).otherwise(F.transform(elements, lambda v, i: one(F.lit(None), v, i)))


def _judged(nodes: DataFrame) -> DataFrame:
    """nodes (…, key, value) with kind, text (of leaves) and reason (key, or the kinds of secrets; null: kept)."""
    string = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    kinds = F.when(string.isNotNull(), F.array_join(scan_body(string), ","))
    reason = F.when(F.col("key").rlike(SENSITIVE_KEY), "key").when(kinds != "", kinds)
    out = nodes.withColumn("reason", reason)
    out = out.withColumn("kind", F.when(F.col("reason").isNotNull(), "leaf").otherwise(json_kind(F.col("value"))))
    text = F.when(F.col("reason") == "key", F.lit(f'"{BY_KEY}"')).when(F.col("reason").isNotNull(), F.lit(f'"{BY_VALUE}"')).when(F.col("kind") == "leaf", F.to_json("value"))
    return out.withColumn("text", text)


def redact_nested(docs: DataFrame, column: str = "params") -> tuple[DataFrame, DataFrame]:
    """docs: id, a JSON text. Returns (id and the text with every value under a telling key and every string that holds a
    secret replaced; id, path, reason of what was replaced). Keys are reported, values never. Text that is no JSON, or
    null, gives null: what can't be searched isn't kept. Objects come back with their keys in order. Ids must be the
    rows' own."""
    root = docs.select("id", F.try_parse_json(column).alias("value")).filter("value is not null")
    level = fixed(_judged(root.select("id", F.lit("").alias("at"), F.lit(None).cast("string").alias("above"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.lit("$").alias("path"), "value")))
    levels = [level]
    while not (open_ := level.filter("kind <> 'leaf'")).isEmpty():
        inner = open_.select("id", F.col("at").alias("above"), "path", F.explode(children(F.col("value"))).alias("c")).select("id", "above", "path", "c.*")
        at = F.concat_ws("/", F.when(F.col("above") != "", F.col("above")), F.col("pos").cast("string"))
        path = F.concat("path", F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        level = fixed(_judged(inner.select("id", at.alias("at"), "above", "pos", "key", path.alias("path"), "value")))
        levels.append(level)
    found = levels[0].filter("reason is not null").select("id", "path", "reason")
    for one in levels[1:]:
        found = found.unionByName(one.filter("reason is not null").select("id", "path", "reason"))
    texts = levels[-1].select("id", "at", "above", "pos", "key", "text")  # the deepest level has leaves only
    for one in reversed(levels[:-1]):
        part = F.concat(F.when(F.col("key").isNotNull(), F.concat(quoted(F.col("key")), F.lit(":"))).otherwise(""), "text")
        inner = texts.groupBy("id", F.col("above").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), ",").alias("inner"))
        joined = one.join(inner, ["id", "at"], "left")
        body = F.coalesce("inner", F.lit(""))
        whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), body, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.col("text"))
        texts = joined.select("id", "at", "above", "pos", "key", whole.alias("text"))
    return docs.select("id").join(texts.select("id", F.col("text").alias(column)), "id", "left"), found


def refused_exports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: path, text. (files to read, files that look like an export of credentials): the latter are never stored."""
    hit = F.lit(False)
    for marker in CREDENTIAL_MARKERS:
        hit = hit | F.contains(F.coalesce("text", F.lit("")), F.lit(marker))
    return files.filter(~hit), files.filter(hit).select("path")
