"""Text functions: tokens, link and tag extraction, mark-up removal, snippets, size and id formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed list of stop words.
STOP_WORDS = """the a an and or of to in for on with is are was were be been it this that these those as at by from we you i he she they them his her its
not no but if then than so such can will would could should may might must do does did have has had our your their my me us also more most other some any
all one two new use used using into out up down over under about after before what which who whom whose when where why how""".split()
# Fixed weights of the authority tiers.
AUTHORITY = {
    "PRIMARY SOURCE": 1.0, "OFFICIAL DOCUMENTATION": 0.9, "ORIGINAL RESEARCH": 0.9, "HUMAN-VALIDATED PERSONAL KNOWLEDGE": 1.0, "DIRECT PROJECT ARTIFACT": 0.8,
    "TECHNICAL SECONDARY SOURCE": 0.5, "COMMUNITY SOURCE": 0.4, "SOCIAL MEDIA": 0.2, "AI-GENERATED": 0.1, "UNKNOWN": 0.3,
}
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda x: x != "")


def is_stop_word(token: Column) -> Column:
    return token.isin(STOP_WORDS)


def is_identifier(token: Column) -> Column:
    """Digits only, eight or more hex digits, more than 20 characters, 12 or more with a digit, or over 30% digits."""
    n, digits = F.length(token), F.length(F.regexp_replace(token, "[^0-9]", ""))
    return token.rlike("^[0-9]+$") | token.rlike("^[0-9a-f]{8,}$") | (n > 20) | ((n >= 12) & (digits > 0)) | (digits > 0.3 * n)


def authority_weight(tier: Column) -> Column:
    out = F.lit(0.3)
    for name, weight in AUTHORITY.items():
        out = F.when(tier == name, F.lit(weight)).otherwise(out)
    return out


def strip_code(text: Column) -> Column:
    """Without fenced and inline code."""
    return F.regexp_replace(text, r"(?s)```.*?```|~~~.*?~~~|`[^`\n]+`", " ")


def detag(html: Column) -> Column:
    """Without scripts, styles, tags and the common entities; white space is one blank."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def wikilinks(text: Column) -> Column:
    """array<struct<bang, target, alias>> of [[target#heading|alias]] and ![[...]], outside code."""
    found = F.regexp_extract_all(strip_code(F.coalesce(text, F.lit(""))), F.lit(r"(!?\[\[[^\]\n]+\]\])"), F.lit(1))

    def one(x: Column) -> Column:
        inner = F.regexp_replace(x, r"^!?\[\[|\]\]$", "")
        target = F.trim(F.regexp_replace(inner, r"[#|].*$", ""))
        alias = F.when(F.contains(inner, F.lit("|")), F.trim(F.regexp_replace(inner, r"^[^|]*\|", "")))
        return F.struct(x.startswith("!").alias("bang"), target.alias("target"), alias.alias("alias"))

    return F.filter(F.transform(found, one), lambda x: x["target"] != "")


def markdown_links(text: Column) -> Column:
    """Targets of [text](href) inside the collection: percent-decoded, without fragments and external addresses."""
    found = F.regexp_extract_all(strip_code(F.coalesce(text, F.lit(""))), F.lit(r"\[[^\]\n]*\]\(([^)\s]+)\)"), F.lit(1))
    inside = F.filter(found, lambda x: ~x.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|^//|^#"))
    return F.transform(inside, lambda x: F.coalesce(F.try_url_decode(F.substring_index(x, "#", 1)), x))


def hash_tags(text: Column) -> Column:
    """Tags after a blank or at the start, two characters at least, no hex colours; in order, once each."""
    found = F.regexp_extract_all(strip_code(F.coalesce(text, F.lit(""))), F.lit(r"(?:^|(?<=\s))#([A-Za-z][A-Za-z0-9_/-]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(r"^(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")))


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def snippet(text: Column, term: Column, width: int = 12) -> Column:
    """`width` tokens around the first occurrence of the term, which is put in brackets."""
    words = tokens(text)
    at = F.greatest(F.array_position(words, term).cast("int"), F.lit(1))
    start = F.greatest(at - width // 2, F.lit(1))
    return F.array_join(F.transform(F.slice(words, start, F.lit(width)), lambda w: F.when(w == term, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")


def human_size(n: Column) -> Column:
    out = F.format_string("%.1f TB", F.bround(n / float(1 << 40), 1))
    for shift, unit in ((40, "GB"), (30, "MB"), (20, "KB")):
        out = F.when(n < float(1 << shift), F.format_string(f"%.1f {unit}", F.bround(n / float(1 << (shift - 10)), 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n.isNotNull(), out)


def object_id(n: Column) -> Column:
    return F.format_string("KB-%08d", n.cast("long"))


def id_order(id_: Column) -> Column:
    """Sorts ids as their numbers: KB-99999999 before KB-100000000."""
    return F.struct(F.length(id_), id_)


def version_id(object_: Column, n: Column) -> Column:
    return F.concat(object_, F.lit(":v"), F.lpad(n.cast("string"), 2, "0"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?<=.)(\.[^.]*)$", 1))


def parent_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def note_date(name: Column) -> Column:
    """The date in a daily note's name, YYYY MM DD with or without separators; null if there is none."""
    part = lambda k: F.regexp_extract(name, r"((?:19|20)\d{2})[-_.]?(\d{2})[-_.]?(\d{2})", k)
    return F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")


def link_id(href: Column) -> Column:
    """The 32 hex digits that name a note in a link, small; null if there are none."""
    plain = F.coalesce(F.try_url_decode(href), href)
    return F.nullif(F.lower(F.regexp_extract(plain, r"(?i)([0-9a-f]{32})", 1)), F.lit(""))


def flat_value(value: Column, depth: int = 4) -> Column:
    """A variant as text: lists joined by commas (down to `depth` levels, deeper ones as JSON), of objects their name,
    filename or email, else themselves as JSON; null stays null."""
    kind = F.schema_of_variant(value)
    get = lambda k: F.nullif(F.try_variant_get(value, f"$.{k}", "string"), F.lit(""))
    named = F.coalesce(get("name"), get("filename"), get("email"), F.to_json(value))
    joined = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: flat_value(x, depth - 1)), ", ") if depth else F.to_json(value)
    return F.when(kind.startswith("ARRAY"), joined).when(kind.startswith("OBJECT"), named).otherwise(F.try_variant_get(value, "$", "string"))


@F.pandas_udf(T.StringType())
def fix_mojibake(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text that was UTF-8 read as Latin-1 or cp1252 is read again; other text stays."""

    def one(x: str | None) -> str | None:
        for wrong in ("latin-1", "cp1252") if x else ():
            try:
                return x.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
        return x

    for series in values:
        yield series.map(one, na_action="ignore")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def frontmatter(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The flat keys of a note's head between two lines of three dashes. Lists are joined by commas, quotes and brackets
    go, nested blocks stay as written; a head that isn't closed gives the key _unparsed. No head: an empty map."""

    def one(text: str | None) -> dict[str, str]:
        lines = (text or "").replace("\r\n", "\n").split("\n")
        if lines[0].strip() != "---":
            return {}
        end = next((k for k, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        if end is None:
            return {"_unparsed": "true"}
        out: dict[str, str] = {}
        key = None
        for x in lines[1:end]:
            name, colon, value = x.partition(":")
            if x[:1] not in (" ", "\t", "-") and colon:
                key, value = name.strip(), value.strip()
                if value[:1] == "[" and value[-1:] == "]":
                    value = ",".join(v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip())
                out[key] = value.strip("'\"")
            elif key is not None and x.strip():
                item = x.strip()[1:].strip().strip("'\"") if x.strip()[:1] == "-" else x.rstrip()
                out[key] = f"{out[key]},{item}".lstrip(",")
        return out

    for series in values:
        yield series.map(one)
