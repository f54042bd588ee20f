"""Exports that need a parser: bookmark files, mailboxes and CSV files with a preamble."""

from __future__ import annotations

import csv
import email
import email.policy
import email.utils
import hashlib
import io
import re
from collections.abc import Iterator
from email.headerregistry import HeaderRegistry
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.functions.lineage import spread, stored
from cairnbook.sources.items import item

_BOOKMARK = re.compile(r"<(/?DL)\b|<H3[^>]*>(.*?)</H3>|<A\b([^>]*)>(.*?)</A>", re.I | re.S)
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')


def scan_bookmarks(files: DataFrame) -> DataFrame:
    """files: path, text (one bookmark file a row). Returns path, href, title, add_date, folder: the folder is the
    stack of headings around an anchor. Nesting is sequential, so a file is one row's work."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                stack: list[str] = []
                heading = ""
                for m in _BOOKMARK.finditer(text or ""):
                    if m[1]:
                        if m[1].startswith("/"):
                            stack[-1:] = []
                        else:
                            stack.append(heading)
                            heading = ""
                    elif m[2] is not None:
                        heading = unescape(re.sub(r"<[^>]*>", "", m[2])).strip()
                    else:
                        a = {k.upper(): unescape(v) for k, v in _ATTRIBUTE.findall(m[3])}
                        added = a.get("ADD_DATE", "")
                        out.append((path, a.get("HREF"), unescape(re.sub(r"<[^>]*>", "", m[4])).strip(), int(added) if added.isdigit() else None, "/".join(x for x in stack if x)))
            yield pd.DataFrame(out, columns=["path", "href", "title", "add_date", "folder"]).astype({"add_date": "Int64"})

    return files.select("path", "text").mapInPandas(run, "path string, href string, title string, add_date long, folder string")


def read_mailboxes(spark: SparkSession, glob: str) -> DataFrame:
    """mailbox, raw: messages of mbox files, split in parallel at their From lines."""
    lines = spark.read.option("lineSep", "\nFrom ").text(glob)
    return lines.select(F.col("_metadata.file_path").alias("mailbox"), F.regexp_replace("value", r"^(?:From )?[^\n]*\n", "").alias("raw")).filter("trim(raw) <> ''")


# Fixed value: what plain parts say that stand in for an HTML body.
STUB = re.compile(r"(requires?\s+(an?\s+)?html|view\s+(this|the)\s+(e-?mail|message)\s+in|plain[\s-]?text\s+version|if\s+you\s+(cannot|can't)\s+(see|read|view)|enable\s+html|html[\s-]?capable)", re.I)


def _body(message: email.message.EmailMessage) -> tuple[str, str]:
    """The plain part, or the HTML without its tags where the plain one is empty or a stub."""
    part = lambda kind: message.get_body(preferencelist=(kind,))
    plain, html = (p.get_content() if (p := part(k)) is not None else "" for k in ("plain", "html"))
    text = re.sub(r"\s+", " ", unescape(re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", html))).strip()
    few = len(plain.split()) < 40 and len(text.split()) > 1.5 * len(plain.split())
    return (text, "html") if text and (not plain.strip() or few or STUB.search(plain)) else (plain, "plain")


def _attached(message: email.message.EmailMessage) -> list[dict]:
    """The named parts with their bytes."""
    out = []
    for part in message.walk():
        if part.get_filename() and not part.is_multipart():
            raw = part.get_payload(decode=True) or b""
            out.append({"name": part.get_filename(), "mime": part.get_content_type(), "bytes": len(raw), "content_hash": hashlib.sha256(raw).hexdigest(), "content": raw})
    return out


def parse_messages(messages: DataFrame) -> DataFrame:
    """mailbox, message_id, subject, from, to, date, in_reply_to, body, body_part, attachments (names), error, references,
    list_id, files (array<struct<name, mime, bytes, content_hash, content>>). A message without an id gets one from its
    head and text, so it is the same in every export; a broken one has its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the policy parses a header each time that something asks for it, content types a dozen times a message
        policy = email.policy.default.clone(header_factory=lru_cache(maxsize=1 << 12)(HeaderRegistry()))
        for frame in frames:
            out = []
            for mailbox, raw in zip(frame["mailbox"], frame["raw"], strict=True):
                try:
                    m = email.message_from_string(raw, policy=policy)
                    body, which = _body(m)
                    addresses = lambda k, m=m: [a for _, a in email.utils.getaddresses([str(x) for x in m.get_all(k, [])])]
                    head = "|".join(str(m.get(k, "")) for k in ("From", "Subject", "Date"))
                    mid = str(m.get("Message-ID", "")).strip() or "sha256:" + hashlib.sha256(f"{head}|{body[:4000]}".encode()).hexdigest()[:32]
                    files = [a.get_filename() or "" for a in m.iter_attachments()]
                    out.append((mailbox, mid, str(m.get("Subject", "")), addresses("From"), addresses("To") + addresses("Cc"), str(m.get("Date", "")), str(m.get("In-Reply-To", "")).strip() or None, body[:400_000], which, files, None, str(m.get("References", "")).split(), str(m.get("List-Id", "")).strip() or None, _attached(m)))
                except Exception as error:  # a broken message goes to quarantine, the mailbox goes on
                    out.append((mailbox, None, None, [], [], None, None, None, None, [], f"{type(error).__name__}: {error}"[:500], [], None, []))
            yield pd.DataFrame(out, columns=["mailbox", "message_id", "subject", "from", "to", "date", "in_reply_to", "body", "body_part", "attachments", "error", "references", "list_id", "files"])

    # a message costs a thousand times its bytes' reading: no file's layout decides how many tasks share them
    return spread(messages.select("mailbox", "raw"), "raw").mapInPandas(run, "mailbox string, message_id string, subject string, `from` array<string>, `to` array<string>, date string, in_reply_to string, body string, body_part string, attachments array<string>, error string, references array<string>, list_id string, files array<struct<name:string,mime:string,bytes:long,content_hash:string,content:binary>>")


def scan_mail(parsed: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parsed: what parse_messages gives. identities: mailbox, identity (the owner's address, declared by hand). Returns
    (items of messages with direction, references and list; REPLY_TO edges by In-Reply-To; attached files with the
    message they came with). Broken messages are left to quarantine; an undated one has no time; a message that stands in
    two mailboxes is one item for each owner. Messages are parsed once for all three."""
    good = stored(parsed.filter("error is null")).join(identities, "mailbox")
    native = lambda c: F.concat(F.lit("msg:"), c)
    sent = F.exists("from", lambda a: F.lower(a) == F.lower("identity"))
    facts = F.to_json(F.struct(F.col("from"), F.col("to"), F.when(sent, "sent").otherwise("received").alias("direction"), F.when(F.size("references") > 0, F.col("references")).alias("references"), "list_id", "in_reply_to", "body_part", F.transform("files", lambda f: F.struct(f["name"], f["mime"], f["bytes"], f["content_hash"])).alias("attachments")))
    # "Mon, 01 Jan 2024 10:00:00 +0100": the weekday and comments may be missing
    stamp = F.regexp_extract("date", r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}(?::\d{2})?) *([+-]\d{4})?", 0)
    form = F.when(stamp.rlike(r"[+-]\d{4}$"), F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss xx"))).otherwise(F.try_to_timestamp(F.trim(stamp), F.lit("d MMM yyyy HH:mm:ss")))
    subject = F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)"))
    items = good.select(*item("mail", F.lower("identity"), native(F.col("message_id")), "EmailMessage", F.substring(subject, 1, 500), F.nullif("body", F.lit("")), F.sha2(F.concat_ws("\n", subject, F.array_join("from", ","), "body"), 256), created=form, modified=form, metadata=facts)).dropDuplicates(["account_id", "native_id"])
    edges = good.filter("in_reply_to is not null and in_reply_to <> message_id").select(native(F.col("message_id")).alias("source_native"), native(F.col("in_reply_to")).alias("target_native"), F.lit("REPLY_TO").alias("type")).distinct()
    files = good.select(native(F.col("message_id")).alias("native_id"), F.explode("files").alias("f")).select("native_id", "f.*")
    return items, edges, files


def read_csv_rows(files: DataFrame, look_at: int = 12) -> DataFrame:
    """files: path, content. Returns path, row_num, row (map) of CSV files: the header is the one of the first lines
    under which most rows have the same number of cells. Encodings are tried in turn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                text = ""
                for encoding in ("utf-8-sig", "cp1252", "latin-1"):
                    try:
                        text = bytes(content).decode(encoding)
                        break
                    except UnicodeError:
                        continue
                rows = [r for r in csv.reader(io.StringIO(text)) if r]
                if not rows:
                    continue
                fit = lambda k, rows=rows: (sum(len(r) == len(rows[k]) for r in rows[k:]) / len(rows[k:]), len(rows[k]))
                best = max(range(min(look_at, len(rows))), key=lambda k: (*fit(k), -k))
                out.extend((path, n, dict(zip(rows[best], r, strict=False))) for n, r in enumerate(rows[best + 1:]))
            yield pd.DataFrame(out, columns=["path", "row_num", "row"])

    return files.select("path", "content").mapInPandas(run, "path string, row_num long, row map<string,string>")
