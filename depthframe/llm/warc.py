r"""WARC derivative builder: linked metadata and plain-text conversion records from response records.

For every response two records follow: ``metadata`` (a JSON block with the source's HTTP headers, its digests, the
page's title and links) and ``conversion`` (its plain text). Both say which response they come from in WARC-Refers-To,
WARC-Refers-To-Target-URI and WARC-Refers-To-Date, keep its target, and have a block digest of their own; the source's
payload digest stays with both. Record ids are name-based UUIDs of the source's id and the kind of record, so that
reruns give the same files and links.

How it scales. Every response is turned into its records where it lies; nothing is shuffled or gathered. A page is read
forward, in time that grows with its length alone, whatever it leaves open.

Defined cases: null HTML is an empty payload and null URL an empty target; repeated rows give repeated records (the
same ids); an unclosed comment, script, style or tag ends with the page, other unclosed elements hide no text; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices

VERSION = "WARC/1.1"
#: Date of responses whose source has none.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

# What is never shown: comments, scripts and styles, to the page's end if unclosed; other such elements only if they are closed.
_UNSEEN = ("script", "style", "title", "noscript", "template", "svg", "iframe")
_OPEN = re.compile(rf"<(?:!--|(?:{'|'.join(f'(?P<{n}>{n})' for n in _UNSEEN)})\b[^>]*>)", re.I)
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in _UNSEEN}
# A head without its end stops at the first tag that can't stand in one.
_HEAD = re.compile(r"<head\b[^>]*>", re.I)
_HEAD_END = re.compile(r"</head\s*>|(?=</?(?!(?:title|meta|link|base|basefont|bgsound|noscript|template|noframes)\b)[a-z])", re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<(?:/?[A-Za-z]|[!?])[^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_A = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _last_tag(page: str) -> int:
    """Where the last tag ends: a search for whole tags that stops there doesn't read the rest anew at each open one."""
    return page.rfind(">") + 1


def _shown(page: str) -> str:
    """The page without what is never shown, in one scan: no closing tag is searched for again once it is known to be missing."""
    out, at, tags, missing = [], 0, _last_tag(page), set()
    while m := _OPEN.search(page, at, tags):
        out.append(page[at : m.start()])
        name, at = m.lastgroup, m.end()
        if name is None:
            at = page.find("-->", at) + 3
            if at < 3:
                return " ".join(out) + " "
        elif name not in missing and not (name == "svg" and m[0].endswith("/>")):
            if end := _CLOSE[name].search(page, at):
                at = end.end()
            elif name in ("script", "style"):
                return " ".join(out) + " "
            else:
                missing.add(name)
    comment = page.find("<!--", max(at, tags))
    out.append(page[at:] if comment < 0 else page[at:comment] + " ")
    return " ".join(out)


def _body(page: str) -> str:
    """The page without its head."""
    out, at, tags = [], 0, _last_tag(page)
    while m := _HEAD.search(page, at, tags):
        out.append(page[at : m.start()])
        end = _HEAD_END.search(page, m.end())
        at = end.end() if end else len(page)
    return " ".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """The page's visible text: one line for each block, white space collapsed, entities resolved."""
    marked = _TAG.sub("", _BREAK.sub("\n", _body(_shown(page))))
    lines = (" ".join(x.split()) for x in html.unescape(marked).split("\n"))
    return "\n".join(x for x in lines if x)


def title(page: str) -> str:
    m = _TITLE.search(page, 0, _last_tag(page))
    if not m:
        return ""
    end = _CLOSE["title"].search(page, m.end())
    return " ".join(html.unescape(page[m.end() : end.start() if end else len(page)]).split())


def page_links(page: str) -> list[str]:
    """The href of every a tag; what is left open between two tags counts as part of the first."""
    out, at = [], 0
    while m := _A.search(page, at):
        end = page.find(">", m.end())
        at = end = end if end >= 0 else len(page)
        for name in _HREF.finditer(page, m.end(), end):
            if value := _VALUE.match(page, name.end()):
                out.append(html.unescape(next((g for g in value.groups() if g), "")))
                at = value.end()
                break
    return out


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(names))}>"


RESPONSE = "page_id long, record_id string, target_uri string, date string, headers map<string,string>, payload string"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_headers map<string,string>, block string"
_TYPES = pa.schema([("page_id", pa.int64()), *[(n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type")], ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()), ("source_headers", pa.map_(pa.string(), pa.string())), ("block", pa.string())])


def responses(pages: DataFrame) -> DataFrame:
    """Response records (RESPONSE) of fetched pages (page_id, url, html)."""
    payload, target = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("html", "url"))
    name = F.sha1(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), target, F.sha1(payload)))
    # Laid out as a UUID of version 8, whose bits are free to choose.
    part = lambda a, n: F.substring(name, a, n)
    urn = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-a"), part(16, 3), F.lit("-"), part(19, 12), F.lit(">"))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length(payload).cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), urn.alias("record_id"), target.alias("target_uri"), F.lit(DATE).alias("date"), headers.alias("headers"), payload.alias("payload"))


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "payload"):
        rows = []
        for page, source, target, date, headers, payload in zip(*[batch[c].to_pylist() for c in ("page_id", "record_id", "target_uri", "date", "headers", "payload")], strict=True):
            payload, target, headers = payload or "", target or "", dict(headers or [])
            own = digest(payload.encode())
            text = plain_text(payload)
            note = {"Refers-To": source, "Target-URI": target, "Payload-Digest": own, "Payload-Length": len(payload.encode()), "HTTP-Headers": headers, "Title": title(payload), "Links": page_links(payload), "Text-Digest": digest(text.encode())}
            for kind, content_type, block in (("metadata", "application/json", json.dumps(note, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", text)):
                data = block.encode()
                rows.append((page, kind, record_id(source or "", kind), source, target, date, content_type, len(data), digest(data), own, list(headers.items()), block))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_TYPES)], schema=_TYPES)


def derivatives(found: DataFrame) -> DataFrame:
    """Metadata and conversion records (RECORD) of response records."""
    return found.select("page_id", "record_id", "target_uri", "date", "headers", "payload").mapInArrow(_derive, RECORD)


def serialized(records: DataFrame) -> Column:
    """A derived record in WARC form, without the empty lines that end it."""
    lines = [
        F.lit(VERSION),
        *[F.concat(F.lit(f"{name}: "), F.coalesce(records[c].cast("string"), F.lit(""))) for name, c in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))],
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), records["block"])


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one for each partition; two line ends close every record."""
    records.select(serialized(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers (map) and block of every record of WARC files that write_warc wrote; ``complete`` checks the length."""
    raw = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).where("value <> ''")
    cut = F.instr("value", "\r\n\r\n")
    head = F.substring(F.col("value"), F.lit(1), cut - 1)
    body = F.substring(F.col("value"), cut + 4, F.length("value"))
    pairs = F.transform(F.split(head, "\r\n"), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substring(x, F.instr(x, ": ") + 2, F.length(x)).alias("v")))
    rows = raw.select(F.map_from_entries(pairs).alias("headers"), F.regexp_replace(body, r"\r\n\r\n\z", "").alias("block"))
    return rows.withColumn("complete", F.octet_length("block") == F.col("headers")["Content-Length"].cast("int"))
