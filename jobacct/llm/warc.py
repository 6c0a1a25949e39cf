"""Operator 10: WARC derivatives.

Response records become two linked records each: a plain-text *conversion*
and a *metadata* record (``application/warc-fields``). Both carry
``WARC-Refers-To`` (the response's id), the target URI and the date; the
conversion names the digest of the payload that it was made from, the metadata
record keeps the source's HTTP status and headers, its digests, title and
link count, and names the conversion (``WARC-Concurrent-To``). Digests are
``sha1:`` and base32; ids are name-based UUIDs, so a second run, or a task that
runs again, gives the same records.

Record id, date, HTTP status line and headers, payload and block digest of a
response come from columns where the input has them (``Given``) and pass into the
derivatives unchanged. Where a column is absent or a value null, the response is
made up from URL and page: status 200, two headers, DATE, name-based id, digests
of the UTF-8 page. A given payload digest is of the fetched bytes, which a decoded
page need not have any more: it is kept, and the metadata record states the
digest of the decoded page beside it.

Each response is converted in its own row, without a shuffle: memory is that of
a few pages, and a lost executor costs its tasks. ``write_warc`` writes records
as WARC 1.1 text files with Spark's own writer.

Odd inputs: a null page is a response with an empty payload and gives records
with an empty text; a null URL leaves out WARC-Target-URI. Repeated rows give
repeated records with equal ids. An empty table gives no records. Extra columns
are dropped.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from base64 import b32encode
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobacct.llm.common import SLICE

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"  # of pages that carry none
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivatives")

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre|title|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LINK = re.compile(r"<a\b[^<>]*\bhref\b", re.I)
_BLANK = re.compile(r"[^\S\n]+")


def plain_text(page: str) -> str:
    """Visible text: one line for each block, white space folded, entities resolved."""
    t = html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page))))
    return "\n".join(x for line in t.split("\n") if (x := _BLANK.sub(" ", line).strip()))


def digest(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def record(kind: str, target: str | None, date: str, content_type: str, block: str, record_id: str | None = None,
           block_digest: str | None = None, **more: str) -> dict:
    """One record: its header and block, with id, length and digests. A given id or block digest is kept."""
    data = _utf8(block)
    own = block_digest or digest(data)
    name = "|".join([kind, target or "", date, *more.values(), own])
    out = {"record_type": kind, "record_id": record_id or f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>", "target_uri": target, "warc_date": date,
           "content_type": content_type, "content_length": len(data), "block_digest": own, "block": block}
    lines = [("WARC-Type", kind), ("WARC-Record-ID", out["record_id"]), ("WARC-Date", date), ("WARC-Target-URI", target)]
    lines += [("WARC-" + k.replace("_", "-"), v) for k, v in more.items()]
    lines += [("WARC-Block-Digest", out["block_digest"]), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
    # a line break inside a value would end the header
    out["header"] = "WARC/1.1" + CRLF + "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}{CRLF}" for k, v in lines if v is not None)
    return out


@dataclass(frozen=True)
class Given:
    """Columns (strings) that hold what a crawler stored of its responses; null or absent: made up."""

    record_id: str | None = None  # with its angle brackets
    date: str | None = None  # as in WARC-Date
    http_head: str | None = None  # status line and header lines
    payload_digest: str | None = None
    block_digest: str | None = None


def response(url: str | None, page: str | None, date: str | None = None, record_id: str | None = None, http_head: str | None = None,
             payload_digest: str | None = None, block_digest: str | None = None) -> dict:
    """The response record of a fetched page, with its HTTP head and payload apart."""
    payload = page or ""
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(_utf8(payload))}" if http_head is None else http_head.rstrip("\r\n")
    own = payload_digest or digest(_utf8(payload))
    out = record("response", url, date or DATE, "application/http; msgtype=response", head + CRLF + CRLF + payload, record_id, block_digest, Payload_Digest=own)
    return out | {"http_head": head, "payload": payload, "payload_digest": own}


def derive(source: dict) -> tuple[dict, dict]:
    """Conversion and metadata record of a ``response``."""
    head, payload, payload_digest = source["http_head"], source["payload"], source["payload_digest"]
    lines = [x for x in head.splitlines() if x]
    status = lines.pop(0) if lines and lines[0].startswith("HTTP/") else ""
    decoded = digest(_utf8(payload))
    text = plain_text(payload)
    link = {"Refers_To": source["record_id"], "Refers_To_Target_URI": source["target_uri"] or "", "Refers_To_Date": source["warc_date"]}
    link = {k: v for k, v in link.items() if v}
    conv = record("conversion", source["target_uri"], source["warc_date"], "text/plain; charset=utf-8", text, **link, Source_Payload_Digest=payload_digest)
    title = _TITLE.search(payload)
    fields = [("source-record-id", source["record_id"]), ("source-block-digest", source["block_digest"]), ("source-payload-digest", payload_digest),
              ("source-status", status), *(("source-header", h) for h in lines),
              *([("source-text-digest", decoded)] if decoded != payload_digest else []),
              ("title", _BLANK.sub(" ", html.unescape(title[1])).strip() if title else ""), ("link-count", str(len(_LINK.findall(payload)))),
              ("text-length", str(len(text))), ("conversion-record-id", conv["record_id"]), ("conversion-block-digest", conv["block_digest"])]
    block = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}{CRLF}" for k, v in fields)
    meta = record("metadata", source["target_uri"], source["warc_date"], "application/warc-fields", block, **link, Concurrent_To=conv["record_id"])
    for r in (conv, meta):
        r |= {"refers_to": source["record_id"], "source_payload_digest": payload_digest, "source_headers": head}
    return conv, meta


FIELDS = [("record_type", "string"), ("record_id", "string"), ("refers_to", "string"), ("target_uri", "string"), ("warc_date", "string"),
          ("content_type", "string"), ("content_length", "bigint"), ("block_digest", "string"), ("source_payload_digest", "string"),
          ("source_headers", "string"), ("header", "string"), ("block", "string")]


def derivatives(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", given: Given = Given()) -> DataFrame:
    """``page_id`` and FIELDS: two rows for each row of ``pages``."""
    columns = {k: c for k, c in asdict(given).items() if c is not None}
    src = pages.select(F.col(f"`{page_id}`").alias("_id"), *(F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate([url, page, *columns.values()])))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = zip(*(part.column(i).to_pylist() for i in range(1, part.num_columns)), strict=True)
                rows = [r for u, p, *more in values for r in derive(response(u, p, **dict(zip(columns, more, strict=True))))]
                ids = part.column(0).take(pa.array([i for i in range(part.num_rows) for _ in (0, 1)]))
                cols = [pa.array([r[k] for r in rows], pa.int64() if kind == "bigint" else pa.string()) for k, kind in FIELDS]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=[page_id, *(k for k, _ in FIELDS)])

    schema = ", ".join([f"`{page_id}` {pages.schema[page_id].dataType.simpleString()}", *(f"{k} {kind}" for k, kind in FIELDS)])
    return src.mapInArrow(run, schema)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Records as WARC 1.1: header, blank line, block, and two line ends after each."""
    out = records.select(F.concat("header", F.lit(CRLF), "block").alias("value"))
    out.write.options(lineSep=CRLF + CRLF, **options).text(path)
