"""Operator 7, WARC derivatives: metadata and plain-text conversion records for responses.

A response record gives two records that refer to it: ``metadata`` (application/warc-fields: title, language,
links out, and the source's headers) and ``conversion`` (text/plain). Record ids come from the address, the
page's id and the kind, so a rerun gives the same ids. Every record is made from one row; nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.llm.tokens import as_bytes, narrow_batches

DATE = "2026-01-01T00:00:00Z"
#: Bytes of records that a reader passes on at once.
AT_ONCE = 8 << 20
FIELDS = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block binary, block_digest string, payload_digest string, source_headers map<string,string>"
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title|head|body|html"
# None of these looks at a stretch of a page more than a few times: what could run to the end of the page ends there, or is
# only tried before the last ">" (see closed).
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!doctype[^>]*(?:>|\Z)", re.I | re.S)
_BREAK = re.compile(rf"</?(?:{_BLOCKS})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^>]*>", re.I)
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title", re.I)
_HTML, _LANG = re.compile(r"<html\b([^>]*)", re.I), re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK, _ATTRIBUTE = re.compile(r"<a(?=[\s/>])", re.I), re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*)?", re.I)
_BARE = re.compile(r"[^\s>]+")
#: Numbers of characters that aren't any; Python reads no number of thousands of digits.
_NO_CHARACTER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, url: str, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page} {url}')}>"


def unescaped(text: str) -> str:
    return html.unescape(_NO_CHARACTER.sub("\ufffd", text))


def closed(pattern: re.Pattern, by: str, text: str) -> str:
    """``text`` with each tag that ``pattern`` finds replaced. No tag ends after the last ">", and every one that begins before it ends."""
    end = text.rfind(">") + 1
    return pattern.sub(by, text[:end]) + text[end:]


def plain_text(source: str) -> str:
    """A page's text: one line for each block, white space collapsed, scripts, styles and comments left out."""
    text = closed(_TAG, "", closed(_BREAK, "\n", _HIDDEN.sub("", source)))
    lines = (" ".join(x.split()) for x in unescaped(text).split("\n"))
    return "\n".join(x for x in lines if x)


def outlinks(source: str) -> list[str]:
    """Link targets in the order they come first: the ``href`` of each ``a`` element, read attribute by attribute.

    An attribute that is never closed, by its quote or by the tag's end, ends the search.
    """
    shown, found, at = _HIDDEN.sub("", source), [], 0
    last = shown.rfind(">")
    while (tag := _LINK.search(shown, at)) and tag.end() <= last:
        at, target = tag.end(), None
        while (one := _ATTRIBUTE.match(shown, at)) is not None:
            at, value = one.end(), None
            if shown[at - 1] == "=" or "=" in one[0]:
                quote = shown[at : at + 1]
                if quote in ("'", '"'):
                    end = shown.find(quote, at + 1)
                    if end < 0:
                        return list(dict.fromkeys(found))
                    value, at = shown[at + 1 : end], end + 1
                elif bare := _BARE.match(shown, at):
                    value, at = bare[0], bare.end()
            if target is None and value is not None and one[1].lower() == "href":
                target = value
        if target is not None:
            found.append(unescaped(target))
    return list(dict.fromkeys(found))


def title_of(source: str) -> str | None:
    """What the first title element holds."""
    begin = _TITLE.search(source, 0, source.rfind(">") + 1)
    end = begin and _TITLE_END.search(source, begin.end())
    return source[begin.end() : end.start()] if end else None


def language_of(source: str) -> str | None:
    tag = _HTML.search(source)
    found = _LANG.findall(tag[1]) if tag else []
    return found[-1] if found else None


def decoded(body: bytes, headers: dict[str, str]) -> str:
    """A body as text, by the charset of its Content-Type if Python knows that, else as UTF-8; what isn't valid is replaced."""
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), "")
    named = _CHARSET.search(kind)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def http_response(body: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (the status line under ``:status``) and the body of an HTTP response; values of a header that comes several times are joined by commas."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return {}, block
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {":status": first}
    for name, _, value in (x.partition(":") for x in lines):
        name, value = name.strip(), value.strip()
        if name:
            headers[name] = f"{headers[name]}, {value}" if name in headers else value
    return headers, body


def derive(response: dict) -> list[dict]:
    """The metadata and conversion record of one response record."""
    headers, body = split_http(response["block"])
    source = decoded(body, headers)
    title, language = title_of(source), language_of(source)
    one_line = lambda x: " ".join(unescaped(x).split())
    fields = [("title", one_line(closed(_TAG, "", title)))] if title is not None else []
    fields += [("languageOfDocument", language)] if language else []
    fields += [("outlink", one_line(x)) for x in outlinks(source)] + [(f"source-{k.lstrip(':')}", one_line(v)) for k, v in sorted(headers.items())]
    own = {"refers_to": response["record_id"], "target_uri": response["target_uri"], "date": response["date"], "payload_digest": response["payload_digest"], "source_headers": headers}
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain; charset=utf-8", plain_text(source))):
        data = block.encode("utf-8", "replace")
        out.append(own | {"type": kind, "record_id": record_id(kind, response["target_uri"], response["record_id"]), "content_type": content_type, "block": data, "block_digest": sha1_digest(data)})
    return out


def _names() -> list[str]:
    return [x.split()[0] for x in FIELDS.split(", ")]


def _types() -> list[pa.DataType]:
    return [{"string": pa.string(), "binary": pa.binary()}.get(x.split()[1], pa.map_(pa.string(), pa.string())) for x in FIELDS.split(", ")]


def _batch(records: list[dict], first: pa.Array | None = None) -> pa.RecordBatch:
    columns = [pa.array([list(r[n].items()) if isinstance(r.get(n), dict) else r.get(n) for r in records], t) for n, t in zip(_names(), _types(), strict=True)]
    return pa.RecordBatch.from_arrays(([first] if first is not None else []) + columns, names=(["page_id"] if first is not None else []) + _names())


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """``page_id`` and a response record for each page. Null addresses and pages count as empty; equal rows give equal records."""
    narrow_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), as_bytes(url_col).alias("_url"), as_bytes(html_col).alias("_html"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = []
            for page, url, body in zip(*(x.to_pylist() for x in b.columns), strict=True):
                uri, block = url.decode("utf-8", "replace"), http_response(body)
                records.append({"type": "response", "record_id": record_id("response", uri, str(page)), "target_uri": uri, "date": date, "content_type": "application/http; msgtype=response", "block": block, "block_digest": sha1_digest(block), "payload_digest": sha1_digest(body), "source_headers": split_http(block)[0]})
            yield _batch(records, b.column(0))

    return rows.mapInArrow(build, f"page_id string, {FIELDS}")


def derivatives(records: DataFrame, carry: str = "page_id") -> DataFrame:
    """``carry`` and the two derived records of each ``response``; records of other types give none.

    ``refers_to`` holds the response's id, ``payload_digest`` the digest of what it carried, ``source_headers``
    its HTTP headers. Blocks without an HTTP head are taken as the body, null ones as empty. Equal rows give equal
    records, null ids stay null, other columns are not looked at. Pages of any length are read whole, in time that
    grows with their length, broken ones too. An empty table gives an empty table.
    """
    narrow_batches(records.sparkSession)
    rows = records.where("type = 'response'").select(F.col(carry).cast("string").alias("page_id"), *_names())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [derive({"block": r["block"] or b"", "record_id": r["record_id"], "target_uri": r["target_uri"] or "", "date": r["date"], "payload_digest": r["payload_digest"]}) for r in b.to_pylist()]
            ids = b.column(0).take(pa.array([i for i in range(b.num_rows) for _ in range(2)], pa.int64()))
            yield _batch([x for two in made for x in two], ids)

    return rows.mapInArrow(build, f"page_id string, {FIELDS}")


# --- the file format ---

_HEADS = (("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"))


def to_bytes(record: dict) -> bytes:
    """A record in WARC/1.1, as a gzip member of its own; members put one after the other are a file."""
    one_line = lambda x: " ".join(x.split())
    lines = ["WARC/1.1"] + [f"{h}: {one_line(record[c])}" for h, c in _HEADS if record.get(c)]
    lines += [f"WARC-Source-Header: {k}={one_line(v)}" for k, v in sorted((record.get("source_headers") or {}).items())]
    head = "\r\n".join([*lines, f"Content-Length: {len(record['block'])}"])
    return gzip.compress(head.encode() + b"\r\n\r\n" + record["block"] + b"\r\n\r\n", mtime=0)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, compressed or not, one after the other: a record at a time is decompressed."""
    raw = io.BytesIO(data)
    file = gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw
    columns = {h.lower(): c for h, c in _HEADS}
    while line := file.readline():
        if not line.strip():  # what separates records
            continue
        record: dict = {n: None for n in _names()} | {"source_headers": {}}
        length = 0
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            if name.lower() == "content-length":
                length = int(value)
            elif name.lower() == "warc-source-header":
                k, _, v = value.strip().partition("=")
                record["source_headers"][k] = v
            elif name.lower() in columns:
                record[columns[name.lower()]] = value.strip()
        record["block"] = file.read(length)
        yield record


def members(records: DataFrame, carry: str = "page_id") -> DataFrame:
    """``(carry, type, member)``: each record as the bytes of a gzip member, for a file or an object store."""
    narrow_batches(records.sparkSession)
    rows = records.select(F.col(carry).cast("string").alias("page_id"), *_names())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [to_bytes(r | {"block": r["block"] or b"", "source_headers": dict(r["source_headers"] or [])}) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["page_id", "type", "member"])

    return rows.mapInArrow(build, "page_id string, type string, member binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, one file to a task, through Spark's own reader, which takes files up to 2 GB. Records are
    decompressed and passed on a few at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                held, size = [], 0
                for record in parse(content.as_py()):
                    held.append(record)
                    size += len(record["block"])
                    if size > AT_ONCE:
                        yield _batch(held, pa.array([name.as_py()] * len(held), pa.string()))
                        held, size = [], 0
                yield _batch(held, pa.array([name.as_py()] * len(held), pa.string()))

    return files.mapInArrow(load, f"page_id string, {FIELDS}")
