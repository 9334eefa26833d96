"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

A record is a row (record_id, rec_type, target_uri, warc_date, headers, block); serialised, it is WARC/1.1 text,
one gzip member if wanted, and members simply follow one another in a file. From each response come a metadata
record (warc-fields: the source's headers and digests, title, language, outlinks) and a conversion record
(text/plain), both with WARC-Refers-To the response's id, its URI and its date. Record ids are UUIDs of version 5
over the source id, so that a task run again writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "record_id string, rec_type string, target_uri string, warc_date string, headers map<string,string>, block binary"
FETCHED = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_CRLF = b"\r\n"
#: Bytes of a compressed payload that are decoded at once, so that what precedes a fault is kept.
_PIECE = 1 << 12
# No pattern reads past the next `<` or `>` before it is sure to match, so each takes time linear in the page.
#: Comments, and elements that hold no text and end with the page where they aren't closed.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Elements that are hidden where they are closed.
_CLOSED = {name: (re.compile(rf"</{name}\s*>", re.I), re.compile(rf"<{name}\b[^<>]*>.*?</{name}\s*>", re.S | re.I)) for name in ("template", "noscript")}
#: A head with what it may hold: blanks, titles, start or end tags alone. It ends at anything else.
_HEAD = re.compile(r"<head\b[^<>]*>(?:\s++|<title\b[^<>]*>(?:[^<]|<(?!/?title\b))*+</title\s*>|</?(?:meta|link|base|title|template|noscript|script|style)\b[^<>]*>|<[!?][^<>]*>)*+(?:</head\s*>)?", re.S | re.I)
#: Elements that end a line. Fixed values.
_BLOCK = re.compile(r"<\s*/?\s*(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|main|aside|blockquote|pre|hr|title|body|html|form|dl|dt|dd|figure|figcaption)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>?")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_HTML = re.compile(r"<html\b([^<>]*)>", re.I)
_LANG = re.compile(r"(?<![\w:-])lang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?(?<![\w-])href\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)'|([^\s<>\"']+))", re.I)
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files label digests."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(parts))}>"


def _shown(page: str) -> str:
    """The page without comments and hidden elements."""
    page = _RAW.sub(" ", page)
    for closing, element in _CLOSED.values():
        # up to the last end tag, each start tag has one
        if found := [m.end() for m in closing.finditer(page)]:
            page = element.sub(" ", page[: found[-1]]) + page[found[-1] :]
    return _HEAD.sub(" ", page)


def text_of(page: str) -> str:
    """Visible text: a line for each block of the page that has any, blanks joined, entities resolved."""
    bare = _TAG.sub("", _BLOCK.sub("\n", _shown(page)))
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape(bare).split("\n"))
    return "\n".join(line for line in lines if line)


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def response(url: str, page: str, seed: str = "", date: str = FETCHED) -> dict:
    """The response record of a page fetched without error; seed tells apart fetches of one address."""
    body = page.encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    headers = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block)}
    return {"record_id": named(url, date, seed), "rec_type": "response", "target_uri": url, "warc_date": date, "headers": headers, "block": block}


def http_parts(block: bytes) -> tuple[bytes, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; what has no empty line is all head."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    first, *lines = head.replace(b"\r\n", b"\n").split(b"\n")
    pairs = [line.decode("latin-1").partition(":") for line in lines]
    return first, [(k.strip(), v.strip()) for k, colon, v in pairs if colon], body


def inflated(body: bytes) -> bytes:
    """What can be decoded of gzip members that follow one another; the rest is lost."""
    out, at, view = [], 0, memoryview(body)
    while body[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while at < len(body) and not member.eof:
                out.append(member.decompress(view[at : at + _PIECE]))
                at += len(view[at : at + _PIECE]) - len(member.unused_data)
        except zlib.error:
            break
    return b"".join(out)


def payload_text(headers: list[tuple[str, str]], body: bytes) -> str:
    """The payload decoded from its content coding and character set; what can't be decoded stands as U+FFFD."""
    fields = {k.lower(): v for k, v in headers}
    if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
        body = inflated(body)
    found = re.search(r"charset\s*=\s*\"?([\w-]+)", fields.get("content-type", ""), re.I)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(source: dict) -> list[dict]:
    """The metadata and conversion records of a response. Empty payloads convert to empty text."""
    status, http, body = http_parts(source["block"] or b"")
    page = payload_text(http, body)
    own = source["headers"] or {}
    kept = {
        "WARC-Refers-To": source["record_id"], "WARC-Refers-To-Target-URI": source["target_uri"], "WARC-Refers-To-Date": source["warc_date"],
        "WARC-Source-Payload-Digest": own.get("WARC-Payload-Digest") or digest(body), "WARC-Source-Block-Digest": own.get("WARC-Block-Digest") or digest(source["block"] or b""),
    }
    fields = [("http-status", status.decode("latin-1"))] + [(f"http-{k.lower()}", v) for k, v in http] + [(f"source-{k.lower()}", v) for k, v in sorted(own.items())]
    if found := _TITLE.search(page):
        fields.append(("title", one_line(found[1])))
    if (found := _HTML.search(page)) and (found := _LANG.search(found[1])):
        fields.append(("language", one_line(found[1])))
    fields += [("outlink", one_line(next(g for g in m.groups() if g is not None))) for m in _LINK.finditer(page)]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()), "conversion": ("text/plain; charset=utf-8", text_of(page).encode())}
    return [
        {
            "record_id": named(source["record_id"] or "", kind), "rec_type": kind, "target_uri": source["target_uri"], "warc_date": source["warc_date"],
            "headers": {k: v for k, v in kept.items() if v is not None} | {"Content-Type": mime, "WARC-Block-Digest": digest(block)}, "block": block,
        }
        for kind, (mime, block) in blocks.items()
    ]


def serialised(record: dict, compress: bool = False) -> bytes:
    """The record as it stands in a WARC/1.1 file."""
    head = [("WARC-Type", record["rec_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["warc_date"]), ("WARC-Target-URI", record["target_uri"])]
    head += sorted(record["headers"].items()) + [("Content-Length", str(len(record["block"])))]
    data = b"WARC/1.1\r\n" + b"".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() + _CRLF for k, v in head if v is not None) + _CRLF + record["block"] + _CRLF * 2
    return gzip.compress(data, mtime=0) if compress else data


def parsed(data: bytes) -> list[dict]:
    """The records of WARC text, plain or in gzip members."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        pairs = [line.partition(": ") for line in data[at:end].decode().split("\r\n")[1:]]
        fields = {k: v for k, _, v in pairs}
        n = int(fields.pop("Content-Length"))
        block = data[end + 4 : end + 4 + n]
        out.append({"record_id": fields.pop("WARC-Record-ID", None), "rec_type": fields.pop("WARC-Type", None), "target_uri": fields.pop("WARC-Target-URI", None), "warc_date": fields.pop("WARC-Date", None), "headers": fields, "block": block})
        at = end + 4 + n + 4
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = FETCHED) -> DataFrame:
    """A response record for every page: the id column and SCHEMA. Null addresses and pages count as empty; rows
    repeated with one id and address give the same record again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [response(u, h, str(i), date) for i, u, h in zip(pdf["id"], pdf.url, pdf.html)]
            yield pd.DataFrame(made).assign(id=pdf["id"].to_numpy()) if made else pd.DataFrame(columns=["id"])

    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(run, "id string, " + SCHEMA)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records (SCHEMA) of every response among the records, and its columns beside
    them as source_id. Records of other types give nothing; a null block counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [d | {"source_id": r["record_id"]} for r in pdf.to_dict("records") for d in derive(r)]
            yield pd.DataFrame(made, columns=["source_id", *[c.split()[0] for c in SCHEMA.split(", ")]])

    rows = records.select(*[c.split()[0] for c in SCHEMA.split(", ")]).filter("rec_type = 'response'")
    return rows.mapInPandas(run, "source_id string, " + SCHEMA)


def files(records: DataFrame, compress: bool = True) -> DataFrame:
    """(record_id, bytes): each record as a piece of a WARC file; pieces may follow one another in any order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"record_id": pdf.record_id, "bytes": [serialised(r, compress) for r in pdf.to_dict("records")]})

    return records.select(*[c.split()[0] for c in SCHEMA.split(", ")]).mapInPandas(run, "record_id string, bytes binary")


def page_derivatives(pages: DataFrame) -> DataFrame:
    """The query: pages to responses to derivatives in one pass, each derivative with digests of what it is.

    (page_id, rec_type, record_id, refers_to, refers_to_uri, refers_to_date, content_type, block_bytes, block_digest,
    source_payload_digest, source_block_digest, record_crc32)
    """
    names = ["page_id", "rec_type", "record_id", "refers_to", "refers_to_uri", "refers_to_date", "content_type", "block_bytes", "block_digest", "source_payload_digest", "source_block_digest", "record_crc32"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, url, page in zip(pdf.page_id, pdf.url, pdf.html):
                for d in derive(response(url, page, "" if pd.isna(key) else str(int(key)))):
                    h = d["headers"]
                    out.append((key, d["rec_type"], d["record_id"], h["WARC-Refers-To"], h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"], h["Content-Type"], len(d["block"]), h["WARC-Block-Digest"], h["WARC-Source-Payload-Digest"], h["WARC-Source-Block-Digest"], zlib.crc32(serialised(d))))
            yield pd.DataFrame(out, columns=names)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, ", ".join(f"{n} {'long' if n in ('page_id', 'block_bytes', 'record_crc32') else 'string'}" for n in names))
