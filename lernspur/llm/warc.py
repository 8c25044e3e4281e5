"""WARC derivative builder: metadata and plain-text conversion records of response records.

Every response gives two records that refer to it. The ``metadata`` record
(application/warc-fields) lists title, language, sizes, outgoing links and the
source's headers and digests; the ``conversion`` record (text/plain) holds the
text of the page. Both carry WARC-Refers-To with the response's record id, its
target URI and date, and their own block digest. What the source says of itself
is carried unchanged: record id, date, headers, block and payload digest; only
what it lacks is made here (an id from its content, the digest of its payload).
Record ids are name-based: building twice gives the same ids.

``read_responses`` reads response records from WARC files (plain or gzip, one
member a record or one for all); ``record_bytes`` writes records in WARC/1.1.

Defined results: a null or empty payload gives an empty conversion block with
the digest of nothing; a response without target URI or date leaves the headers
that refer to it out, and its derivatives are dated ``undated``; line ends in
header values are percent-encoded; repeated responses give repeated records; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lernspur.llm.html_blocks import leaf_blocks, markup

LANG = re.compile(r"(?:^|\s)lang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
RESPONSE = ("record_id", "target_uri", "date", "headers", "block_digest", "payload_digest", "payload")
COLUMNS = ("record_id", "record_type", "refers_to", "target_uri", "source_date", "date", "content_type", "content_length", "block_digest", "source_block_digest", "source_payload_digest", "source_headers", "block")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages, which knows their address and text only. The text is written in UTF-8, and the headers say so, whatever the page says of itself."""
    nothing = F.lit(None).cast("string")
    headers = F.to_json(F.struct(F.lit("text/html; charset=utf-8").alias("Content-Type"), F.col("url").alias("WARC-Target-URI")))
    return pages.select("page_id", nothing.alias("record_id"), F.col("url").alias("target_uri"), nothing.alias("date"), headers.alias("headers"), nothing.alias("block_digest"), nothing.alias("payload_digest"), F.encode("html", "utf-8").alias("payload"))


def decoded(payload: bytes, headers: str | None) -> str:
    """A payload as text: in the charset of its headers, or of its first kilobyte, or UTF-8, also where the name is no text encoding; bytes that are none are replaced."""
    found = CHARSET.search((headers or "").encode()) or CHARSET.search(payload[:1024])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


class Description:
    """(name, value) of title, language and outgoing links of a page, in page order, from its marks as they come."""

    def __init__(self, page: str) -> None:
        self.page, self.fields, self.titled, self.spoken = page, [], False, False

    def see(self, start: int, stop: int, tag: str, end: bool, rest: str) -> None:
        if end:
            return
        if tag == "title" and not self.titled:
            inner = self.page[start:stop]
            inner = inner[inner.find(">") + 1 :]
            cut = inner.lower().rfind("</title")
            self.fields.append(("title", " ".join(html.unescape(inner if cut < 0 else inner[:cut]).split())))
            self.titled = True
        elif tag == "html" and not self.spoken:
            found = LANG.search(rest)
            if found:
                self.fields.append(("language", found[1]))
                self.spoken = True
        elif tag == "a":
            found = HREF.search(rest)
            if found:
                self.fields.append(("outlink", " ".join(html.unescape(found[1] or found[2] or found[3] or "").split())))


def described(page: str) -> list[tuple[str, str]]:
    description = Description(page)
    for mark in markup(page):
        description.see(*mark)
    return description.fields


def derive(source_id: str | None, uri: str | None, date: str | None, headers: str | None, block_digest: str | None, payload_digest: str | None, payload: bytes | None, undated: str) -> list[tuple]:
    """The metadata and the conversion record of one response, as tuples of COLUMNS."""
    raw = payload or b""
    payload_digest = payload_digest or digest(raw)
    source_id = source_id or record_id("response", uri, digest(raw))
    page = decoded(raw, headers)
    description = Description(page)
    text = "\n".join(t for t, _, _ in leaf_blocks(page, description.see))
    fields = [*description.fields, ("source-length", str(len(raw))), ("text-characters", str(len(text)))]
    fields += [("source-block-digest", block_digest)] if block_digest else []
    fields += [("source-payload-digest", payload_digest)]
    fields += [("source-header", f"{k}: {v}") for k, v in json.loads(headers or "{}").items()]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", lines), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode("utf-8", "replace")
        out.append((record_id(kind, source_id), kind, source_id, uri, date, date or undated, content, len(data), digest(data), block_digest, payload_digest, headers, data.decode()))
    return out


def derivatives(responses: DataFrame, key: str = "page_id", undated: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Two derived records for every response, with the column ``key`` of the response."""
    wanted = responses.select(key, *RESPONSE)
    types = ["long" if c == "content_length" else "string" for c in COLUMNS]
    schema = wanted.select(key).schema
    for name, kind in zip(COLUMNS, types, strict=True):
        schema = schema.add(name, kind)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [derive(*r, undated) for r in zip(*(batch.column(c).to_pylist() for c in RESPONSE), strict=True)]
                flat = list(zip(*(r for pair in rows for r in pair), strict=True))
                keys = batch.column(key).take(pa.array([i for i in range(batch.num_rows) for _ in range(2)]))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(flat, types, strict=True))], names=schema.fieldNames())

    return wanted.mapInArrow(build, schema)


def record_bytes() -> Column:
    """The whole record of a row of COLUMNS in WARC/1.1: header lines, blank line, block and two line ends."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\r", "%0D"), "\n", "%0A")
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), safe(c), F.lit("\r\n"))).otherwise(F.lit(""))
    names = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Refers-To-Target-URI": "target_uri", "WARC-Refers-To-Date": "source_date", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    return F.encode(F.concat(F.lit("WARC/1.1\r\n"), *[line(n, c) for n, c in names.items()], F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")), "utf-8")


#: Bytes unpacked at a time.
CHUNK = 1 << 20


def unpacked(data: bytes) -> Iterator[bytes]:
    """A file's bytes in chunks; gzip members are unpacked one after another, up to the first damaged one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member, rest = zlib.decompressobj(wbits=31), memoryview(data)[at:]
        while not member.eof:
            given = rest[:CHUNK] if not member.unconsumed_tail else member.unconsumed_tail
            rest = rest[CHUNK:] if not member.unconsumed_tail else rest
            try:
                chunk = member.decompress(given, CHUNK)
            except zlib.error:
                return
            if chunk:
                yield chunk
            elif not given:
                return
        at = len(data) - len(rest) - len(member.unused_data)


def parse_records(chunks: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a WARC file, of which no more than a record and a chunk is held.

    A cut-off last record is left out; one whose length is no number is skipped, up to the next that starts a line.
    """
    held, left = bytearray(), iter([chunks]) if isinstance(chunks, bytes) else chunks

    def more() -> bool:
        chunk = next(left, None)
        held.extend(chunk or b"")
        return chunk is not None

    while True:
        while (start := held.find(b"WARC/")) < 0 or (stop := held.find(b"\r\n\r\n", start)) < 0:
            if not more():
                return
        lines = held[start:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = next((v for k, v in headers.items() if k.lower() == "content-length"), "0")
        if not (size.isascii() and size.isdigit()):
            while (after := held.find(b"\nWARC/", stop)) < 0:
                if not more():
                    return
            del held[: after + 1]
            continue
        end = stop + 4 + int(size)
        while len(held) < end:
            if not more():
                return
        yield headers, bytes(held[stop + 4 : end])
        del held[:end]


def plain_payload(payload: bytes, http: dict[str, str]) -> bytes:
    """The payload without the transfer and content encodings that its HTTP headers name (chunked, gzip, deflate), as far as it can be read; others stay."""
    said = {k.lower(): v.lower() for k, v in http.items()}
    if "chunked" in said.get("transfer-encoding", ""):
        out, at = [], 0
        while (line := payload.find(b"\r\n", at)) >= 0:
            size = payload[at:line].split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
                break
            if not (n := int(size, 16)):
                break
            out.append(payload[line + 2 : line + 2 + n])
            at = line + 2 + n + 2
        payload = b"".join(out) if out else payload
    coding = said.get("content-encoding", "")
    if "gzip" in coding or "deflate" in coding:
        unpack = zlib.decompressobj(wbits=47 if "gzip" in coding or payload[:1] == b"\x78" else -15)
        try:
            return unpack.decompress(payload)
        except zlib.error:
            return payload
    return payload


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files: file, RESPONSE columns; ``headers`` holds the HTTP and WARC headers as JSON.

    A file is read by one task, which holds its bytes as they are stored and unpacks a record at a time; payloads come
    without their transfer and content encodings. What cannot be read is left out: records whose length is no number,
    and what follows damage in a packed file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for own, block in parse_records(unpacked(content.as_py())):
                    said = {k.lower(): v for k, v in own.items()}
                    if said.get("warc-type") != "response":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    http = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                    rows.append((file, said.get("warc-record-id"), said.get("warc-target-uri"), said.get("warc-date"), json.dumps({**http, **own}), said.get("warc-block-digest"), said.get("warc-payload-digest"), plain_payload(payload, http)))
                    held += len(payload)
                    if len(rows) == 256 or held > 32 * CHUNK:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=["file", *RESPONSE])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, " + ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in RESPONSE))
