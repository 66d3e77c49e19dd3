"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives two records that refer to it (WARC-Refers-To, its target URI and its date): a *metadata* record
(application/warc-fields) with the source's status, headers, digests and links, and a *conversion* record (text/plain) with all
the text of the page. Record ids are derived from the source's id, so a rerun gives the same records. Digests are
``sha1:`` and base 32, as the WARC format writes them.

``read_warc`` reads WARC files (plain or with gzip members), ``responses_of_pages`` makes responses of a table of pages,
``serialize`` gives a record's bytes.

Defined cases: null or empty html makes a response with an empty payload and an empty conversion; a null url gives a null target;
rows with equal ids and content give equal records; a header without a colon is kept under an empty name; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import slices
from sparkloom.llm.html_blocks import read

BATCH_BYTES = 4 << 20
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
RESPONSE = "record_id string, target_uri string, warc_date string, warc_headers string, block binary"
DERIVED = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, source_block_digest string, source_headers string, block string"
)
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivative")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def responses_of_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", date: str = DATE) -> DataFrame:
    """(id, RESPONSE columns): a page as the response record that a crawler would have written."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.sha1(F.concat_ws("\u0001", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))))
    parts = [F.substring(name, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    uri = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))
    return pages.select(F.col(id_col), uri.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), F.lit("{}").alias("warc_headers"), F.concat(head.cast("binary"), body).alias("block"))


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").splitlines()
    pairs = [x.partition(":") for x in lines]
    return status, [(a.strip(), c.strip()) if b else ("", a.strip()) for a, b, c in pairs], payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    """Payload as text: by the charset of the content type, of a meta element, or UTF-8."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = re.search(r"charset=[\"']?([\w-]+)", kind, re.I) or re.search(r"<meta[^>]{0,200}charset=[\"']?([\w-]+)", payload[:2048].decode("latin-1"), re.I)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, UnicodeError):  # unknown, or a codec that is none for text
        return payload.decode("utf-8", "replace")


def derive(record_id: str, target: str | None, date: str, warc_headers: str | None, block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of DERIVED."""
    status, headers, payload = split_http(block)
    page = read(decoded(headers, payload))
    given = {k.lower(): v for k, v in json.loads(warc_headers or "{}").items()}
    source_payload = given.get("warc-payload-digest") or digest(payload)
    source_block = given.get("warc-block-digest") or digest(block)
    fields = [("http-status", status), *((f"http-header-{k.lower()}" if k else "http-header", v) for k, v in headers)]
    fields += [("payload-digest", source_payload), ("block-digest", source_block), *(("outlink", x) for x in page.links)]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)
    text = "\n".join(b.text for b in page.blocks)
    kept = json.dumps([list(h) for h in headers], ensure_ascii=False, separators=(",", ":"))
    rows = []
    for kind, content, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain", text)):
        data = body.encode("utf-8", "replace")
        rows.append((kind, record_uri(f"{kind} {record_id} {source_block}"), record_id, target, date, content, len(data), digest(data), source_payload, source_block, kept, body))
    return rows


def derivatives(responses: DataFrame, id_col: str | None = "page_id") -> DataFrame:
    """(id, DERIVED columns): two records for each response record; other kinds of records, where warc_type tells, have none.

    Without ``id_col`` (or with one that DERIVED has, as rows of ``read_warc`` do) refers_to alone names the source.
    """
    names = [x.split()[0] for x in DERIVED.split(", ")]
    own = [id_col] if id_col and id_col not in names else []
    if "warc_type" in responses.columns:
        responses = responses.where(F.lower("warc_type") == "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in DERIVED.split(", ")]
        for b in slices(batches, "block", BATCH_BYTES):
            rows, at = [], []
            for i, source in enumerate(zip(*(b.column(k).to_pylist() for k in range(5)))):
                rows += derive(*source[:4], source[4] or b"")
                at += [i, i]
            ids = [b.column(5).take(pa.array(at, pa.int64()))] if own else []
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=[*own, *names])

    kind = [f"{c} {responses.schema[c].dataType.simpleString()}, " for c in own]
    return responses.select("record_id", "target_uri", "warc_date", "warc_headers", "block", *own).mapInArrow(run, "".join(kind) + DERIVED)


def serialize(record_type: str, record_id: str, refers_to: str, target: str | None, date: str, content_type: str, block: bytes) -> bytes:
    """A derived record as a WARC record."""
    lines = [VERSION, f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Refers-To: {refers_to}", f"WARC-Refers-To-Date: {date}"]
    if target is not None:
        lines += [f"WARC-Target-URI: {target}", f"WARC-Refers-To-Target-URI: {target}"]
    lines += [f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def unzipped(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, member by member where it holds gzip members; nothing is copied twice."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        parts = []
        while at < len(view) and not d.eof:
            part = view[at : at + (1 << 16)]
            parts.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, plain or in gzip members, one at a time; header names in lower case."""
    for member in unzipped(data):
        at = 0
        while (at := member.find(b"WARC/", at)) >= 0:
            end = member.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = member[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = headers.get("content-length", "0")
            size = int(length) if length.isdecimal() else 0
            yield headers, member[end + 4 : end + 4 + size]
            at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(warc_type, RESPONSE columns) of all records of the files under ``path``; a file is one task's, its records go on one by one."""
    names = ["warc_type", *(x.split()[0] for x in RESPONSE.split(", "))]
    kinds = [pa.string()] * 5 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, held = [], 0
                for h, block in parse(b.column(0)[i].as_py()):
                    rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), json.dumps(h), block))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"warc_type string, {RESPONSE}")
