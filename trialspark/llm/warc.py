"""Derivatives of archived web responses: linked metadata records and plain-text conversion records.

The registry has no web captures, so this operator is general: it works on any table of response records. Each response is
turned into its two derivatives inside its own task, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.html_tokens import BLOCK, VOID, attributes, squeeze, tokens

VERSION, BREAK = "WARC/1.1", "\r\n"
SCHEMA = ("record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
          "content_length bigint, block_digest string, source_digest string, header string, block string")

# Attributes of elements that point to another resource.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "form": "action"}


def digest(data: bytes) -> str:
    """The SHA-1 of a block as WARC headers write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str | None, kind: str) -> str:
    """A record id that depends only on the source record and the kind of derivative."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source or ''}#{kind}')}>"


def plain_text(html: str) -> tuple[str, str | None, list[dict]]:
    """All readable text of a page, one block a line; its title; its links as (path, url), in page order."""
    blocks, now, title, links = [], [], None, []
    for what, value, rest in tokens(html):
        if what == "text":
            now.append(value)
        elif what == "raw":
            if value == "title" and title is None:
                title = squeeze(unescape(rest))
        else:
            if what == "open" and value in LINKS and (url := attributes(rest).get(LINKS[value])):
                links.append({"path": f"{value.upper()}@/{LINKS[value]}", "url": url})
            if value in BLOCK:
                blocks.append(squeeze("".join(now)))
                now = []
            elif value == "br" or value in VOID:
                now.append(" ")
    blocks.append(squeeze("".join(now)))
    return "\n".join(b for b in blocks if b), title, links


def _headers(text: str | None) -> tuple[str | None, dict[str, str]]:
    """Status line and header fields of an HTTP head; repeated fields are joined by a comma."""
    lines = [x for x in (text or "").replace("\r\n", "\n").split("\n") if x.strip()]
    fields: dict[str, str] = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if colon:
            name, value = name.strip(), value.strip()
            fields[name] = f"{fields[name]}, {value}" if name in fields else value
    return (lines[0].strip() if lines else None), fields


def _record(kind, source, uri, date, content_type, block, payload_digest):
    data = block.encode("utf-8", "surrogatepass")
    own, seal = derived_id(source, kind), digest(data)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date),
              ("WARC-Block-Digest", seal), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
    header = BREAK.join([VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in fields if v is not None)])
    return (kind, own, source, uri, date, content_type, len(data), seal, payload_digest, header, block)


def derivatives(record_id: str | None, uri: str | None, date: str | None, http: str | None, payload: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of ``SCHEMA``."""
    body = payload or ""
    source_digest = digest(body.encode("utf-8", "surrogatepass"))
    text, title, links = plain_text(body)
    status, fields = _headers(http)
    envelope = {
        "Source": {"WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": source_digest},
        "HTTP": {"Status": status, "Headers": fields, "Entity-Length": len(body.encode("utf-8", "surrogatepass"))},
        "HTML": {"Title": title, "Links": links},
        "Conversion": {"WARC-Record-ID": derived_id(record_id, "conversion"), "Digest": digest(text.encode("utf-8", "surrogatepass"))},
    }
    block = json.dumps(envelope, ensure_ascii=False, sort_keys=True)
    return [_record("metadata", record_id, uri, date, "application/json", block, source_digest),
            _record("conversion", record_id, uri, date, "text/plain", text, source_digest)]


def derive_records(responses: DataFrame, *, key: str, record_id: str = "record_id", uri: str = "target_uri", date: str = "date",
                   http: str = "http_header", payload: str = "payload") -> DataFrame:
    """Two records for every response: ``key`` and the columns of ``SCHEMA``.

    The metadata record is JSON with the source's id, address, date, payload digest, HTTP status and header fields, title
    and links, and the id and digest of the conversion; the conversion record is the page's readable text, one block a
    line, without markup, scripts and styles. Both refer to the response's id and carry its address and date; their own
    ids follow from it, so a repeated run gives the same records. Digests are base-32 SHA-1 of UTF-8 bytes.

    A null payload counts as empty; null ids, addresses and dates leave their header out; repeated rows give repeated
    records; extra columns are ignored; an empty table gives an empty result.
    """
    own = responses.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate((key, record_id, uri, date, http, payload))))

    def derive(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for a in range(0, batch.num_rows, 256):
                rows = [r for x in zip(*(c[a:a + 256] for c in columns), strict=True) for r in derivatives(*x)]
                keys = batch.column(0).take(pa.array([i for i in range(a, min(a + 256, batch.num_rows)) for _ in range(2)]))
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array([r[i] for r in rows], pa.int64() if f.endswith("bigint") else pa.string()) for i, f in enumerate(SCHEMA.split(", ")))],
                    ["c0", *(f.split()[0] for f in SCHEMA.split(", "))])

    return own.mapInArrow(derive, f"c0 {own.schema['c0'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("c0", key)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one for each partition; every record ends with two line breaks."""
    record = F.concat("header", F.lit(BREAK * 2), "block").alias("value")
    records.select(record).write.option("lineSep", BREAK * 2).option("compression", compression).text(path)


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of one WARC file; blocks are cut by their stated length."""
    out, at, gap = [], 0, (BREAK * 2).encode()
    while (end := data.find(gap, at)) >= 0:
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split(BREAK)[1:])
        start = end + len(gap)
        stop = start + int(fields["Content-Length"])
        out.append((fields, data[start:stop]))
        at = stop + len(gap)
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(fields, block) of every record of the WARC files under ``path``; one task reads a file, as gzip asks for."""
    import gzip

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_py()
                for fields, block in parse_warc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    yield pa.RecordBatch.from_arrays([pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block.decode()])], ["fields", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "fields map<string,string>, block string")
