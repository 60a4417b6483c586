"""WARC derivatives: metadata and plain-text conversion records (operator 2).

From response records (id, date, target URI, HTTP header block, payload) two records
are derived for each: a metadata record with what was learned about the response, and a conversion
record with its plain text. Both refer to the response (WARC-Refers-To, with its URI and date), carry the
digest of the source payload and of their own block, and have ids made of what they
are derived from, so that a repeated task writes the same ids. Records are DataFrame rows;
``serialised`` makes their WARC/1.1 bytes, with the response's HTTP headers as a JSON string in the field
WARC-Source-HTTP-Headers, and ``parse`` reads files of such bytes back: their responses alone, transfer and content codings undone,
texts decoded by the charset that the response names. A payload digest that the response has is
carried; without one, the bytes are hashed as they were, before any decoding.

The derivation is DataFrame functions alone. Its plain text is the HTML without comments,
scripts, styles and tags, with block-level ends as line ends, the common character references
resolved, and white space collapsed in each line.

Defined results: a null payload is an empty one; a response without an id is given one from its
content; a null URI or date stays out of the header block; repeated responses give repeated records with equal ids, for the
reader to drop; an empty table gives no records. Payloads of any length are read whole. A file that is damaged gives the records before
the damage, and ``damaged`` lists it; a payload in an unknown or broken coding is null, with the reason in ``problem``; an unknown charset is read as UTF-8,
and bytes that don't fit a charset become replacement characters.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.session import arrow, tune

DATE = "2024-01-01T00:00:00Z"
# Elements whose end is a line end, and character references.
BLOCKS = "p|div|h[1-6]|li|ul|ol|br|tr|table|article|section|header|footer|nav|title|head|blockquote|pre"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for a, b in REFERENCES:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r" ?\n[\n ]*", "\n"), r"^[\n ]+|[\n ]+$", "")


def urn(*parts: Column) -> Column:
    """A name-based record id: the first half of a digest of its parts, in the form of a UUID."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)])


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a page table."""
    url, html, i = F.col(url_col).cast("string"), F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.col(id_col).cast("string")
    return pages.select(
        F.col(id_col).alias("page_id"),
        urn(F.lit("response"), F.coalesce(i, F.lit("")), F.coalesce(url, F.lit("")), html).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_headers"),
        html.alias("payload"),
    )


def derive(records: DataFrame, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows for each response: record_type, record_id, refers_to, target_uri, date, source_headers,
    source_digest, content_type, block, block_digest, content_length."""
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    # What parse found out from the bytes, which a string may not show.
    own, length = (F.col(c) if c in records.columns else F.lit(None) for c in ("payload_digest", "payload_length"))
    r = records.select(*carry, F.coalesce("record_id", urn(F.lit("response"), F.coalesce("target_uri", F.lit("")), F.coalesce(own, payload))).alias("refers_to"), "target_uri", "date", F.coalesce("http_headers", F.lit("")).alias("source_headers"), F.coalesce(own, digest(payload)).alias("source_digest"), payload.alias("payload"), F.coalesce(length, F.octet_length(payload)).alias("length"))
    r = r.withColumn("text", plain_text(F.col("payload")))
    fields = F.concat(
        F.lit("source-content-length: "), F.col("length").cast("string"),
        F.lit("\r\nsource-payload-digest: "), F.col("source_digest"),
        F.lit("\r\ntext-length: "), F.length("text").cast("string"),
        F.lit("\r\nlinks: "), F.regexp_count("payload", F.lit(r"(?i)<a\b[^>]*\bhref\s*=")).cast("string"),
        F.lit("\r\ntitle: "), F.trim(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>([^<]*)</title", 1), r"\s+", " ")),
        F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = r.select(*carry, "refers_to", "target_uri", "date", "source_headers", "source_digest", F.inline(kinds))
    return out.select(*carry, "record_type", urn(F.col("record_type"), F.col("refers_to"), F.col("source_digest")).alias("record_id"), "refers_to", "target_uri", "date", "source_headers", "source_digest", "content_type", "block", digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("bigint").alias("content_length"))


def header(record: dict[str, str | None]) -> str:
    pairs = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", f"<{record['record_id']}>"), ("WARC-Refers-To", f"<{record['refers_to']}>"),
        ("WARC-Refers-To-Target-URI", record["target_uri"]), ("WARC-Refers-To-Date", record["date"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["date"]),
        ("WARC-Source-HTTP-Headers", json.dumps(record["source_headers"]) if record["source_headers"] else None),
        ("WARC-Source-Payload-Digest", record["source_digest"]), ("WARC-Block-Digest", record["block_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(record["content_length"])),
    ]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None) + "\r\n"


def serialised(records: DataFrame) -> DataFrame:
    """One gzip member for each derived record; members in a row are a WARC file."""
    tune(records.sparkSession)
    names = ["record_type", "record_id", "refers_to", "target_uri", "date", "source_headers", "source_digest", "block_digest", "content_type", "content_length", "block"]

    def f(s: pa.Array) -> pa.Array:
        return pa.array([gzip.compress(header(x).encode() + x["block"].encode() + b"\r\n\r\n", mtime=0) for x in s.to_pylist()], pa.binary())

    return records.withColumn("member", arrow(f, T.BinaryType())(F.struct(*names)))


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    start = stream.peek(2)[:2] if hasattr(stream, "peek") else b""
    source = gzip.GzipFile(fileobj=stream) if start == b"\x1f\x8b" else stream
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := source.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head.get("content-length", 0))
        block = source.read(size)
        if size < 0 or len(block) < size:
            raise ValueError("a record is cut off")
        yield head, block


def members(stream) -> list[tuple[dict[str, str], bytes]]:
    """Records of an open WARC file, plain or of gzip members: headers (lower-case names) and blocks."""
    return list(_records(stream))


NAMES = ("record_type", "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest", "problem")
PARSED = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in NAMES] + [T.StructField("payload_length", T.LongType())]))


def _header_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _joined_chunks(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk is cut off")
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _plain(coding: str, body: bytes) -> bytes:
    if coding in ("", "identity"):
        return body
    if coding not in ("gzip", "x-gzip", "deflate"):
        raise ValueError(f"unknown coding {coding}")
    ways = (47, -15) if coding == "deflate" else (47,)  # a header of gzip or zlib, or none
    for k, bits in enumerate(ways):
        try:
            return zlib.decompress(body, bits)
        except zlib.error:
            if k + 1 == len(ways):
                raise
    return body


def body_text(http: str, body: bytes) -> str:
    """The text of a response's body. Raises where a coding can't be undone."""
    fields: dict[str, str] = {}
    for line in http.split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    # Archives often keep the header of a coding that they have undone.
    if fields.get("transfer-encoding", "").lower().endswith("chunked") and re.match(rb"[0-9A-Fa-f]+[ \t]*(;[^\r]*)?\r\n", body):
        body = _joined_chunks(body)
    for coding in reversed(fields.get("content-encoding", "").lower().split(",")):
        body = _plain(coding.strip(), body) if body else body
    named = re.search(r"charset\s*=\s*[\"']?([^\s\"';]+)", fields.get("content-type", ""), re.I)
    said = named.group(1) if named else None
    if not said and (m := re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", body[:1024], re.I)):
        said = m.group(1).decode("ascii")
    try:
        return body.decode(said or "utf-8", "replace")
    except (LookupError, UnicodeError):  # no charset, or a codec of something else
        return body.decode("utf-8", "replace")


def _response(head: dict[str, str], block: bytes) -> dict:
    raw, _, body = block.partition(b"\r\n\r\n")
    http, text, problem = _header_text(raw), None, None
    try:
        text = body_text(http, body)
    except (ValueError, zlib.error) as e:
        problem = f"{type(e).__name__}: {e}"
    return {"record_type": "response", "record_id": head.get("warc-record-id", "").strip("<>") or None, "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "http_headers": http, "payload": text, "payload_digest": head.get("warc-payload-digest") or f"sha256:{hashlib.sha256(body).hexdigest()}", "problem": problem, "payload_length": len(body)}


def _responses(raw: bytes) -> list[dict]:
    """The responses of a file; where it is damaged, a row without a record type tells why."""
    rows = []
    try:
        for head, block in _records(io.BufferedReader(io.BytesIO(raw))):
            if head.get("warc-type") == "response":
                rows.append(_response(head, block))
    except (ValueError, EOFError, OSError, zlib.error) as e:
        rows.append({"problem": f"{type(e).__name__}: {e}"})
    return rows


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    tune(spark)
    kind = pa.list_(pa.struct([(n, pa.string()) for n in NAMES] + [("payload_length", pa.int64())]))

    def f(content: pa.Array) -> pa.Array:
        return pa.array([_responses(x.as_py()) for x in content], kind)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select("path", F.explode(arrow(f, PARSED)("content")).alias("r"))


def parse(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, each file in one task; Spark refuses, rather than cuts, a file
    beyond spark.sql.sources.binaryFile.maxLength."""
    return _parsed(spark, path).where("r.record_type is not null").select("r.*")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of the files that are damaged, and of the payloads that couldn't be decoded."""
    return _parsed(spark, path).where("r.problem is not null").select("path", F.col("r.record_id").alias("record_id"), F.col("r.problem").alias("problem"))
