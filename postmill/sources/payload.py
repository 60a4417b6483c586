"""Data that pages carry in streamed script chunks, and JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of a streamed chunk and of a JSON-LD script. The possessive loops keep long chunks off the regex stack.
CHUNK = r'self\.__next_f\.push\(\[1,"([^"\\]*+(?:\\.[^"\\]*+)*+)"\]\)'
LD_SCRIPT = r'(?s)<script type="application/ld\+json">(.*?)</script>'
POSTING = r'"@type"\s*:\s*"JobPosting"'


def chunks(html: Column) -> Column:
    """Decoded chunks in order; one that isn't a JSON string is null."""
    raw = F.regexp_extract_all(html, F.lit(CHUNK), F.lit(1))
    return F.transform(raw, lambda c: F.from_json(F.concat(F.lit('{"v":"'), c, F.lit('"}')), "v string")["v"])


def buffer(html: Column) -> Column:
    """All decodable chunks joined without a separator."""
    return F.array_join(F.filter(chunks(html), lambda x: x.isNotNull()), "")


def text_row(buf: Column, row: Column) -> Column:
    """The text row that a reference names: ``<row>:T<hex length>,`` and then so many UTF-8 bytes. Bytes that are no
    text become U+FFFD; null where there is no such row."""
    pattern = F.concat(F.lit(r"(?s)(?<![0-9A-Za-z])\Q"), row, F.lit(r"\E:T([0-9a-fA-F]+),"))
    head = F.regexp_substr(buf, pattern)
    start = F.regexp_instr(buf, pattern)
    size = F.conv(F.regexp_extract(head, r":T([0-9a-fA-F]+),$", 1), 16, 10).try_cast("int")
    before = F.octet_length(F.left(buf, start - 1)) + F.octet_length(head)
    return F.when(head.isNotNull() & (size >= 0), F.make_valid_utf8(F.substring(F.encode(buf, "utf-8"), before + 1, size).cast("string")))


def json_type(j: Column) -> Column:
    return F.get_json_object(j, "$['@type']")


def find_posting(j: Column) -> Column:
    """The JSON text itself if it is a JobPosting, else the first one in its @graph."""
    items = F.from_json(F.get_json_object(j, "$['@graph']"), "array<string>")
    return F.when(json_type(j) == "JobPosting", j).otherwise(F.try_element_at(F.filter(items, lambda x: json_type(x) == "JobPosting"), F.lit(1)))


def job_posting(html: Column) -> Column:
    """The page's JobPosting as JSON text: from scripts first, then from chunks that mention one."""
    scripts = F.transform(F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1)), find_posting)
    streamed = F.transform(F.filter(chunks(html), lambda x: x.rlike(POSTING)), find_posting)
    first = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(first(scripts), first(streamed))
