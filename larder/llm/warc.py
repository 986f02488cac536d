"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Both derived records name the response they come from (WARC-Refers-To), carry its target, date and payload digest, and
have digests of their own; the metadata keeps every header line of the source. The text of a page, its title, language
and number of links come from one Arrow function; ids, digests and headers are Spark's expressions. write_records makes
WARC files with Spark's text writer, so its commit protocol covers lost executors; read_records streams WARC files into
rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from html.entities import html5
from typing import BinaryIO

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from larder.llm.common import bound_batches, open_path, slices

# Patterns in the dialect that Python and RE2 share, so that SQL can say the same.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>"
BLOCK = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANGUAGE = r'(?i)<html[^>]*\slang="([A-Za-z-]*)"'
LINK = r"(?i)<a\s[^>]*href="
BLANKS = "[ \t\r\f\x0b\xa0]"

DATE = "2024-01-01T00:00:00Z"
STATUS = "HTTP/1.1 200 OK"
RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload string"
_MADE = ("__larder_text", "__larder_title", "__larder_language", "__larder_links")


def _ascii(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


_HIDDEN, _TITLE, _LANGUAGE, _LINK, _BLOCK = map(_ascii, (HIDDEN, TITLE, LANGUAGE, LINK, BLOCK))
_TAGS = _ascii(f"{BLOCK}|{TAG}")
_LINES, _RUNS, _SPACES = re.compile(f"{BLANKS}*\n[ \t\r\f\x0b\xa0\n]*"), re.compile(f"{BLANKS}{{2,}}|[\t\r\f\x0b\xa0]"), re.compile("[ \t\n\r\f]+")


def page_text(page: str) -> str:
    """Visible text, a line per block: comments and what is between script, style, noscript and template tags is left
    out, character references are decoded once (all of HTML5, and numeric ones), runs of blanks become one. An unclosed
    tag's text stays."""
    text = _TAGS.sub(lambda m: "\n" if m.lastindex else "", _HIDDEN.sub(" ", page))
    if "&" in text:
        text = html.unescape(text)
    return _RUNS.sub(" ", _LINES.sub("\n", text)).strip(" \n")


def page_title(page: str) -> str:
    """The text of the first title element, decoded, with single spaces; empty without one."""
    found = _TITLE.search(page)
    return _SPACES.sub(" ", html.unescape(found[1])) if found else ""


def page_language(page: str) -> str:
    found = _LANGUAGE.search(page)
    return found[1] if found else ""


def with_page_fields(records: DataFrame) -> DataFrame:
    """records with text, title, language and number of links of their payload; a null payload is an empty page."""
    bound_batches(records.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            pages = pc.fill_null(batch.column("payload"), "").to_pylist()
            made = [pa.array([f(p) for p in pages], pa.string()) for f in (page_text, page_title, page_language)]
            links = pa.array([len(_LINK.findall(p)) for p in pages], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, links], names=[*batch.schema.names, *_MADE])

    kinds = (StringType(), StringType(), StringType(), LongType())
    return records.mapInArrow(make, StructType([*records.schema, *(StructField(n, k) for n, k in zip(_MADE, kinds, strict=True))]))


def record_urn(*parts: Column) -> Column:
    """A name-based record id: the same content has the same id."""
    d = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cut = lambda a, n: F.substring(d, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html); null html is an empty payload, a null url the page's urn."""
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"{STATUS}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    uri = F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    return pages.select("page_id", record_urn(F.lit("response"), F.col("page_id"), uri, payload).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), payload.alias("payload"))


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response (columns of RESPONSE; others stay): its metadata and its conversion record.

    Adds record_type, source_id (the response), content_type, block, block_digest, payload_digest (of the response's
    payload), content_length and header. The metadata block has the status line and every header line of the source in
    its order. Repeated responses give repeated derivatives with the same ids. A null payload is empty, null headers are
    none; an empty table gives no rows.
    """
    own = [c for c in records.columns if c not in ("record_id", "payload", "http_headers")]
    payload, head = F.coalesce("payload", F.lit("")), F.coalesce("http_headers", F.lit(""))
    text, title, language, links = map(F.col, _MADE)
    rest = F.filter(F.slice(F.split(head, "\r\n"), 2, 1 << 30), lambda x: x != "")
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), language,
        F.lit("\r\nsource-status: "), F.split_part(head, F.lit("\r\n"), F.lit(1)),
        F.array_join(F.transform(rest, lambda x: F.concat(F.lit("\r\nsource-header: "), x)), ""),
        F.lit("\r\nsource-payload-length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\ntext-digest: "), F.col("__larder_digest"),
        F.lit("\r\noutlinks: "), links.cast("string"), F.lit("\r\n"),
    )
    rows = with_page_fields(records).withColumn("payload_digest", digest(payload)).withColumn("__larder_digest", digest(text)).withColumn("__larder_fields", fields)
    kind = lambda name, content, block, sha: F.struct(F.lit(name).alias("record_type"), F.lit(content).alias("content_type"), block.alias("block"), sha.alias("block_digest"))
    block = F.col("__larder_fields")
    made = F.array(kind("metadata", "application/warc-fields", block, digest(block)), kind("conversion", "text/plain; charset=utf-8", text, F.col("__larder_digest")))
    rows = rows.select(*own, F.col("record_id").alias("source_id"), "payload_digest", F.explode_outer(made).alias("__larder_x"))
    rows = rows.select(*(c for c in rows.columns if c not in ("__larder_x", "record_type", "content_type", "block", "block_digest")), "__larder_x.*")
    rows = rows.withColumn("record_id", record_urn(F.col("record_type"), F.col("source_id"), F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    line = lambda name, column: F.concat(F.lit(f"\r\n{name}: "), F.coalesce(F.col(column).cast("string"), F.lit("")))
    header = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "source_id"),
        line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"), line("WARC-Block-Digest", "block_digest"),
        line("WARC-Refers-To-Payload-Digest", "payload_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"), F.lit("\r\n\r\n"),
    )
    return rows.withColumn("header", header)


def write_records(records: DataFrame, path: str) -> None:
    """Write rows with header and block as WARC files, each record followed by two line ends."""
    records.select(F.concat("header", "block")).write.option("lineSep", "\r\n\r\n").text(path)


class Unpacked:
    """Bytes of a plain or gzip file (of any number of members), a piece at a time."""

    PIECE = 1 << 20

    def __init__(self, file: BinaryIO):
        self.file, self.held, self.gz, self.cut = file, bytearray(), None, False
        self.rest = file.read(self.PIECE)
        self.zipped = self.rest[:2] == b"\x1f\x8b"

    def more(self) -> bool:
        """Hold another piece; false at the end."""
        if self.cut:
            return False
        data, self.rest = self.rest or self.file.read(self.PIECE), b""
        if not data:
            self.cut = self.zipped and self.gz is not None  # the last member has no end
            return False
        if not self.zipped:
            self.held += data
            return True
        self.gz = self.gz or zlib.decompressobj(31)
        try:
            self.held += self.gz.decompress(data, self.PIECE)
        except zlib.error:
            self.cut = True
            return False
        if self.gz.eof:
            self.rest, self.gz = self.gz.unused_data.lstrip(b"\0"), None
        else:
            self.rest = self.gz.unconsumed_tail
        return True

    def find(self, mark: bytes) -> int:
        """Where mark is in what is held, read on until it comes; -1 if it doesn't."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return found

    def take(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parsed_records(file: BinaryIO) -> Iterator[tuple[int, list[tuple[str, str]], bytes, str | None]]:
    """Number in the file, headers, block and problem of each record.

    problem is null for a sound record; else "truncated" (the file ends inside it; what there is is given), "length"
    (no Content-Length that is a number; the block is all up to the next record or the file's end) or "encoding" (a
    header is not UTF-8; its bytes are replaced). Bytes between records are skipped.
    """
    data, n = Unpacked(file), 0
    while (at := data.find(b"WARC/1.")) >= 0:
        data.take(at)
        end = data.find(b"\r\n\r\n")
        raw = data.take(end + 4 if end >= 0 else 1 << 62)
        text = raw.decode("utf-8", "replace")
        problem = "truncated" if end < 0 else "encoding" if "�" in text else None
        headers = {k.strip().lower(): v.strip() for k, mark, v in (x.partition(":") for x in text.rstrip("\r\n").split("\r\n")[1:]) if mark}
        size, block = headers.get("content-length", ""), b""
        if end >= 0 and size.isascii() and size.isdigit():
            block = data.take(int(size))
            problem = "truncated" if len(block) < int(size) else problem
        elif end >= 0:
            stop = data.find(b"\r\n\r\nWARC/1.")
            block, problem = data.take(stop if stop >= 0 else 1 << 62), "length"
        yield n, list(headers.items()), block, problem
        n += 1


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: file, number (from 0), headers map<string,string> (lower-case names), block and problem.

    Spark lists the files and deals them out; a task streams each of its files record by record, so it holds one record
    and a piece of a file. Of repeated headers the last counts. Malformed records don't stop a file, see
    parsed_records; an empty file has no records.
    """
    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    names = ["file", "number", "headers", "block", "problem"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, at = open_path(name)
                with store.open_input_stream(at, compression=None) as file:
                    for number, headers, block, problem in parsed_records(file):
                        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((name, number, headers, block, problem), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(parse, "file string, number long, headers map<string,string>, block binary, problem string")


def page_derivatives(pages: DataFrame) -> DataFrame:
    """The derived records of crawled pages (page_id, url, html).

    Null and empty html are an empty payload, repeated rows give records each, an empty table none.
    """
    columns = ["page_id", "record_type", "record_id", "source_id", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", "header", "block"]
    return derive(responses(pages)).select(columns)


def _sql(text: str) -> str:
    return "e'" + text.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def _urn_sql(*parts: str) -> str:
    d = "md5(" + " || chr(10) || ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts) + ")"
    return f"'<urn:uuid:' || {d}[1:8] || '-' || {d}[9:12] || '-' || {d}[13:16] || '-' || {d}[17:20] || '-' || {d}[21:32] || '>'"


_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0c <&#;]{1,32};?)"
#: Code points from 128 to 159 that HTML reads as another character.
_REMAPPED = {n: ord(html.unescape(f"&#{n};")) for n in range(128, 160)}
_NAMES = sorted(html5)
_CODE = f"""CASE WHEN n IS NULL OR n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n = 13 THEN chr(13)
  WHEN n BETWEEN 128 AND 159 THEN chr({[*_REMAPPED.values()]}[n - 127])
  WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END"""
ORACLE = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, 'urn:page:' || coalesce(page_id::VARCHAR, '')) AS target_uri, coalesce(html, '') AS payload FROM pages),
hidden AS (SELECT *, regexp_replace(payload, {_sql(HIDDEN)}, ' ', 'g') AS h FROM p),
tags AS (SELECT *, array_to_string(list_transform(list_zip(string_split_regex(h, {_sql(f"{BLOCK}|{TAG}")}), list_append(regexp_extract_all(h, {_sql(f"{BLOCK}|{TAG}")}), '')),
  lambda x: x[1] || CASE WHEN regexp_full_match(x[2], {_sql(BLOCK)}) THEN chr(10) ELSE '' END), '') AS t FROM hidden),
raw AS (SELECT rid, 'text' AS k, t AS x FROM tags UNION ALL SELECT rid, 'title', regexp_extract(payload, {_sql(TITLE)}, 1) FROM p),
refs AS (SELECT rid, k, unnest(string_split_regex(x, {_sql(_REFERENCE)})) AS piece, unnest(list_append(regexp_extract_all(x, {_sql(_REFERENCE)}), '')) AS ref,
  unnest(generate_series(0, len(regexp_extract_all(x, {_sql(_REFERENCE)})))) AS i FROM raw),
entities AS (SELECT unnest([{", ".join(_sql(n) for n in _NAMES)}]) AS name, unnest([{", ".join(_sql(html5[n]) for n in _NAMES)}]) AS value),
asked AS (SELECT DISTINCT ref FROM refs WHERE ref <> ''),
named AS (SELECT ref, arg_max(value || substring(ref, length(name) + 2), length(name)) AS value FROM asked JOIN entities ON starts_with(substring(ref, 2), name) WHERE ref NOT LIKE '&#%' GROUP BY ref),
numbers AS (SELECT ref, try_cast(CASE WHEN lower(ref[3]) = 'x' THEN '0x' || rtrim(ref[4:], ';') ELSE rtrim(ref[3:], ';') END AS BIGINT) AS n FROM asked WHERE ref LIKE '&#%'),
decoded AS (SELECT ref, value FROM named UNION ALL SELECT ref, {_CODE} FROM numbers),
joined AS (SELECT rid, k, string_agg(piece || coalesce(value, ref), '' ORDER BY i) AS x FROM refs LEFT JOIN decoded USING (ref) GROUP BY rid, k),
r AS (SELECT p.*, trim(regexp_replace(regexp_replace(a.x, {_sql(f"{BLANKS}*" + chr(10) + "[ \t\r\f\x0b\xa0\n]*")}, chr(10), 'g'), {_sql(f"{BLANKS}+")}, ' ', 'g'), e' \\n') AS t,
  regexp_replace(b.x, {_sql("[ \t\n\r\f]+")}, ' ', 'g') AS title FROM p JOIN joined a ON a.rid = p.rid AND a.k = 'text' JOIN joined b ON b.rid = p.rid AND b.k = 'title'),
s AS (SELECT *, {_urn_sql("'response'", "page_id", "target_uri", "payload")} AS source_id, 'sha256:' || sha256(payload) AS payload_digest FROM r),
x AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, t AS block FROM s
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields', 'title: ' || title
    || {_sql(chr(13) + chr(10) + "language: ")} || regexp_extract(payload, {_sql(LANGUAGE)}, 1)
    || {_sql(f"{chr(13)}{chr(10)}source-status: {STATUS}{chr(13)}{chr(10)}source-header: Content-Type: text/html; charset=utf-8{chr(13)}{chr(10)}source-header: Content-Length: ")} || strlen(payload)
    || {_sql(chr(13) + chr(10) + "source-payload-length: ")} || strlen(payload)
    || {_sql(chr(13) + chr(10) + "source-payload-digest: ")} || payload_digest
    || {_sql(chr(13) + chr(10) + "text-digest: sha256:")} || sha256(t)
    || {_sql(chr(13) + chr(10) + "outlinks: ")} || len(regexp_extract_all(payload, {_sql(LINK)})) || {_sql(chr(13) + chr(10))}
  FROM s),
y AS (SELECT *, {_urn_sql("record_type", "source_id", "block")} AS record_id, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM x)
SELECT page_id, record_type, record_id, source_id, target_uri, '{DATE}' AS date, content_type, content_length, block_digest, payload_digest,
  concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || source_id, 'WARC-Target-URI: ' || target_uri,
    'WARC-Date: {DATE}', 'WARC-Block-Digest: ' || block_digest, 'WARC-Refers-To-Payload-Digest: ' || payload_digest, 'Content-Type: ' || content_type, 'Content-Length: ' || content_length, '', '') AS header, block
FROM y
"""
