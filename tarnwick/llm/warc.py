"""WARC archives: write pages, read records back, assemble captures.

``write_pages`` writes three records for each page (request, response or revisit,
metadata), the latter two groups naming the capture they belong to in
``WARC-Concurrent-To``. Spark's text writer commits the files, so a lost task leaves
no half archive; it ends each record with the blank line that the format asks for.
A file stays within ``FILE_BYTES`` before compression, or holds one page: pages beyond ``LARGE`` bytes go to
files of their own, of as few records as the largest of them asks for.
``read_records`` parses archives, plain or gzip, by their content lengths, a record
at a time. ``assemble`` joins a capture's records through the identifiers they are
concurrent to, and emits one nested row per capture.

Of records with equal payloads of at least ``revisit_from`` bytes the one with the
largest page_id is a response, and the others are revisits of it.

Defined results: a null html is an empty payload; a null url leaves the target out
and is null again when read; a null page_id sorts below all others and is null when
read; of repeated rows one is as any other row and the rest revisit it; line breaks
in a url become spaces; extra columns are not read, so names cannot clash; an empty
table makes an archive without records. A capture without request or metadata has
empty lists; a record that is concurrent to no capture is left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.session import new_table_path, stored

from .common import base32_of_hex
from .components import spread_join

DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n"
#: Stands for a null page_id.
NO_ID = -(2**63)
#: Bytes of one archive file, about, and its records, at most; bytes from which on a page goes to a file of large ones.
FILE_BYTES, FILE_RECORDS, LARGE = 1 << 30, 15_000, 1 << 16


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing blank line; headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK + BREAK), block)


def write_pages(pages: DataFrame, path: str, revisit_from: int = 0, compression: str = "gzip") -> None:
    """Write the archive of ``pages`` (page_id, url, html) to the folder ``path``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.regexp_replace("url", "[\r\n]+", " ").alias("url"), html.alias("html"), F.sha2(html, 256).alias("same"), F.octet_length(html).alias("size"),
    )
    # Which record is the response is settled on the keys alone; payloads move once, by page.
    keys = rows.select("id", "same", "size")
    first = keys.filter(F.col("size") >= revisit_from).groupBy("same").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    chosen = spread_join(keys.select("id", "same").distinct(), first, ["same"]).select("id", "same", "first")
    # Join and numbering of equal rows have the same keys and so share one shuffle.
    # Equal texts have one size: as a key it lets the choice of large or small pages reach the scan.
    copy = Window.partitionBy("id", "same", "size").orderBy(F.col("url").asc_nulls_first())
    joined = rows.join(chosen, ["id", "same"], "left").withColumn("copy", F.row_number().over(copy))
    joined = joined.withColumn("revisits", F.col("first").isNotNull() & ((F.col("id") != F.col("first")) | (F.col("copy") > 1)))
    key = lambda page, copy: F.concat_ws("|", page.cast("string"), F.col("same"), copy.cast("string"))
    own, target = key(F.col("id"), F.col("copy")), key(F.col("first"), F.lit(1))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.sha1("html")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(BREAK + BREAK),
    )
    capture, uri = _urn("capture", own), ("WARC-Target-URI", F.col("url"))
    revisit_only = lambda value: F.when(F.col("revisits"), value)
    host = F.regexp_extract("url", "^[A-Za-z]+://([^/]*)", 1)
    records = F.array(
        _record("request", _urn("request", own), [("WARC-Concurrent-To", capture), uri, ("Content-Type", F.lit("application/http; msgtype=request"))],
                F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(BREAK + BREAK))),
        _record(
            F.when(F.col("revisits"), "revisit").otherwise("response"), capture,
            [uri, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", revisit_only(_urn("capture", target))),
             ("WARC-Profile", revisit_only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
             ("Content-Type", F.lit("application/http; msgtype=response"))],
            F.when(F.col("revisits"), http).otherwise(F.concat(http, F.col("html"))),
        ),
        _record("metadata", _urn("metadata", own), [("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/warc-fields"))],
                F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(BREAK)), F.lit(""))),
    )
    largest = rows.agg(F.max("size")).head()[0] or 0
    for folder, part, most in (("small", joined.filter(F.col("size") <= LARGE), LARGE), ("large", joined.filter(F.col("size") > LARGE), largest)):
        if folder == "small" or largest > LARGE:
            # Three records a page, of which one has the page; so a file stays within its bytes whichever pages it gets.
            n = max(3, min(FILE_RECORDS, 3 * (FILE_BYTES // (most + 4096))))
            part.select(F.explode(records).alias("value")).write.option("lineSep", BREAK + BREAK).option("compression", compression).option("maxRecordsPerFile", n).text(f"{path}/{folder}")


def _records(stream):
    """(version line's headers, block) of each record of a binary stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its content length")
        yield headers, block


RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, url string, date string, "
    "http_header string, payload binary, payload_bytes long, payload_digest string, stated_digest string, fields map<string,string>"
)


def _parse(with_payload: bool):
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    def parse(batches):
        for batch in batches:
            for raw in batch.column("content"):
                held = raw.as_buffer() if hasattr(raw, "as_buffer") else raw.as_py()
                stream = io.BufferedReader(pa.BufferReader(held)) if not isinstance(held, bytes) else io.BytesIO(held)
                if bytes(memoryview(held)[:2]) == b"\x1f\x8b":
                    stream = gzip.GzipFile(fileobj=stream)
                rows, size = [], 0
                for h, block in _records(stream):
                    kind, http, payload, fields = h.get("warc-type"), None, block, {}
                    if h.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", "replace")
                    elif h.get("content-type", "").startswith("application/warc-fields"):
                        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x.strip())
                        fields = {a.strip(): c.strip() for a, _, c in pairs}
                    own = kind == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if own else None
                    rows.append((
                        kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"),
                        http, payload if own and with_payload else None, len(payload) if own else None, digest,
                        (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, fields,
                    ))
                    size += len(block)
                    if size > 4 << 20:
                        yield emit(rows)
                        rows, size = [], 0
                if rows:
                    yield emit(rows)

    return parse


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; digests and sizes are those of the payloads read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parse(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (response or revisit), requests, metadata.

    A revisit carries the payload's size and digest of the response it refers to.
    """
    captures = records.filter(F.col("type").isin("response", "revisit"))
    about = lambda kind, *cols: (
        records.filter(F.col("type") == kind).filter("concurrent_to is not null").groupBy(F.col("concurrent_to").alias("record_id"))
        .agg(F.collect_list(F.struct(F.col("record_id"), *cols)).alias(kind + "s"))
    )
    out = captures.join(about("request", "url", "http_header"), "record_id", "left").join(about("metadata", "fields"), "record_id", "left")
    full = captures.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"))
    out = spread_join(out, full, ["refers_to"], "left")
    return out.select(
        F.struct(
            "record_id", "type", "url", "date", "refers_to", "http_header", "payload",
            F.coalesce("payload_bytes", "_n").alias("payload_bytes"), F.coalesce("payload_digest", "_d", "stated_digest").alias("payload_digest"),
        ).alias("capture"),
        F.coalesce("requests", F.array()).alias("requests"),
        F.coalesce("metadatas", F.array()).alias("metadata"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all pages written to an archive, read back and assembled."""
    path = new_table_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = stored(read_records(spark, path, with_payload=False).drop("payload"), "warc-records")
    rows = assemble(records.withColumn("payload", F.lit(None).cast("binary"))).select(
        F.try_element_at(F.col("metadata")[0]["fields"], F.lit("page-id")).cast("long").alias("page_id"), F.col("capture.*")
    )
    ids = rows.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target")).filter("target is not null")
    rows = spread_join(rows, ids, ["refers_to"], "left")
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("target").alias("refers_to"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, octet_length(encode(h)) as n, sha1(h) as x, max(page_id) over (partition by h) as m from p)
select page_id, cast(n as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', 1 + cast((cast('0x' || substr(x || '0', 1 + (5 * i) // 4, 2) as bigint) >> (3 - (5 * i) % 4)) & 31 as bigint), 1)), 'string_agg', '') as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type,
  case when page_id = m then null else m end as refers_to
from d
"""
