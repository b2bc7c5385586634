"""WARC: reading records, and resolving not-modified revisits.

A revisit record has no body: it stands for the latest earlier full response to the same canonical
URL. The as-of join sorts all records by (URL, time) into ranges, fills the last full response
forward inside each range by a window, and carries what a range ends with to the next ones;
a URL with any share of all records is spread over ranges like others. A response is accepted if
the validators agree; the 304's permitted headers then replace the response's.
"""

from __future__ import annotations

import datetime
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaerix.llm.common import materialize

#: Headers of a 304 that may update the stored response's (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: Records in a range, about.
RANGE = 1 << 17

RECORD = "record_id long, kind string, url string, ts long, headers map<string,string>, body binary"
NAMES = [c.split()[0] for c in RECORD.split(", ")]
ARROW = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())


def canonical(url: Column) -> Column:
    """Lower-case host without www., no scheme, default port, fragment, tracking parameters, or final slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^www\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    query = F.regexp_replace(F.regexp_replace(rest, r"([?&])" + TRACKING + r"=[^&]*", "$1"), r"&{2,}", "&")
    query = F.regexp_replace(F.regexp_replace(query, r"\?&+", "?"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(query, r"/+(\?|$)", "$1"))


def lower_headers(headers: Column) -> Column:
    """A map by lower-case name. Names that differ in case alone are one field: its distinct values, by the names' order, with
    commas between them, as for a repeated field (RFC 9110, 5.3). Null values do not count; null headers are none."""
    entries = F.filter(F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))), lambda e: e["value"].isNotNull())
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.array_join(F.array_distinct(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"])), ", ")
    return F.map_from_arrays(names, F.transform(names, value))


def resolve_revisits(records: DataFrame, permitted: tuple = PERMITTED, ranges: int | None = None) -> DataFrame:
    """One row per record: record_id, kind, canonical_url, status, refers_to, merged_headers.

    records: record_id, kind (``response`` or ``revisit``), url, ts, headers (map with any case of names). A revisit takes
    the response with the largest (ts, record_id) below its own. status is ``full`` for a
    response; for a revisit ``resolved``, ``mismatch`` (etag, else last-modified, differs; weak marks do not count) or
    ``missing``; ``other`` for another kind. Without a validator on both sides
    a response is accepted. Null headers count as none; a null URL or time makes a revisit missing and a response no
    one's. A null record_id sorts first and stays null. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    spark = records.sparkSession
    rows = records.select("record_id", "kind", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), lower_headers(F.col("headers")).alias("headers"))
    rows = materialize(rows, "records")
    count = rows.count()
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE))
    ranged = rows.repartitionByRange(n, "canonical_url", "ts", "record_id").withColumn("pid", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    usable = (F.col("kind") == "response") & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    full = F.when(usable, F.struct("canonical_url", "record_id", "headers"))
    ordered = Window.partitionBy("pid").orderBy("canonical_url", "ts", "record_id")
    inside = ranged.withColumn("_r", F.last(full, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    # One row for each range: what it ends with, filled forward over the ranges.
    ends = ranged.groupBy("pid").agg(F.max_by(full, F.when(usable, F.struct("canonical_url", "ts", "record_id"))).alias("_end"))
    carry = ends.withColumn("_c", F.last("_end", ignorenulls=True).over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).select("pid", "_c")
    # As many rows as ranges, which are a bounded number of records each.
    joined = inside.join(F.broadcast(carry) if n <= 1 << 16 else carry, "pid", "left").withColumn("_r", F.coalesce("_r", "_c"))
    seen = F.when((F.col("_r.canonical_url") == F.col("canonical_url")) & F.col("ts").isNotNull(), F.col("_r"))
    weak = lambda m, h: F.regexp_replace(F.element_at(m, F.lit(h)), "^W/", "")
    joined = joined.withColumn("_r", seen)
    etag, own = weak(F.col("_r.headers"), "etag"), weak(F.col("headers"), "etag")
    since, since_own = F.element_at("_r.headers", F.lit("last-modified")), F.element_at("headers", F.lit("last-modified"))
    agree = F.when(etag.isNotNull() & own.isNotNull(), etag == own).when(since.isNotNull() & since_own.isNotNull(), since == since_own).otherwise(True)
    status = (
        F.when(F.col("kind") == "response", "full").when(~F.coalesce(F.col("kind") == "revisit", F.lit(False)), "other")
        .when(F.col("_r").isNull(), "missing").when(agree, "resolved").otherwise("mismatch")
    )
    joined = joined.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    allowed = F.array(*[F.lit(h) for h in permitted])
    news = F.map_filter("headers", lambda k, v: F.array_contains(allowed, k))
    kept = F.map_filter("_r.headers", lambda k, v: ~F.array_contains(F.map_keys(news), k))
    merged = F.when(resolved, F.map_concat(kept, news)).when(F.col("kind") == "response", F.col("headers"))
    return joined.select("record_id", "kind", "canonical_url", "status", F.when(resolved, F.col("_r.record_id")).alias("refers_to"), merged.alias("merged_headers"))


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; the values of a repeated one with commas between them."""
    out: dict[str, str] = {}
    for line in lines:
        name, mark, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if mark:
            out[name] = f"{out[name]}, {value}" if name in out and value not in out[name].split(", ") else out.get(name, value)
    return out


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, compressed by record, as a whole, or not at all; one record is held at a time."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while line := stream.readline().rstrip(b"\r\n"):
            lines.append(line.decode("utf-8", "replace"))
        headers = _fields(lines)
        length = headers.get("content-length", "")
        yield headers, stream.read(int(length) if length.isdigit() else 0)


def _seconds(date: str | None) -> int | None:
    try:
        return None if date is None else int(datetime.datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp())
    except ValueError:
        return None


#: Records and bytes of bodies that are handed on at once.
BATCH, BATCH_BYTES = 512, 1 << 24


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (RECORD) of the WARC files below *path*; ts is in seconds, null where the date cannot be read.

    record_id is the file's number, in the order of paths, times 2**32 and the record's number in its file: unique, and the same in every run over the
    same files. Files are read through Spark, so any store works. A file (2 GB at most) is one task and
    is decompressed as it is read.
    """
    files = spark.read.format("binaryFile").load(path)
    # One row for each file, without contents.
    numbers = files.select("path").withColumn("file", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    numbers = materialize(numbers, "files")
    side = F.broadcast(numbers) if numbers.count() <= 1 << 17 else numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for i, (h, block) in enumerate(parse_warc(content.as_py())):
                    kind = h.get("warc-type", "")
                    head, _, body = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
                    rows.append(((file << 32) + i, kind, h.get("warc-target-uri"), _seconds(h.get("warc-date")), list(_fields(head.decode("latin-1").split("\r\n")[1:]).items()), body))
                    size += len(body)
                    if len(rows) >= BATCH or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=NAMES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=NAMES)

    return files.select("path", "content").join(side, "path").select("file", "content").mapInArrow(run, RECORD)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of a crawl of *pages* (page_id, url, html): of each page a revisit before its response, the response, and a revisit after it."""
    etag = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    base = pages.select(F.col("page_id").cast("long").alias("p"), "url", etag.alias("etag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("n"))
    make = lambda at, kind, headers: F.struct((F.col("p") * 3 + at).alias("record_id"), F.lit(kind).alias("kind"), (F.col("p") * 3 + at).alias("ts"), headers.alias("headers"))
    date = lambda at: F.concat(F.lit("t"), (F.col("p") * 3 + at).cast("string"))
    full = F.create_map(F.lit("ETag"), "etag", F.lit("Content-Length"), "n", F.lit("Date"), date(1))
    revisit = lambda at: F.create_map(F.lit("ETag"), F.col("etag"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), date(at))
    three = F.array(make(0, "revisit", revisit(0)), make(1, "response", full), make(2, "revisit", revisit(2)))
    return base.select("url", F.explode(three).alias("r")).select("r.record_id", "r.kind", "url", "r.ts", "r.headers")


ORACLE = r"""
WITH u AS (SELECT page_id AS p, sha1(coalesce(html, '')) AS etag, length(coalesce(html, '')) AS n,
                  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
c AS (SELECT p, etag, n, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', ''), ':(?:80|443)$', '') ||
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''),
          '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g') AS canonical_url FROM u),
r AS (SELECT p * 3 + k AS record_id, CASE k WHEN 1 THEN 'response' ELSE 'revisit' END AS kind, canonical_url, etag, n, k FROM c, (VALUES (0), (1), (2)) v(k)),
w AS (SELECT *, last_value(CASE WHEN k = 1 THEN {'id': record_id, 'etag': etag, 'n': n} END IGNORE NULLS)
        OVER (PARTITION BY canonical_url ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM r),
s AS (SELECT *, CASE WHEN k = 1 THEN 'full' WHEN o IS NULL THEN 'missing' WHEN o.etag = etag THEN 'resolved' ELSE 'mismatch' END AS status FROM w)
SELECT record_id, kind, canonical_url, status, CASE WHEN status = 'resolved' THEN o.id END AS refers_to,
       CASE WHEN status = 'full' THEN concat('content-length=', n, ';date=t', record_id, ';etag=', etag)
            WHEN status = 'resolved' THEN concat('content-length=', o.n, ';date=t', record_id, ';etag=', etag) END AS merged_headers
FROM s
"""
