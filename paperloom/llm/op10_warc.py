"""WARC archives: write pages as response and revisit records in segments, read them back and put them together.

Writing: a payload goes out as an HTTP response in chunked transfer framing. A block longer than ``SEGMENT`` bytes
is split: the first record keeps the type, the others are ``continuation`` records with the origin's id and a
segment number, and the last one states the total length. Spark's own text writer does the output with the end of
a record as its line separator and gzip, so files are committed like any other table on any file system, and a lost task
leaves nothing behind.

Reading: files are parsed record by record; segments are grouped by the id of their origin, ordered by number,
checked against the total length and joined, and the chunks are decoded. Records of one segment skip the shuffle.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, portions, release, table

SEGMENT = 16_384
CHUNK = 4_096
DEDUPLICATED_FROM = 1000
#: Records of one file: with segments of at most SEGMENT bytes this bounds what a reading task holds.
RECORDS_PER_FILE = 2_000
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """What chunked framing holds; a ValueError if the framing is broken or cut off. Chunk extensions and trailers
    are read over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends behind it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def records_of(number: int, page_id, url, payload: bytes, digest: str, refers_to, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a response in one or more segments, or a revisit with the headers only."""
    page = "null" if page_id is None else str(page_id)
    record_id = f"urn:record:{number}:page:{page}"
    fields = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\n" % len(payload)
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record("revisit", record_id, fields, http + b"\r\n")]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record("response", record_id, fields, block)]
    out = []
    cuts = range(0, len(block), segment)
    for n, at in enumerate(cuts, 1):
        part = block[at : at + segment]
        if n == 1:
            out.append(record("response", record_id, [*fields, ("WARC-Segment-Number", "1")], part))
            continue
        more = [("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(n))]
        if n == len(cuts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record("continuation", f"{record_id}:segment:{n}", more, part))
    return out


def _render(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for rows in portions(batches, 3):
        out: list[bytes] = []
        for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            out += records_of(*row, segment)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
    release()


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, scratch: Scratch | None = None) -> None:
    """Write pages (page_id, url, html) as WARC files under path. Of equal payloads of at least DEDUPLICATED_FROM bytes
    the largest page_id is the response and the rest are revisits of it. Which one that is comes from digests, lengths and
    ids alone; a payload that a large share of the rows has is joined with it where its rows are, the others by digest.

    A null html is an empty payload, a null url leaves the target out. A null page_id sorts below all others and is
    written as such; rows that repeat the largest page_id are responses all. An empty table writes no record.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc-best")
    rows = pages.select(
        F.monotonically_increasing_id().alias("number"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    size = F.length("payload")
    best = (
        rows.where(size >= DEDUPLICATED_FROM)
        .groupBy(F.col("digest"), size.cast("long").alias("n"))
        .agg(F.max("page_id").alias("keep"), F.count("*").alias("copies"))
        .where("copies > 1 and keep is not null")
        .select(F.concat_ws(":", "digest", "n").alias("key"), "keep", "copies")
    )
    best = scratch.keep(best, "best")
    # at most HOT_KEYS payloads can have a HOT_KEYS-th of the copies each
    least = max(64, int(best.agg(F.sum("copies")).first()[0] or 0) // HOT_KEYS)
    hot = best.where(F.col("copies") >= least).select("key", F.col("keep").alias("hot"))
    rest = best.where(F.col("copies") < least).select("key", F.col("keep").alias("rest"))
    keyed = rows.withColumn("key", F.concat_ws(":", "digest", size.cast("long"))).join(F.broadcast(hot), "key", "left")
    keyed = keyed.withColumn("key", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("#"), "number")))
    joined = keyed.join(rest, "key", "left").withColumn("keep", F.coalesce("hot", "rest"))
    refers = F.when(F.coalesce(F.col("page_id") < F.col("keep"), F.col("keep").isNotNull()), F.col("keep"))
    shaped = joined.select("number", "page_id", "url", "payload", "digest", refers.alias("refers_to"))
    out = shaped.mapInArrow(lambda it: _render(it, segment), "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a plain or gzip archive; a ValueError where the data
    break off."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield fields, block
        at = end + 4 + size + 4


_RECORD = "record_id string, kind string, url string, digest string, refers_to string, origin string, segment long, total long, block binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.binary()]

    def bare(x: str | None) -> str | None:
        return x.strip("<>") if x is not None else None

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for rows in batches:
        for content in rows.column(0):
            out = []
            for f, block in parse(content.as_py()):
                record_id = bare(f.get("warc-record-id"))
                number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                origin = bare(f.get("warc-segment-origin-id")) or (record_id if number else None)
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                out.append((record_id, f["warc-type"], f.get("warc-target-uri"), digest, bare(f.get("warc-refers-to")), origin, int(number or 1), int(total) if total else None, block))
                if len(out) >= 500:
                    yield batch(out)
                    out = []
            yield batch(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files under path, segments apart."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, _RECORD)


def _join_segments(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("segment", kind="stable").drop_duplicates("segment")
    first, block = part.iloc[0], b"".join(part["block"])
    total = part["total"].dropna()
    if first["segment"] != 1 or part["segment"].iloc[-1] != len(part) or not len(total) or int(total.iloc[0]) != len(block):
        raise ValueError(f"segments of {first['origin']} are missing or their length is wrong")
    return pd.DataFrame([{**{k: first[k] for k in ("record_id", "kind", "url", "digest", "refers_to")}, "block": block}])


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: continuation segments are joined to their origin. A missing segment or a wrong total length is
    an error. A segment that was stored twice counts once. Its memory is bounded by the largest record."""
    whole = records.where("origin is null").select("record_id", "kind", "url", "digest", "refers_to", "block")
    parts = records.where("origin is not null").groupBy("origin")
    joined = parts.applyInPandas(_join_segments, "record_id string, kind string, url string, digest string, refers_to string, block binary")
    return whole.unionByName(joined)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in portions(batches, 5):
        out, sizes = [], []
        for block in rows.column("block"):
            head, _, body = block.as_py().partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
            body = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
            out.append(body)
            sizes.append(int(fields.get(b"x-payload-length", len(body))))
        columns = [*(rows.column(c) for c in ("record_id", "kind", "url", "digest", "refers_to")), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["record_id", "kind", "url", "digest", "refers_to", "payload", "stated_bytes"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, url, digest, refers_to, payload, stated_bytes) of each whole record under path; the payload of
    a revisit is empty, its length is the stated one."""
    shape = "record_id string, kind string, url string, digest string, refers_to string, payload binary, stated_bytes long"
    return reassemble(read_records(spark, path)).mapInArrow(_payloads, shape)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op10")
    path = scratch.place("archives")
    write_warc(table(spark, sf_dir, "pages"), path, scratch=scratch)
    back = read_warc(spark, path)
    response = F.col("kind") == "response"
    return back.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, ':page:(-?[0-9]+)', 1), '') as bigint)").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(refers_to, 'urn:page:(-?[0-9]+)', 1), '') as bigint)").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (SELECT html, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN keep IS NULL OR keep = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> p.page_id THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.n >= 1000 AND p.html = k.html
"""
