"""WARC archives of pages, index first: what stands where is a table, and records are read by coalesced byte ranges.

Archives are files of gzip members, one for each record, written by the tasks
through pyarrow's file systems straight into a shared folder. Index rows leave a task
while its files are open, but count only once it has ended, with all of them closed: a lost or
repeated task leaves files that no index row names, so the index alone says what is archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlines.llm.common import keep, shared_path

#: Neighbouring records are read in one go if no more than GAP bytes lie between and the range starts in the same RANGE bytes of the file.
GAP, RANGE = 64 << 10, 8 << 20
#: A task begins a new file beyond so many bytes.
FILE_BYTES = 512 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "file string, offset long, length long, page_id {id}, url string, digest string, record_type string"
RECORD_SCHEMA = "page_id {id}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id}, payload binary, intact boolean"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _clean(value) -> str:
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value))


def build_record(page_id, url: str | None, payload: bytes, digest: str, revisits: bool, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only, whose Content-Length is that of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if revisits:
        head += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page-Id: {refers_to}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; intact says whether the digest fits the payload (responses) or is well formed (revisits)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    told = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    intact = len(digest) == 32 if kind == "revisit" else told == len(payload) and _digest(payload) == digest
    return {"page_id": fields.get("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": told, "payload_digest": digest, "refers_to": fields.get("X-Refers-To-Page-Id"), "payload": None if kind == "revisit" else payload, "intact": intact}


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def find_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest (hex SHA-1), refers_to of the pages that revisit another one with an equal payload of min_bytes or more."""
    narrow = keep(pages.select("page_id", F.sha1(_payload(F.col("html")).cast("binary")).alias("digest"), F.octet_length(_payload(F.col("html"))).alias("n")).where(F.col("n") >= min_bytes).drop("n"), "digests")
    best = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return narrow.join(best, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Archive every page under folder (a new one in the shared folder, if None) and return the index, itself kept there.

    A null html is an empty payload. Of equal payloads of min_bytes or more, the
    record with the largest page_id is a response and the others revisit it; rows
    equal in page_id and html are alike, so both may be responses. A null page_id
    counts as the smallest. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    seen = find_revisits(pages, min_bytes).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    source = pages.select("page_id", "url", _payload(F.col("html")).cast("binary").alias("payload"))
    on = source["page_id"].eqNullSafe(seen["_id"]) & (F.sha1(source["payload"]) == seen["_digest"])
    rows = source.join(seen.hint("shuffle_hash"), on, "left").select("page_id", "url", "payload", F.col("_digest").isNotNull().alias("revisits"), "refers_to")
    names = ["file", "offset", "length", "page_id", "url", "digest", "record_type"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found: list[tuple] = []
                for i in range(batch.num_rows):
                    page_id, url, payload, revisits, refers_to = (batch.column(k)[i].as_py() for k in range(5))
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    digest = _digest(payload)
                    record = _member(build_record(page_id, url, payload, digest, revisits, refers_to))
                    out.write(record)
                    found.append((name, at, len(record), page_id, url, digest, "revisit" if revisits else "response"))
                    at += len(record)
                columns = list(zip(*found)) if found else [()] * len(names)
                kinds = [pa.string(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    index = keep(rows.mapInArrow(write, INDEX_SCHEMA.format(id=kind)), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def plan_ranges(index: DataFrame, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """folder, file, begin, stop, records (offset, length): byte ranges that hold the selected records, neighbours together."""
    order = Window.partitionBy("folder", "file").orderBy("offset", "length")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    fresh = F.coalesce((F.col("offset") - before > gap) | (F.floor(F.col("offset") / size) != F.floor(F.lag("offset").over(order) / size)), F.lit(True))
    numbered = index.withColumn("fresh", fresh.cast("int")).withColumn("range", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("folder", "file", "range").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return found.drop("range")


def read_records(index: DataFrame, payloads: bool = True, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """The records that the selected rows of an index name, parsed: RECORD_SCHEMA; payload is null unless payloads.

    Rows of the index may be selected in any way beforehand; each is read once,
    and a row that stands twice is returned twice.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    ranges = keep(plan_ranges(index, gap, size), "ranges")
    total, n = ranges.agg(F.sum(F.col("stop") - F.col("begin")), F.count(F.lit(1))).first()
    spread = max(1, min(n, max(ranges.sparkSession.sparkContext.defaultParallelism * 2, (total or 0) // (64 << 20))))
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "intact"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(f"{path}/{row['file']}") as f:
                    data = f.read_at(row["stop"] - row["begin"], row["begin"])
                found = []
                for r in row["records"]:
                    at = r["offset"] - row["begin"]
                    found.append(parse_record(zlib.decompress(data[at : at + r["length"]], 31)))
                    if not payloads:
                        found[-1]["payload"] = None
                kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(names, kinds, strict=True)], names)

    read_back = ranges.repartition(spread, "folder", "file", "begin").mapInArrow(read, RECORD_SCHEMA.format(id="string"))
    return read_back.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
