"""WARC archives of pages: a deterministic sharded writer, and the reader.

Writing.  Digests are taken anew from the payloads.  Of pages with equal payloads of ``LEAST`` bytes or more the one with
the smallest id is a response, the others are revisits that refer to it.  Records are sorted by page and dealt to shards by
ranges of page ids that hold about equal bytes.  A shard is written in order, each record a gzip member of its own; a
file that has reached ``roll`` compressed bytes is closed and the next begun.  All headers follow from the record (ids by name,
lengths, digests, a given date), and compression has no time stamp, so files are equal byte by byte in every run.

Commit.  A file is written under a temporary name in a folder of such names and renamed when complete, so a task that is lost or
runs twice leaves the same file again.  The manifest (one row for each file, with records, bytes and digest) is written last; a
file that it does not list is not part of the archive.  What lost tasks have left under temporary names then goes.

Reading.  The files of the manifest are dealt to tasks; each is read as a stream of gzip members, digests are checked.

Scale: payloads are shuffled once, by shard.  Duplicates are found on digests alone, and only marks of revisits travel to the
shards.  Shards grow with the archive, so that there are about ``SHARDS`` at most; the plan of the shards is made from at most
``BUCKETS`` sums.  A bucket of ids that is larger than a shard (one id repeated millions of times) is divided further by digest.

Files are reached by pyarrow's file systems under the shared folder (local, S3, GCS, HDFS).

Defined results.  Null html: empty payload.  Null page id: no id header, sorted first; with an id among its copies it is a revisit.
Rows with the smallest id and the same payload are all responses.  Null url: ``urn:page:`` and the id.  Empty table: an archive without
files.  Other columns are not read.  Very long pages: streamed in whole, one record at a time."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrays import lean
from leafmill.llm.common import shared_dir, ship, table, until_end

LEAST = 100
SHARD = 48 << 20  # payload bytes, at least
SHARDS = 1 << 13
ROLL = 16 << 20  # compressed bytes
BUCKETS = 1 << 16
TEMPORARY = "_unfinished"
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space of addresses
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs.LocalFileSystem(), folder


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}')}>"


def _framed(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n" + block + b"\r\n\r\n"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record; ``first``: the page that holds the same payload, for a revisit."""
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{'' if page is None else page}"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    headers.append(("X-Payload-Length", str(len(payload))))
    if page is not None:
        headers.append(("X-Page-ID", str(page)))
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page", str(first))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _framed(headers, http if revisit else http + payload)


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Roller:
    """The files of one shard, one after the other."""

    def __init__(self, folder: str, shard: int, roll: int) -> None:
        self.files, self.folder = opened(folder)
        self.shard, self.roll, self.number, self.out = shard, roll, 0, None

    def _begin(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.temporary = f"{self.folder}/{TEMPORARY}/{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.temporary)
        self.digest, self.size, self.records = hashlib.sha256(), 0, 0
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._put(_member(_framed(head, b"format: WARC File Format 1.1\r\n")))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.digest.update(raw)
        self.size += len(raw)

    def add(self, raw: bytes) -> dict | None:
        """Adds a record; a row of the manifest if that completed a file."""
        if self.out is None:
            self._begin()
        self._put(_member(raw))
        self.records += 1
        return self.close() if self.size >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.files.move(self.temporary, f"{self.folder}/{self.name}")
        self.out, self.number = None, self.number + 1
        return {"shard": self.shard, "file": self.name, "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest()}


MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
_MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def digested(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, payload, digest."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def revisits(rows: DataFrame) -> DataFrame:
    """Rows page_id, digest, first: which pages only repeat the payload of page ``first``.  Payloads are left behind here."""
    large = rows.where(F.length("payload") >= LEAST).select("page_id", "digest")
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    return large.join(shared.select("digest", "first"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()


def _bucket(low: int, shift: int) -> Column:
    """The bucket of a page id; ids are shifted first, so that their difference fits."""
    return F.coalesce(F.shiftright("page_id", shift) - F.lit(low), F.lit(-1))


def shard_plan(spark: SparkSession, rows: DataFrame, shard: int) -> DataFrame:
    """Rows bucket, base, ways for ``sharded``, and with how to find a bucket: which shards a bucket of page ids goes to.  At
    most ``BUCKETS`` + 2 rows."""
    low, high = rows.agg(F.min("page_id"), F.max("page_id")).first()
    shift, low = 0, low or 0
    while ((high or 0) - low) >> shift > BUCKETS:
        shift += 1
    low >>= shift
    sums = rows.groupBy(_bucket(low, shift).alias("bucket")).agg(F.sum(F.length("payload") + 600).alias("size")).orderBy("bucket").collect()
    shard = max(shard, -(-sum(row["size"] for row in sums) // SHARDS))
    plan, base, held = [], 0, 0
    for row in sums:
        if held and held + row["size"] > shard:
            base, held = base + 1, 0
        ways = -(-row["size"] // shard) if row["size"] > 2 * shard else 1
        plan.append((row["bucket"], base, ways))
        held += row["size"]
        if ways > 1:
            base, held = base + ways, 0
    out = spark.createDataFrame(plan, "bucket long, base long, ways long")
    return out.withColumn("low", F.lit(low).cast("long")).withColumn("shift", F.lit(shift))


def lanes(spark: SparkSession, count: int) -> DataFrame:
    """Rows shard, lane: for each of ``count`` shards a number that hash partitioning sends to a partition of its own.

    As many rows as there are shards, which ``SHARDS`` and ``BUCKETS`` bound."""
    found = spark.range(20 * count + 64).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("shard")).agg(F.min("id").alias("lane"))
    every = spark.range(count).select(F.col("id").alias("shard"))
    return every.join(found.withColumn("shard", F.col("shard").cast("long")), "shard", "left").withColumn("lane", F.coalesce("lane", "shard"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, shard: int = SHARD, roll: int = ROLL) -> DataFrame:
    """Writes the archive and returns its manifest, read back from where it was committed.  ``folder`` must be new."""
    ship(spark)
    rows = digested(pages)
    # a revisit's mark goes to the same shard as its page and is sorted before it, so payloads move only once
    marks = revisits(rows).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first")
    both = rows.withColumn("first", F.lit(None).cast("long")).unionByName(marks)
    sizes = rows.select("page_id", "payload")
    plan = shard_plan(spark, sizes, shard)
    first = plan.select("low", "shift").first() or {"low": 0, "shift": 0}
    count = plan.agg(F.max(F.col("base") + F.col("ways"))).first()[0] or 1
    way = F.floor(F.conv(F.substring("digest", 1, 6), 16, 10).cast("long") * F.col("ways") / F.lit(1 << 24))
    dealt = both.withColumn("bucket", _bucket(first["low"], first["shift"])).join(F.broadcast(plan.select("bucket", "base", "ways")), "bucket").withColumn("shard", F.col("base") + way)
    dealt = dealt.select("shard", "page_id", "url", "payload", "digest", "first")
    dealt = dealt.join(F.broadcast(lanes(spark, int(count))), "shard").repartition(int(count), "lane").drop("lane").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", F.col("payload").isNotNull(), "url")
    files, path = opened(folder)
    files.create_dir(f"{path}/{TEMPORARY}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_now: Roller | None = None
        marked, target = None, None
        for batch in batches:
            done = []
            for at, page, url, payload, digest, first_ in zip(*(c.to_pylist() for c in batch.columns)):
                if payload is None:
                    marked, target = (page, digest), first_
                    continue
                if open_now is None or open_now.shard != at:
                    done.append(open_now.close() if open_now else None)
                    open_now = Roller(folder, at, roll)
                again = marked == (page, digest)
                done.append(open_now.add(record(page, url, payload, digest, target if again else None, again)))
            yield pa.RecordBatch.from_pylist([x for x in done if x], _MANIFEST)
        if open_now and (last := open_now.close()):
            yield pa.RecordBatch.from_pylist([last], _MANIFEST)

    dealt.mapInArrow(lean(run), MANIFEST).coalesce(int(count)).write.parquet(f"{folder}/manifest")
    files.delete_dir(f"{path}/{TEMPORARY}")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The uncompressed members of a gzip file."""
    raw, parts, unpack = b"", [], zlib.decompressobj(31)
    while raw or (raw := stream.read(1 << 20)):
        parts.append(unpack.decompress(raw))
        raw = b""
        if unpack.eof:
            yield b"".join(parts)
            raw, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
    if any(parts):
        raise ValueError("the file ends within a record")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; its length and block digest are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if lines[0] != "WARC/1.1" or "sha256:" + hashlib.sha256(block).hexdigest() != headers["warc-block-digest"]:
        raise ValueError("damaged record " + headers.get("warc-record-id", "?"))
    return headers, block


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string())])


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all files of the manifest.  A revisit has its own length and digest, and no payload."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    names = manifest.select("file").repartition(max(1, manifest.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        headers, block = parsed(raw)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        response = headers["warc-type"] == "response"
                        payload = block.partition(b"\r\n\r\n")[2] if response else None
                        size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha256:")
                        if response and (len(payload) != size or (hashlib.sha256(payload).hexdigest() != digest)):
                            raise ValueError(f"{name}: damaged payload of {headers['warc-record-id']}")
                        number = headers.get("x-page-id"), headers.get("x-refers-to-page")
                        rows.append({"page_id": number[0] and int(number[0]), "url": headers["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": number[1] and int(number[1]), "payload": payload if payloads else None, "file": name})
                        held += len(raw)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return names.mapInArrow(lean(run), RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/leafmill/warc-{uuid.uuid4().hex}"
    write_archives(spark, table(spark, sf_dir, "pages"), until_end(spark, folder))
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
WITH payloads AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest AS digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= {LEAST} GROUP BY payload_digest),
told AS (SELECT p.*, f.first, f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first AS again FROM payloads p LEFT JOIN firsts f ON p.payload_digest = f.digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM told
"""
