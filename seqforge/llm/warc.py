"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key; each task writes its range as gzip members,
rolls to a new file when the compressed size passes a limit, regenerates
headers and digests, and writes under a temporary name that carries the
attempt.  A finished file gets its final name and a row in the manifest; the
manifest is written last and lists all that belongs to the archive, so files
of lost or repeated attempts are never read.  Equal input gives equal bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.llm import common as C

ROLL_BYTES = 16 << 20
LEAST_REVISIT = 100
#: A fixed date: the tables name none, and output must not depend on the clock.
DATE = "2000-01-01T00:00:00Z"
SPACE_ID = uuid.UUID(int=0)
SALT = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Compressed bytes given to the decompressor at once.
STEP = 1 << 14


def record_id(key, url: str | None, digest: str, n: int) -> str:
    """The n-th record of equal key, url and payload; unique in an archive."""
    name = f"{key}\n{url}\n{digest}\n{n}"
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, name)}>"


def member(record: dict) -> bytes:
    """One WARC/1.1 record as a gzip member without name and time."""
    payload = record["payload"]
    revisit = record["refers_to"] is not None
    body = b"" if revisit else payload
    digest = hashlib.sha256(payload)
    shown = digest.hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(record['key'], record['url'], shown, record['n'])}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(record['url'])}",
        f"WARC-Payload-Digest: sha256:{base64.b32encode(digest.digest()).decode().rstrip('=')}",
        f"WARC-Block-Digest: sha256:{base64.b32encode(hashlib.sha256(body).digest()).decode().rstrip('=')}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(record['refers_to'], record['refers_to_url'], shown, 0)}",
           f"WARC-Refers-To-Target-URI: {clean(record['refers_to_url'])}", f"WARC-Refers-To-Date: {DATE}",
           f"X-Refers-To-Key: {record['refers_to']}"] if revisit else []),
        f"X-Record-Key: {'' if record['key'] is None else record['key']}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def clean(url: str | None) -> str:
    """A header value holds no line breaks."""
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in url or "")


def members(raw: bytes):
    """The uncompressed gzip members of a file, one after another.  The
    decompressor gets a step at a time: what it leaves over is copied, and
    would be the rest of the file for every member."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            piece = view[at:at + STEP]
            if not len(piece):
                raise ValueError("cut member")
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def records(raw: bytes):
    """(headers, block) of every record of an uncompressed archive file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in raw[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = raw[end + 4:end + 4 + size]
        if len(block) != size or raw[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError("cut record")
        yield head, block
        at = end + 8 + size


MANIFEST = "file string, first_key long, last_key long, records long, bytes long, sha256 string"


def _write(out: str, roll: int):
    schema = pa.schema([("file", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()),
                        ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        shard, part, rows, f = ctx.partitionId(), 0, [], None

        def close():
            f.close()
            name = f"shard-{shard:06d}-{part:05d}.warc.gz"
            fs.move(tmp, f"{base}/{name}")
            keys = [k for k in seen if k is not None]
            rows.append((name, keys[0] if keys else None, keys[-1] if keys else None, len(seen), size, sha.hexdigest()))
        same, n, first = None, 0, (None, None, None)
        for r in (x for b in batches for at in range(0, b.num_rows, 64) for x in b.slice(at, 64).to_pylist()):
            if r["payload"] is None:  # what the rows of this key and digest refer to
                first = r["digest"], r["key"], (r["refers_to"], r["refers_to_url"])
                continue
            n = n + 1 if same == (r["key"], r["digest"], r["url"]) else 0
            same = r["key"], r["digest"], r["url"]
            to = first[2] if first[:2] == (r["digest"], r["key"]) else (None, None)
            if f is None:
                tmp = f"{base}/.tmp-{shard:06d}-{part:05d}-{ctx.taskAttemptId()}"
                f, size, sha, seen = fs.open_output_stream(tmp, compression=None), 0, hashlib.sha256(), []
            gz = member(r | {"n": n, "refers_to": to[0], "refers_to_url": to[1]})
            f.write(gz)
            sha.update(gz)
            size += len(gz)
            seen.append(r["key"])
            if size >= roll:
                close()
                f, part = None, part + 1
        if f is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
    return run


def write(pages: DataFrame, out: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          roll: int = ROLL_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Write an archive to ``out`` (a URI) and return its manifest.

    Of rows with equal payloads of at least ``least`` bytes, that with the
    smallest key is a response and the others revisit it.  A null payload is
    empty, a null url too; rows of a null key are responses, are sorted first
    and are never revisited; rows that repeat the smallest key are responses
    alike, with record ids of their own.  Other columns are not archived.  An empty table gives an empty
    manifest.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    small = rows.filter(F.col("key").isNotNull() & (F.length("payload") >= least)).select("key", "url", "digest")
    # one row per digest that several rows have; copies by salt spread a hot one
    first = small.groupBy("digest").agg(F.min(F.struct("key", "url")).alias("first"), F.count("*").alias("copies")).filter("copies > 1") \
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    again = small.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT))).join(first, ["digest", "salt"]) \
        .filter(F.col("key") > F.col("first.key")) \
        .select("key", "digest", F.col("first.key").alias("refers_to"), F.col("first.url").alias("refers_to_url")).distinct()
    # payloads are dealt once: what a key's copies refer to lies before them
    rows = rows.unionByName(again, allowMissingColumns=True).repartitionByRange(C.partitions_of(spark), "key", "digest") \
        .sortWithinPartitions("key", "digest", F.col("payload").isNotNull(), "url")
    manifest = rows.mapInArrow(_write(f"{out}/data", roll), MANIFEST)
    manifest.write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def _read(out: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(out)
        for b in batches:
            for name, size, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    raw = f.read()
                if len(raw) != size or hashlib.sha256(raw).hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")
                rows = []
                for head, block in (x for m in members(raw) for x in records(m)):
                    rows.append((head, block))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)
    return run


RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "record_id string, payload binary")


def batch(rows: list) -> pa.RecordBatch:
    def number(h, k):
        return int(h[k]) if h.get(k) else None

    def bare(h):
        d = h["WARC-Payload-Digest"].split(":")[1]
        return base64.b32decode(d + "=" * (-len(d) % 8)).hex()
    for h, block in rows:
        if h["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != bare(h):
            raise ValueError(f"{h['WARC-Record-ID']}: wrong payload digest")
    return pa.RecordBatch.from_arrays([
        pa.array([number(h, "X-Record-Key") for h, _ in rows], pa.int64()), pa.array([h["WARC-Target-URI"] for h, _ in rows]),
        pa.array([h["WARC-Type"] for h, _ in rows]), pa.array([number(h, "X-Refers-To-Key") for h, _ in rows], pa.int64()),
        pa.array([int(h["X-Payload-Length"]) for h, _ in rows], pa.int64()), pa.array([bare(h) for h, _ in rows]),
        pa.array([h["WARC-Record-ID"] for h, _ in rows]), pa.array([x if h["WARC-Type"] == "response" else None for h, x in rows], pa.binary())],
        names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "record_id", "payload"])


def read(spark: SparkSession, out: str) -> DataFrame:
    """The records of an archive, each file checked against the manifest and
    each response against its digest; revisits have no payload."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").select("file", "bytes", "sha256")
    return manifest.repartition(C.partitions_of(spark), "file").mapInArrow(_read(f"{out}/data"), RECORDS)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI of the cluster's default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


def digest(pages: DataFrame) -> DataFrame:
    """The columns of query op6, from the archives read back."""
    spark = pages.sparkSession
    out = qualified(spark, C.shared_path(spark, "warc"))
    write(pages, out)
    return read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
