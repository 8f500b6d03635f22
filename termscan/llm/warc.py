"""Deterministic sharded WARC archives.

``write_archives`` range-sorts records, cuts them into ranges of about equal
payload, and rolls to a new file when the compressed size is reached.  Every
record is a gzip member of its own.  Headers and digests are made anew from
the payload, the date is a parameter, and file names follow the order of the
ranges, so the same rows give the same archives.  Files are written under
temporary names and renamed; the manifest, written last, names the files that
belong to the archive.

Defined cases: a null payload is an empty one; a null url gives no target
address; a null record id sorts first and reads back as null; equal ids stay
separate records, in the order of (id, url, digest); an empty table gives an
empty manifest; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.storage import open_input, shared_path, spread_by_file, stored, write_atomically

MANIFEST_SCHEMA = "folder string, file string, records long, bytes long"
RECORD_SCHEMA = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_FROM_BYTES = 1000


def with_revisits(records: DataFrame, smallest: int = REVISIT_FROM_BYTES) -> DataFrame:
    """Add digest, record type and the record referred to.

    Of records with equal payloads of ``smallest`` bytes or more the largest
    id is the response.  Repeated digests are counted with partial sums, so a
    payload that holds a third of all rows sends one row a task.  The repeated
    digests are stored first: Spark then knows their size and broadcasts them
    only below its own threshold, and joins by digest (splitting skewed ones)
    beyond it.
    """
    table = records.select(
        F.col("record_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= smallest
    repeated = (
        table.where(long_enough).groupBy("digest")
        .agg(F.count("*").alias("copies"), F.max("record_id").alias("response_id"))
        .where("copies > 1").select(F.col("digest").alias("same"), "response_id")
    )
    repeated = stored(repeated, "repeated-payloads")
    joined = table.join(repeated, (F.col("digest") == F.col("same")) & long_enough, "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("response_id"))
    return joined.select(
        "record_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"),
    )


def _identifier(record_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}/{digest}')}>"


def encode_record(row: dict, date: str) -> bytes:
    """One record as a gzip member with fixed header fields."""
    digest, payload = row["digest"], row["payload"]
    block = b"" if row["record_type"] == "revisit" else payload
    headers = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _identifier(row["record_id"], digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
        ("X-Payload-Length", str(len(payload))),
    ]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", "".join(c for c in row["url"] if c not in "\r\n")))
    if row["record_id"] is not None:
        headers.append(("X-Row-ID", str(row["record_id"])))
    if row["record_type"] == "revisit":
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _identifier(row["refers_to"], digest)),
            ("X-Refers-To-Row", str(row["refers_to"])),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, roll_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([("folder", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        members: list[bytes] = []
        size = rolled = 0

        def close() -> pa.RecordBatch:
            nonlocal members, size, rolled
            name = f"part-{part:06d}-{rolled:05d}.warc.gz"
            write_atomically(folder, name, lambda stream: [stream.write(m) for m in members])
            row = pa.record_batch([[folder], [name], [len(members)], [size]], schema=schema)
            members, size, rolled = [], 0, rolled + 1
            return row

        for batch in batches:
            for row in batch.to_pylist():
                member = encode_record(row, date)
                if members and size + len(member) > roll_bytes:
                    yield close()
                members.append(member)
                size += len(member)
        if members:
            yield close()

    return write


def write_archives(
    records: DataFrame, folder: str | None = None, range_bytes: int = 64 << 20, roll_bytes: int = 16 << 20,
    date: str = "2024-01-01T00:00:00Z", smallest_revisit: int = REVISIT_FROM_BYTES,
) -> DataFrame:
    """Archive (record_id, url, payload) rows; returns the stored manifest.

    ``range_bytes`` is the payload a range holds on average, ``roll_bytes`` the
    compressed size of a file (a single longer record makes a longer file).
    """
    spark = records.sparkSession
    folder = folder or shared_path(spark, "warc")
    total = records.agg(F.sum(F.octet_length(F.col("payload").cast("binary")))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, -(-total // range_bytes))
    typed = with_revisits(records, smallest_revisit)
    keys = ["record_id", "url", "digest"]
    ordered = typed.repartitionByRange(int(ranges), *keys).sortWithinPartitions(*keys)
    manifest = ordered.mapInArrow(_writer(folder, roll_bytes, date), MANIFEST_SCHEMA)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")


def parse_members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time; a member that does not end raises ValueError."""
    data = b""
    unpacker, parts, begun = zlib.decompressobj(31), [], False
    while True:
        if not data:
            data = stream.read(step)
            if not data:
                break
        begun = True
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data if unpacker.eof else b""
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("truncated archive")


def decode_record(member: bytes) -> dict:
    """The fields of a record; digests of the block are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    found = base64.b32encode(hashlib.sha1(block).digest()).decode()
    if fields["WARC-Block-Digest"] != f"sha1:{found}":
        raise ValueError("block digest differs")
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "record_id": number("X-Row-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Row"), "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "payload": None if revisit else block,
    }


def _reader(batch_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for entry in batch.to_pylist():
                rows, size, found = [], 0, 0
                with open_input(entry["folder"], entry["file"]) as stream:
                    if stream.size() != entry["bytes"]:
                        raise ValueError(f"{entry['file']} holds {stream.size()} bytes, its manifest says {entry['bytes']}")
                    for member in parse_members(stream):
                        rows.append(decode_record(member))
                        found += 1
                        size += len(member)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if found != entry["records"]:
                    raise ValueError(f"{entry['file']} holds {found} records, its manifest says {entry['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(manifest: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the files that the manifest names, spread by file.

    A file whose size or number of records differs from the manifest raises.
    """
    spread = spread_by_file(manifest.select("folder", "file", "records", "bytes"), "file")
    return spread.mapInArrow(_reader(batch_bytes), RECORD_SCHEMA)
