"""Length-delimited binary files of token ids with an offset index.

A record is: payload length (unsigned 64 bit, little endian), masked checksum
of those eight bytes, payload, masked checksum of the payload.  The payload is
the record's id (signed 64 bit; the smallest value stands for null), the bytes
of a token id (one byte: 2 where the vocabulary allows, else 4) and the token
ids (unsigned, of that width).  Checksums are CRC-32, rotated right by 15 bits
plus a constant, so that a checksum stored among data is not its own checksum.
The index has a row per record: file, byte offset, byte length, id, tokens;
readers can take any rows of it in any order.

Defined cases: a null text is an empty one and gives the end id alone; null
ids come first; equal ids stay separate records (ordered by text); an empty
table gives no file and an empty index; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscan.llm.storage import open_input, shared_path, spread_by_file, write_atomically
from termscan.llm.tokens import encoder, narrowed, widened

INDEX_SCHEMA = "folder string, file string, part int, row long, position long, bytes long, doc_id long, n_tokens long"
READ_SCHEMA = "file string, row long, doc_id long, ids binary"
NULL_ID = -(1 << 63)
HEAD = struct.Struct("<QI")
RECORD_HEAD = "<qB"
MASK = 0xA282EAD8
PACK_BYTES = 8 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))])


def unframe(data: bytes) -> bytes:
    """The payload of one framed record; a wrong length or checksum raises."""
    size, check = HEAD.unpack_from(data)
    if masked_crc(data[:8]) != check or len(data) != size + 16:
        raise ValueError("record length is damaged")
    payload = data[12:-4]
    if struct.pack("<I", masked_crc(payload)) != data[-4:]:
        raise ValueError("record payload is damaged")
    return payload


def _writer(folder: str, path: str, words: bool, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"tokens-{part:06d}.rec"
        index: list[dict] = []
        codes = encoder(path, words)
        width = codes.width
        end = end_id.to_bytes(width, "little")

        def produce(stream) -> None:
            position = 0
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    piece = batch.slice(start, 512)
                    framed = []
                    for doc_id, ids in zip(piece.column(0).to_pylist(), codes.encode(piece.column(1).to_pylist())):
                        head = struct.pack(RECORD_HEAD, NULL_ID if doc_id is None else doc_id, width)
                        record = frame(b"".join([head, narrowed(ids, width), end]))
                        index.append({
                            "folder": folder, "file": name, "part": part, "row": len(index), "position": position,
                            "bytes": len(record), "doc_id": doc_id, "n_tokens": len(ids) // 4 + 1,
                        })
                        framed.append(record)
                        position += len(record)
                    stream.write(b"".join(framed))

        write_atomically(folder, name, produce)
        schema = pa.schema([
            ("folder", pa.string()), ("file", pa.string()), ("part", pa.int32()), ("row", pa.int64()),
            ("position", pa.int64()), ("bytes", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
        ])
        for start in range(0, len(index), 10_000):
            yield pa.RecordBatch.from_pylist(index[start : start + 10_000], schema)

    return write


def write_records(
    documents: DataFrame, path: str, end_id: int, words: bool = True, folder: str | None = None, file_bytes: int = 32 << 20
) -> DataFrame:
    """Encode (doc_id, text) into record files in the order of ``doc_id``; returns the stored index.

    ``file_bytes``: text per file on average.  A file is written by one task as
    it encodes, so no more than a batch is held.
    """
    spark = documents.sparkSession
    folder = folder or shared_path(spark, "records")
    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = int(max(spark.sparkContext.defaultParallelism, -(-total // file_bytes)))
    ordered = table.repartitionByRange(files, "doc_id", F.crc32(F.col("text").cast("binary")))
    ordered = ordered.sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")), "text")
    index = ordered.mapInArrow(_writer(folder, path, words, end_id), INDEX_SCHEMA)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def with_start(index: DataFrame) -> DataFrame:
    """Add ``start``: tokens of all records before, in file and row order.

    Only one sum per file is put in order; rows are summed within their file.
    """
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("part").alias("_part"), F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_start0"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = index.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    joined = rows.join(files, F.col("part") == F.col("_part"))
    return joined.withColumn("start", F.col("_start0") + F.col("_within")).select(*index.columns, "start")


def _reader(batch_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
        opened = (None, None)
        rows, size = [], 0
        for batch in batches:
            for entry in batch.to_pylist():
                key = (entry["folder"], entry["file"])
                if opened[0] != key:
                    if opened[1] is not None:
                        opened[1].close()
                    opened = (key, open_input(*key))
                opened[1].seek(entry["position"])
                payload = unframe(opened[1].read(entry["bytes"]))
                doc_id, width = struct.unpack_from(RECORD_HEAD, payload)
                ids = widened(payload[struct.calcsize(RECORD_HEAD) :], width)
                rows.append({
                    "file": entry["file"], "row": entry["row"],
                    "doc_id": None if doc_id == NULL_ID else doc_id, "ids": ids,
                })
                size += len(ids)
                if size >= batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if opened[1] is not None:
            opened[1].close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_records(index: DataFrame, batch_bytes: int = PACK_BYTES) -> DataFrame:
    """``file, row, doc_id, ids`` (32 bits each) of the index rows given, a task per file."""
    wanted = spread_by_file(index.select("folder", "file", "row", "position", "bytes"), "file", "position")
    return wanted.mapInArrow(_reader(batch_bytes), READ_SCHEMA)
