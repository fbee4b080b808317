"""Token ids as length-delimited binary records, with a separate offset index (operator 2).

A shard is two files in the shared folder. ``*.rec`` holds one frame per document, in ascending doc_id order:
    length of the payload u64 | masked crc32 of those 8 bytes u32 | payload | masked crc32 of the payload u32
with the payload: doc_id i64 | number of ids u32 | ids as u16 or u32 (all little-endian). ``*.idx`` holds, per
frame, doc_id i64 and the frame's offset u64, so that a reader can take frames in any order. The mask is a
rotation by 15 bits plus a constant, as in other record formats; the checksum is zlib's CRC-32, which Python
computes natively (CRC-32C it does not).

Defined cases: a null text is an empty one (only the end id); rows with the same doc_id stay rows of their own,
in the order of their texts' first HEAD characters, then hashes; a null doc_id comes first and is written as the smallest i64; an empty table gives
no shards; other columns aren't read. Texts are processed whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices, scratch, texts_of
from tracelode.llm.tokens import encoder
from tracelode.operators.ordered import bucketed

NO_ID = -(2**63)
MASK_DELTA = 0xA282EAD8
#: Bytes of text per shard, and the most shards (their bounds are one array); characters that order rows of one doc_id.
SHARD_BYTES, MOST_SHARDS, HEAD = 128_000_000, 10_000, 64
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def unframe(read, where: str) -> bytes | None:
    """The next payload from read(n), None at the end; a wrong checksum or a short frame raises."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"{where}: damaged length")
    (n,) = struct.unpack("<Q", head[:8])
    payload, check = read(n), read(4)
    if len(payload) < n or len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
        raise ValueError(f"{where}: damaged record")
    return payload


def filesystem(uri: str):
    """pyarrow's file system for a path of the shared folder (file, hdfs, s3, gs ...), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, dtype: str = "<u2", text: str = "text") -> list[dict]:
    """Writes docs (doc_id, text) as shards below out; returns a row per shard, in ascending order of doc_id.

    Texts are encoded where they lie; one shuffle takes the ids, by range of (doc_id, beginning and hash of the text), to
    a task per shard. There are as many shards as the bytes of all texts ask for, whatever the session's partitions are,
    and the rows of one doc_id can be in several. Each task writes under a name of its own, so that one that runs again leaves no
    half-written shard in the list.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = min(MOST_SHARDS, max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, dtype), np.array([end_id], dtype).tobytes()
        for batch, _ in in_slices(batches, text):
            ids = pa.array([row.tobytes() + end for row in enc.encode(batch.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "head", "tie", "shard")), ids], ["doc_id", "head", "tie", "shard", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        width = np.dtype(dtype).itemsize
        at = tokens = docs_here = 0
        rec = idx = None
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if rec is None:
                    fs, base = filesystem(out)
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/shard-{part:06d}-{uuid.uuid4().hex}"
                    rec, idx = fs.open_output_stream(f"{name}.rec"), fs.open_output_stream(f"{name}.idx")
                doc_id, n = NO_ID if doc_id is None else doc_id, len(raw) // width
                data = frame(struct.pack("<qI", doc_id, n) + raw)
                rec.write(data)
                idx.write(struct.pack("<qQ", doc_id, at))
                at, tokens, docs_here = at + len(data), tokens + n, docs_here + 1
        if rec is not None:
            rec.close()
            idx.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs_here]), pa.array([tokens])], ["part", "path", "n_docs", "n_tokens"])

    order = [F.coalesce(F.col("doc_id"), F.lit(NO_ID)), F.col("head"), F.col("tie")]
    rows = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"), text=text).withColumns({"head": F.substring(text, 1, HEAD), "tie": F.xxhash64(text)})
    rows = bucketed(rows, order, shards).withColumn("shard", F.least("__b", F.lit(shards - 1))).drop("__b")
    ids = rows.mapInArrow(encode, "doc_id long, head string, tie long, shard int, ids binary").repartitionById(shards, "shard").sortWithinPartitions(*order, "ids")
    written_ = ids.mapInArrow(write, "part int, path string, n_docs long, n_tokens long").collect()  # a row per shard
    return [r.asDict() for r in sorted(written_, key=lambda r: r.part)]


def read_shard(path: str, dtype: str = "<u2") -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard, in its order; lengths, checksums and the index are verified."""
    fs, base = filesystem(path)
    with fs.open_input_stream(f"{base}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    at = 0
    with fs.open_input_stream(f"{base}.rec", buffer_size=1 << 20) as rec:
        for want, offset in index.tolist():
            if offset != at or (payload := unframe(rec.read, base)) is None:
                raise ValueError(f"{base}: index and records differ at byte {at}")
            doc_id, n = struct.unpack_from("<qI", payload)
            ids = np.frombuffer(payload, dtype, offset=12)
            if doc_id != want or n != len(ids):
                raise ValueError(f"{base}: damaged record of {want}")
            yield (None if doc_id == NO_ID else doc_id), ids
            at += len(payload) + 16
        if rec.read(1):
            raise ValueError(f"{base}: records after the index ends")


def read_records(spark: SparkSession, shards: list[dict], dtype: str = "<u2") -> DataFrame:
    """A row per document from the shards' files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as u32)."""
    starts = np.cumsum([0] + [s["n_tokens"] for s in shards]).tolist()
    todo = [(s["path"], start) for s, start in zip(shards, starts, strict=False)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                path, start = todo[i]
                rows: list[tuple] = []
                for doc_id, ids in read_shard(path, dtype):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(todo), 1, max(1, len(todo))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the token ids of docs and reads them back: see read_records."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, scratch(spark, "token-records"), tokenizer, end_id))
