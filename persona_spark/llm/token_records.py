"""Token ids as length-delimited binary records: every serialized sequence is framed by its length and masked checksums, and
an index of offsets beside the files serves reads in any order.

A frame is: length of the payload (8 bytes), masked checksum of these bytes (4), payload, masked checksum of the payload
(4), a newline. All numbers are little-endian. A block is a header frame (magic, width of an id, shard, block, number of
records) and one frame per document (whether the id is there, the id, token ids); a file is a row of blocks. Shards, the
blocks in them and the records in those ascend by document id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from persona_spark.llm.byte_bpe import byte_bpe
from persona_spark.prefix import prefix_sums
from persona_spark.scale import lookup_join
from persona_spark.session import fresh_path

#: Token put behind every document.
END_ID = 0
MAGIC = b"TOKREC01"
HEADER = struct.Struct("<8sHIII")
LENGTH = struct.Struct("<Q")
CHECK = struct.Struct("<I")
PREFIX = struct.Struct("<Bq")
FRAME_BYTES = LENGTH.size + 2 * CHECK.size + 1
HEADER_BYTES = HEADER.size + FRAME_BYTES
#: A block holds about so many bytes, a file so many blocks; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
BLOCKS_PER_FILE = 16
#: Text in a shard, about.
SHARD_BYTES = 128 << 20

INDEX = "file string, shard bigint, block bigint, record bigint, doc_id bigint, offset bigint, length bigint, n_tokens bigint"


class BrokenRecord(ValueError):
    """A file of records that does not hold what was written."""


def masked(data: bytes | memoryview) -> int:
    """Checksum, turned and shifted, so that data which holds checksums has others than these."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """Without the newline."""
    length = LENGTH.pack(len(payload))
    return b"".join((length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload))))


def header_frame(width: int, shard: int, block: int, n: int) -> bytes:
    return frame(HEADER.pack(MAGIC, width, shard, block, n))


def record_frame(doc_id: int | None, ids: bytes) -> bytes:
    return frame(PREFIX.pack(doc_id is not None, doc_id or 0) + ids)


def payload_at(data: memoryview, offset: int, verify: bool = True) -> memoryview:
    head = data[offset : offset + LENGTH.size]
    start = offset + LENGTH.size + CHECK.size
    if len(data) < start or CHECK.unpack_from(data, start - CHECK.size)[0] != masked(head):
        raise BrokenRecord(f"no length at byte {offset}")
    stop = start + LENGTH.unpack(head)[0]
    if len(data) < stop + CHECK.size:
        raise BrokenRecord(f"the record at byte {offset} is cut off")
    payload = data[start:stop]
    if verify and CHECK.unpack_from(data, stop)[0] != masked(payload):
        raise BrokenRecord(f"wrong checksum of the record at byte {offset}")
    return payload


def records_of(data: memoryview, verify: bool = True) -> Iterator[tuple[int, int, int, int, int, memoryview]]:
    """(shard, block, record, offset, width, payload) of all records of a file."""
    offset = 0
    while offset < len(data):
        header = payload_at(data, offset)
        if len(header) != HEADER.size or header[: len(MAGIC)] != MAGIC:
            raise BrokenRecord(f"no block at byte {offset}")
        _, width, shard, block, n = HEADER.unpack(header)
        offset += len(header) + FRAME_BYTES
        for record in range(n):
            payload = payload_at(data, offset, verify)
            yield shard, block, record, offset, width, payload
            offset += len(payload) + FRAME_BYTES


def width_of(data: memoryview) -> int:
    """The width of an id, from the first block of a file."""
    return HEADER.unpack(payload_at(data, 0))[1]


def unpacked(payload: memoryview, width: int) -> tuple[int | None, np.ndarray]:
    there, doc_id = PREFIX.unpack_from(payload)
    return doc_id if there else None, np.frombuffer(payload, f"<u{width}", offset=PREFIX.size)


def write_records(docs: DataFrame, folder: str, vocabulary: str | None = None, text: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> None:
    """Write `folder`/data and its index. Texts are moved once, into ranges of ids; they are encoded where they arrive, block
    by block, and Spark's own writer commits the files, so that a task that is repeated leaves one copy.

    Equal ids are in the order of a hash of their texts, null ids come first. A null text counts as empty.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        shard = TaskContext.get().partitionId()
        block, frames, held = 0, [], 0

        def out() -> pa.RecordBatch:
            header = header_frame(bpe.width, shard, block, len(frames))
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join((header, *frames))], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(body.as_py() or "")
                ids.append(END_ID)
                frames.append(record_frame(doc_id, bpe.serialize(ids)))
                held += len(frames[-1])
                if held >= block_bytes:
                    yield out()
                    block, frames, held = block + 1, [], 0
        if frames:
            yield out()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-size // shard_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", F.xxhash64("text")]
    blocks = narrow.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(encode, "value binary")
    # A cast of bytes to a string changes none of them.
    blocks.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{folder}/data")
    _scan(spark, folder, _index_rows, INDEX).write.parquet(f"{folder}/index")


def _scan(spark: SparkSession, folder: str, rows, schema: str) -> DataFrame:
    """`rows` (of a file's name and bytes, giving tuples) over all files, read by Spark, so that any of its stores will do."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in schema.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                found = list(rows(path.as_py(), memoryview(content.as_buffer())))
                yield pa.RecordBatch.from_arrays([pa.array(c, types.field(k).type) for k, c in zip(names, zip(*found))] if found else [pa.array([], t) for t in types.types], schema=types)

    return spark.read.format("binaryFile").load(f"{folder}/data").select("path", "content").mapInArrow(parse, schema)


def _index_rows(path: str, data: memoryview) -> Iterator[tuple]:
    for shard, block, record, offset, width, payload in records_of(data, verify=False):
        doc_id, ids = unpacked(payload, width)
        yield path, shard, block, record, doc_id, offset, len(payload), len(ids)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(file, shard, block, record, doc_id, offset, length, n_tokens) of every record."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def starts(index: DataFrame) -> DataFrame:
    """(shard, block, before): the tokens in all earlier blocks."""
    totals = index.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    return prefix_sums(totals, [], ["shard", "block"], "n").select("shard", "block", "before")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, block, record, doc_id, inside, n_tokens, ids_crc32) of every record read back; `inside` counts the tokens before
    it in its block. A frame that does not hold what was written ends the job."""

    def rows(path: str, data: memoryview) -> Iterator[tuple]:
        at, inside = None, 0
        for shard, block, record, _, width, payload in records_of(data):
            doc_id, ids = unpacked(payload, width)
            if at != (shard, block):
                at, inside = (shard, block), 0
            yield shard, block, record, doc_id, inside, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
            inside += len(ids)

    kinds = "shard bigint, block bigint, record bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    return _scan(spark, folder, rows, kinds)


def read_at(index: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records of an index, or of any of its rows, in their order: each is read by its offset. Needs a
    folder that Arrow's file systems reach; `index` may be shuffled and cut as a reader likes."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from pyarrow import fs

        opened: dict[str, tuple] = {}
        for batch in batches:
            ids, found = [], []
            for uri, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if uri not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened)))[0].close()
                    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                    file = system.open_input_file(path)
                    opened[uri] = file, width_of(memoryview(file.read_at(HEADER_BYTES, 0)))
                file, width = opened[uri]
                data = file.read_at(length + FRAME_BYTES, offset)
                doc_id, tokens = unpacked(payload_at(memoryview(data), 0), width)
                ids.append(doc_id)
                found.append(tokens.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return index.select("file", "offset", "length").mapInArrow(fetch, "doc_id bigint, ids array<int>")


def token_records(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None, text: str = "text") -> DataFrame:
    """Write `docs` as records and read them back: doc_id, start, n_tokens, ids_crc32 of every row, also repeated ones.

    Null and empty texts are the end token alone. Columns other than doc_id and the text play no part; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "records")
    write_records(docs, folder, vocabulary, text)
    before = starts(read_index(spark, folder))
    return lookup_join(read_digests(spark, folder), before, ["shard", "block"], stage=True).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
