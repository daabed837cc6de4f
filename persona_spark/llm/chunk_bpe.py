"""BPE encoding by content-defined chunks: what documents share is encoded once, then the joins are repaired."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from persona_spark.llm.common import row_key
from persona_spark.llm.word_bpe import WordBpe, word_bpe
from persona_spark.scale import lookup_join

#: A chunk ends where the rolling hash of 16 characters has so many leading zero bits: every 256 characters on average.
ZERO_BITS = 8
#: Shorter chunks are encoded in place: looking them up costs more.
MIN_SHARED_CHARS = 48
#: Word starts kept at the head of an encoded chunk. Where none of them agrees, the chunk is encoded in place.
HEAD_WORDS = 8

_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunk_ends(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text: where they fall depends on the 16 characters before alone."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    h = (codes + np.uint64(1)) * np.uint64(_FACTOR)
    for step in (1, 2, 4, 8):
        weight = np.uint64(pow(_FACTOR, step, 1 << 64))
        h[step:] = h[step:] + h[:-step].copy() * weight if len(h) > step else h[step:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    ends = (np.flatnonzero(h >> np.uint64(64 - ZERO_BITS) == 0) + 1).tolist()
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return ends


def chunk_keys(text: str) -> list[tuple[int, int, bytes]]:
    """Start, end and 128-bit key of the chunks that are long enough to share."""
    start, out = 0, []
    for end in chunk_ends(text):
        if end - start >= MIN_SHARED_CHARS:
            out.append((start, end, xxhash.xxh3_128_digest(text[start:end].encode())))
        start = end
    return out


def encode_chunk(bpe: WordBpe, chunk: str) -> tuple[bytes, list[int], list[int], int, int]:
    """Ids, starts of the first words with the number of ids before each, and start of the last run between white space
    with the number of ids before it. What follows that start may read otherwise with more text behind it."""
    starts, counts, ids, tail = [], [], [], (0, 0)
    end = 0
    for word in bpe.word_starts(chunk):
        if len(starts) < HEAD_WORDS:
            starts.append(word.start())
            counts.append(len(ids))
        if word.start() > end:
            tail = (word.start(), len(ids))
        ids += bpe.encode_plain(word.group())
        end = word.end()
    return np.array(ids, bpe.id_type).tobytes(), starts, counts, *tail


def _last_white(text: str, start: int, end: int) -> int:
    """End of the last space or line break between two places, or `start`."""
    return max(text.rfind(" ", start, end), text.rfind("\n", start, end), start - 1) + 1


def encode_document(bpe: WordBpe, text: str, found: dict[bytes, tuple]) -> tuple[list[int], int]:
    """The ids of a text and how many came from shared chunks.

    Between shared chunks words are encoded in place. At a join the words are read on from the last place known to be
    right until one starts where a word of the chunk starts: from there both read the same, up to the chunk's last run
    between white space, where the next join begins. A chunk without such a word is encoded in place.
    """
    if not bpe.is_plain(text):
        return bpe.encode_whole(text), 0
    if not found:
        return bpe.encode_plain(text), 0
    low = text.lower()
    ids: list[int] = []
    done, reused = 0, 0
    for start, _, key in chunk_keys(text):
        record = found.get(key)
        if record is None or not record[1] or start + record[3] <= done:
            continue
        coded, starts, counts, tail_start, tail_count = record
        heads = dict(zip(starts, counts))
        cut = _last_white(low, done, start)
        window, agreed = [], None
        for word in bpe.words_from(low, cut):
            at = word.start() - start
            if at >= 0 and at in heads and heads[at] <= tail_count:
                agreed = at
                break
            if at > starts[-1]:
                break
            window.append(word.group())
        if agreed is None:
            continue
        ids += bpe.encode_lowered(low[done:cut])
        for word in window:
            ids += bpe.encode_lowered(word)
        shared = np.frombuffer(coded, bpe.id_type)[heads[agreed] : tail_count]
        ids += shared.tolist()
        reused += len(shared)
        done = max(start + tail_start, start + agreed)
    ids += bpe.encode_lowered(low[done:])
    return ids, reused


def _plain_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, str]]:
    for batch in batches:
        for i, value in enumerate(batch.column(batch.num_columns - 1)):
            text = value.as_py()
            if text and WordBpe.is_plain(text):
                yield batch, i, text


def chunk_texts(docs: DataFrame, with_texts: bool) -> DataFrame:
    """Chunks of all documents: key and either the chunk's text, once per task, or the document's `_id`."""

    def of_documents(batches):
        for batch in batches:
            rows, keys = [], []
            for _, i, text in _plain_texts([batch]):
                for key in {k for _, _, k in chunk_keys(text)}:
                    rows.append(i)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(keys, pa.binary())], ["_id", "key"]
            )

    def of_texts(batches):
        seen = set()
        for batch in batches:
            keys, texts = [], []
            for _, _, text in _plain_texts([batch]):
                for start, end, key in chunk_keys(text):
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        texts.append(text[start:end])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["key", "chunk"])

    if with_texts:
        return docs.select("_text").mapInArrow(of_texts, "key binary, chunk string")
    return docs.select("_id", "_text").mapInArrow(of_documents, f"_id {docs.schema['_id'].dataType.simpleString()}, key binary")


_RECORD = "ids binary, starts array<int>, counts array<int>, tail_start int, tail_count int"


def encode_shared(docs: DataFrame, vocabulary: str | None) -> tuple[DataFrame, DataFrame]:
    """The shared chunks, each encoded once, and the documents that hold them: (key, record) and (_id, key)."""
    places = chunk_texts(docs, with_texts=False)
    shared = places.groupBy("key").count().filter("count > 1").select("key")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            records = [encode_chunk(bpe, c.as_py()) for c in batch.column(1)]
            parts = list(zip(*records)) if records else [[]] * 5
            kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p, t) for p, t in zip(parts, kinds)]],
                ["key", "ids", "starts", "counts", "tail_start", "tail_count"],
            )

    texts = lookup_join(chunk_texts(docs, with_texts=True), shared, ["key"], "left_semi", stage=True)
    coded = texts.dropDuplicates(["key"]).mapInArrow(encode, f"key binary, {_RECORD}")
    holders = lookup_join(places, shared, ["key"], "left_semi", stage=True)
    return coded, holders.dropDuplicates(["_id", "key"])


def chunk_bpe(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every row encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256, n_reused (and ids).

    Null text is empty. Ids may be null or repeated, and repeated rows are each encoded; a row is known by its id and
    a hash of its text. Other columns are left out. Texts that are not plain (see `WordBpe`) are encoded whole.
    Chunks that lie in two documents, or twice in one, are shared: their keys are counted first, and only their
    texts are moved, encoded once and brought to the documents that hold them. Texts are moved once, compressed.
    """
    keyed = docs.select(
        row_key(text).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    )
    coded, holders = encode_shared(keyed, vocabulary)
    records = (
        holders.join(coded, "key")
        .groupBy("_id")
        .agg(F.collect_list(F.struct("key", "ids", "starts", "counts", "tail_start", "tail_count")).alias("records"))
    )

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([squeeze(t.as_py().encode()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["_id", "packed"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = [[] for _ in range(6 if keep_ids else 5)]
            for i in range(batch.num_rows):
                records = batch.column(2)[i].as_py() or ()
                found = {
                    r["key"]: (r["ids"], r["starts"], r["counts"], r["tail_start"], r["tail_count"]) for r in records
                }
                ids, reused = encode_document(bpe, unpack(batch.column(1)[i].as_py()).decode(), found)
                row = [
                    batch.column(0)[i].as_py()["doc_id"],
                    len(ids),
                    hashlib.sha256(bpe.numbers(ids).encode()).hexdigest(),
                    hashlib.sha256(bpe.decode(ids).encode()).hexdigest(),
                    reused,
                ]
                for column, value in zip(out, row + [ids] * keep_ids):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_reused", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names[: len(out)])

    kind = keyed.schema["_id"].dataType.simpleString()
    packed = keyed.mapInArrow(compress, f"_id {kind}, packed binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_reused long"
    return packed.join(records, "_id", "left").select("_id", "packed", "records").mapInArrow(
        encode, schema + (", ids array<int>" if keep_ids else "")
    )
