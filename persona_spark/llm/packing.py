"""Best-fit packing by minimum bin slack: the fullest combination of lengths, found by subset sums, is taken again
and again. It is worked out on the histogram of lengths, which never has more entries than a sequence has tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from persona_spark.llm.word_bpe import word_bpe
from persona_spark.session import stage_table

MAX_TOKENS = 2048
#: Token put behind every document.
END_ID = 0
END_BYTES = END_ID.to_bytes(4, "little")
#: Pieces of one length are numbered within buckets of about so many pieces of any length, at most so many buckets.
PIECES_PER_BUCKET = 5_000
MAX_BUCKETS = 4_096


def split_pieces(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    vocabulary: str | None = None,
    keep_ids: bool = False,
    text: str = "text",
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids). Encoded where the text is read."""
    import zlib

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            all_ids = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode_bytes(body or "") + END_BYTES
                for piece, start in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[start : start + 4 * max_tokens]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(piece)
                    rows["start"].append(start // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        all_ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [
                pa.array(rows[k], pa.int32() if k == "piece" else pa.int64()) for k in rows
            ]
            names = list(rows)
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<int>" if keep_ids else ""
    )
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(encode, schema)


def slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many}) of bins that use up all `counts`.

    Each bin holds the largest length left and, of the lengths left, the combination with the largest sum
    that fits: bit s of a whole number says that s can be reached. A combination is used as often as the counts allow,
    so the work grows with the number of different lengths, not with the number of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    patterns = []
    order = sorted(left, reverse=True)
    while order:
        anchor = order[0]
        room = capacity - anchor
        within = (1 << (room + 1)) - 1
        reached, steps = 1, []
        for length in order:
            if length > room:
                continue
            most = min(left[length] - (length == anchor), room // length)
            step = 1
            while most > 0:
                some = min(step, most)
                steps.append((length, some, reached))
                reached |= (reached << (length * some)) & within
                most -= some
                step *= 2
            if reached >> room & 1:
                break
        rest = reached.bit_length() - 1
        pattern = {anchor: 1}
        for length, some, before in reversed(steps):
            if not before >> rest & 1:
                rest -= length * some
                pattern[length] = pattern.get(length, 0) + some
        times = min(left[length] // n for length, n in pattern.items())
        patterns.append((times, pattern))
        for length, n in pattern.items():
            left[length] -= times * n
        order = [length for length in order if left[length]]
    return patterns


def _places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Per pattern and length: length, first rank, how many a bin, first bin, offset in the bin; sorted."""
    rows, used, bin_no = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length, n in pattern.items():
            rows.append((length, used.get(length, 0), n, bin_no, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        bin_no += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = MAX_TOKENS) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`: sequences of at most `capacity` tokens, gapless from 0.

    The driver sees the histogram of lengths alone, at most `capacity` rows. Pieces are numbered within their length:
    first inside buckets of a hash, then by adding the totals of the buckets before; so a length that owns a
    third of all pieces is dealt out over many tasks. A number leads to a bin by a look at a small sorted table.
    """
    staged = stage_table(pieces, "pieces")
    counts = {r.length: r.n for r in staged.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    buckets = min(MAX_BUCKETS, total // PIECES_PER_BUCKET + 1)
    table = _places(slack_patterns(counts, capacity))
    shift = np.int64(40)
    keys = (table[:, 0] << shift) + table[:, 1]

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rest = [c for c in staged.columns if c not in columns]
    dealt = staged.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(buckets)))
    # Equal pieces of one document share a hash; a bucket takes them in any order, as they are equal.
    inside = W.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    totals = dealt.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = (
        dealt.withColumn("_in", F.row_number().over(inside))
        .join(starts, ["_bucket", "length"])
        .select(*columns, *rest, (F.col("_before") + F.col("_in") - 1).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            row = table[np.searchsorted(keys, (length << shift) + rank, side="right") - 1] if len(table) else table
            k = rank - row[:, 1]
            out = [batch.column(i) for i in range(batch.num_columns - 1)]
            out += [pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank"
    )
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def best_fit_packing(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    vocabulary: str | None = None,
    keep_ids: bool = False,
    text: str = "text",
) -> DataFrame:
    """One row per piece of `docs`, placed: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null text is empty and holds the end token alone. Only documents over `max_tokens` are cut. Ids may be
    null or repeated: every row is packed. Other columns are left out; an empty table gives no pieces.
    """
    return pack(split_pieces(docs, max_tokens, vocabulary, keep_ids, text), max_tokens)
