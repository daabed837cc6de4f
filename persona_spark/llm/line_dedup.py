"""Line dedup: range-partitioned line hashes in, compressed keep bitmaps per document out. Texts stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from persona_spark.llm.common import lower_ascii, nested, row_key, strip_white, unnested
from persona_spark.scale import lookup_join

#: A key found in at least this many documents loses its lines, if it has at least so many code points.
MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Rows of one key are dealt out over so many ranges, by a hash of the document.
SALTS = 4096


def lines_of(text: str) -> Column:
    r"""The lines of a text, cut at \n alone; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """What makes two lines the same: white space at both ends and the case of A-Z do not count."""
    return lower_ascii(strip_white(line))


def line_positions(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Document, position and 128-bit hash of every line that counts, each document's equal rows once."""
    return (
        docs.select(row_key(text).alias("_id"), F.posexplode_outer(lines_of(text)).alias("_pos", "_line"))
        .select("_id", "_pos", line_key(F.col("_line")).alias("_key"))
        .filter(F.length("_key") >= min_chars)
        .select("_id", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )


def first_occurrences(lines: DataFrame) -> DataFrame:
    """Lines sorted by hash, document and position, with `_first` on the first of each document in a key.

    The sort is a range partition on hash and salt: a key that owns a third of all lines is dealt out over up to
    `SALTS` ranges. All lines of one document and key share a salt, so they lie side by side in one range and the
    first is known by looking at the row before. No window crosses documents, and none is sorted twice.
    """
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = salted.repartitionByRange(parts, "_h1", "_h2", "_salt").sortWithinPartitions(
        "_h1", "_h2", "_salt", "_id", "_pos"
    )
    along = W.partitionBy("_h1", "_h2", "_salt").orderBy("_id", "_pos")
    before = F.lag("_id").over(along)
    return ranged.withColumn("_first", ~F.coalesce(before == F.col("_id"), F.lit(False)))


def keep_bitmaps(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    keep_first: bool = False,
    text: str = "text",
) -> DataFrame:
    """Per document that loses lines, its keep bitmap as runs: `_id` and `dropped` array<struct<from,to>>.

    A document is known by its id, which may be null, and a hash of its text; equal rows are one document. Lines of
    keys found in at least `min_documents` documents go; with `keep_first` the first line of each, by document and
    position, stays. Only hashes and positions are shuffled. Counts per key are summed on the map side of their
    shuffle, so a key in every document costs no more than others; the table of frequent keys is broadcast behind a
    size check or else joined with its hot keys salted.
    """
    lines = line_positions(docs, text, min_chars)
    seen = first_occurrences(lines)
    frequent = (
        seen.groupBy("_h1", "_h2")
        .agg(
            F.count(F.when(F.col("_first"), 1)).alias("_n"),
            F.min(F.struct("_id", "_pos")).alias("_where"),
        )
        .filter(F.col("_n") >= min_documents)
    )
    hit = lookup_join(lines, frequent, ["_h1", "_h2"], "inner", spread=["_id", "_pos"], stage=True)
    if keep_first:
        hit = hit.filter(F.struct("_id", "_pos") != F.col("_where"))
    gone = hit.groupBy("_id").agg(F.sort_array(F.collect_set("_pos")).alias("_gone"))
    starts = "filter(_gone, (p, i) -> i = 0 OR _gone[i - 1] < p - 1)"
    ends = "filter(_gone, (p, i) -> i = size(_gone) - 1 OR _gone[i + 1] > p + 1)"
    return gone.select(
        "_id", F.expr(f"zip_with({starts}, {ends}, (a, b) -> struct(a AS from, b AS to))").alias("dropped")
    )


def line_dedup(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    keep_first: bool = False,
    text: str = "text",
) -> DataFrame:
    """All rows and columns of `docs`, `text` without the lines that go, and what was done in `_lines`
    (with more underscores if that name is taken): `n_lines`, `n_dropped` and the runs `dropped`.

    The bitmaps are staged and meet the texts in one join: broadcast behind a size check, a shuffle beyond it. A null
    text that loses nothing stays null. Repeated rows lose the same lines each and count as one document.
    """
    bitmaps = keep_bitmaps(docs, min_documents, min_chars, keep_first, text)
    report = "_lines"
    while report in docs.columns:
        report += "_"
    rows = docs.select(nested(docs), row_key(text).alias("_id"), lines_of(text).alias("_split"))
    joined = lookup_join(rows, bitmaps, ["_id"], "left", stage=True)
    kept = F.expr(
        "array_except(sequence(0, size(_split) - 1), flatten(transform(dropped, r -> sequence(r.from, r.to))))"
    )
    left = F.concat_ws("\n", F.transform("_kept", lambda i: F.get("_split", i)))
    whole = F.col("_kept").isNull()
    return joined.withColumn("_kept", F.when(F.col("dropped").isNotNull(), kept)).select(
        *unnested(docs, **{text: F.when(whole, F.col(f"_row.{text}")).otherwise(left)}),
        F.struct(
            F.size("_split").cast("bigint").alias("n_lines"),
            F.when(whole, F.lit(0)).otherwise(F.size("_split") - F.size("_kept")).cast("bigint").alias("n_dropped"),
            F.coalesce("dropped", F.array().cast("array<struct<from:int,to:int>>")).alias("dropped"),
        ).alias(report),
    )
