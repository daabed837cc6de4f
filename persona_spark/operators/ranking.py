"""Orders and top lists."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from persona_spark.functions import pages as P
from persona_spark.functions import values as V
from persona_spark.functions.text import iso_text
from persona_spark.scale import lookup_join, whole_div
from persona_spark.session import stage_table

LINES_PER_BUCKET = 65_536


def display_order(pages: DataFrame, by: Sequence[str] = ("persona_id",)) -> DataFrame:
    """(by, id, ingest_pos, display_rank): newest first, undated last, ties in order of arrival.

    The keys are written down, as sorting reads them twice, and sorted once over all groups, so a
    group of any size is spread over many tasks. The sorted keys get a running number; the rank is
    that number less the one at which the group starts in its part, plus the group's rows in
    earlier parts.
    """
    by = list(by)
    at = P.created_instant(iso_text(pages, "created_time")).alias("_at")
    keys = stage_table(pages.select(*by, "id", "ingest_pos", at), "display-keys")
    ordered = stage_table(
        keys.orderBy(*by, F.desc_nulls_last("_at"), "ingest_pos", "id")
        .withColumn("_no", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_no", 33))
        .drop("_at"),
        "display-order",
    )
    group = [*by, "_part"]
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy(*group)
        .agg(F.min("_no").alias("_first"), F.count("*").alias("_n"))
        .select(*group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    return ordered.join(starts, group).select(
        *by, "id", "ingest_pos", (F.col("_no") + F.col("_shift")).alias("display_rank")
    )


def label_lookup(pages: DataFrame) -> DataFrame:
    """(persona_id, label, id). Of equal labels the last in display order counts. `pages` has label,
    created_time and ingest_pos."""
    at = P.created_instant(iso_text(pages, "created_time"))
    last = F.struct(at.isNull(), -F.unix_micros(at), F.col("ingest_pos"), F.col("id"))
    return pages.groupBy("persona_id", "label").agg(F.max_by("id", last).alias("id"))


def log_tail(log_lines: DataFrame, n: int = V.LOG_TAIL_LINES, per_bucket: int = LINES_PER_BUCKET) -> DataFrame:
    """The last `n` lines of every file, and whether earlier ones were cut.

    Line numbers are unique per file. Buckets of line numbers are counted first, so that only the
    buckets at the end of a file are read in full, whatever its size.
    """
    lines = log_lines.withColumn("_bucket", whole_div(F.col("line_no"), per_bucket))
    counts = lines.groupBy("file", "_bucket").agg(F.count("*").alias("_n"))
    later = (
        Window.partitionBy("file").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = (
        counts.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .withColumn("truncated", F.sum("_n").over(Window.partitionBy("file")) > n)
        .where(F.col("_after") < n)
        .drop("_n")
    )
    from_end = Window.partitionBy("file", "_bucket").orderBy(F.desc("line_no"))
    return (
        lookup_join(lines, ends, ["file", "_bucket"], spread=["line_no"], stage=True)
        .withColumn("_from_end", F.row_number().over(from_end) + F.col("_after"))
        .where(F.col("_from_end") <= n)
        .drop("_bucket", "_after", "_from_end")
    )


def newest_log(log_lines: DataFrame, k: int | None = None, modified: str = "modified") -> DataFrame:
    """Files by time of change, newest first; with `k` only that many, with 1 the default choice."""
    files = log_lines.groupBy("file").agg(F.max(modified).alias("modified"))
    ordered = files.orderBy(F.desc("modified"), "file")
    return ordered if k is None else ordered.limit(k)
