"""Folders of log files as a table of numbered lines."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from persona_spark.scale import lookup_join
from persona_spark.session import stage_table


def log_read(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """(file, line_no, line, modified) of all lines, numbered from 1.

    A file may be read in many splits. Rows carry a running number from the scan; the first one and
    the row count of each split give the number at which its lines start. Only these figures, one
    row per split, are grouped by file, and they are small enough to send to the lines. The lines are
    written down once with their numbers, since a second reading may be split in another way.
    """
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("value").alias("line"),
            F.monotonically_increasing_id().alias("_no"),
        )
    )
    # Numbers and lines must come from one reading: another one may cut the files into other splits.
    scan = stage_table(lines, "log-lines")
    splits = scan.groupBy("_path", "_block").agg(F.min("_no").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "_path", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return lookup_join(scan, starts, ["_path", "_block"], spread=["_no"], stage=True).select(
        "file", (F.col("_no") + F.col("_shift")).alias("line_no"), "line", "modified"
    )
