"""From raw note pages to memories."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from persona_spark.functions import pages as P
from persona_spark.functions import values as V
from persona_spark.functions.text import has_text, iso_text


def object_split(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries as (pages, databases)."""
    return entries.where(F.col("object") == "page"), entries.where(F.col("object") == "database")


def union_pages(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Batches one after the other, duplicates kept, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), more, first)


def flatten_blocks(pages: DataFrame, blocks: str = "_blocks", into: str = "content") -> DataFrame:
    return pages.withColumn(into, P.block_text(F.col(blocks)))


def display_title(pages: DataFrame) -> DataFrame:
    return pages.withColumn("display_title", P.display_title(F.col("properties"), F.col("id")))


def prompt_title(pages: DataFrame, default: str = V.DEFAULT_PROMPT_TITLE) -> DataFrame:
    """Adds `title`. Tables without raw properties only get the default filled in."""
    plain = F.col("title") if "title" in pages.columns else None
    if "properties" in pages.columns:
        return pages.withColumn("title", P.prompt_title(F.col("properties"), plain, default))
    if plain is None:
        return pages.withColumn("title", F.lit(default))
    return pages.withColumn("title", F.coalesce(plain, F.lit(default)))


def created_date(pages: DataFrame, created_time: str = "created_time") -> DataFrame:
    return pages.withColumn("created_date", P.created_date(iso_text(pages, created_time)))


def display_label(pages: DataFrame, title: str = "display_title") -> DataFrame:
    """Adds `created_date` and `label`: the title, with the short date where there is one."""
    return created_date(pages).withColumn("label", P.display_label(F.col(title), F.col("created_date")))


def first_truthy_fields(memories: DataFrame) -> DataFrame:
    """Settles `content` (else `alt_content`) and `created_time` (after an optional `date`). Dates and timestamps become text."""
    cols = memories.columns
    out = memories
    if "alt_content" in cols:
        out = out.withColumn("content", P.memory_text(F.col("content"), F.col("alt_content"))).drop("alt_content")
    times = [iso_text(memories, c) for c in ("date", "created_time") if c in cols]
    if len(times) == 1:
        out = out.withColumn("created_time", times[0]).drop("date")
    elif times:
        out = out.withColumn("created_time", P.first_truthy(*times)).drop("date")
    return out


def drop_blank(memories: DataFrame, content: str = "content") -> DataFrame:
    """Without the memories whose text is missing or only white space."""
    return memories.where(has_text(F.col(content)))


def pages_to_memories(pages: DataFrame) -> DataFrame:
    """Raw pages as the canonical memory table. One parse of the blocks per page."""
    return prompt_title(pages).select(
        "id",
        "persona_id",
        "title",
        F.lit(None).cast("string").alias("content"),
        P.first_truthy(F.col("_content"), P.block_text(F.col("_blocks"))).alias("alt_content"),
        "created_time",
        "ingest_pos",
    )
