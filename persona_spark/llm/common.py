"""What several operators share: reading tables, white space, words."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from persona_spark.scale import lookup_join

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def strip_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def nested(docs: DataFrame) -> Column:
    """All columns of a row in one struct, where their names cannot clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def unnested(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of `docs` out of that struct, some of them with new content."""
    return [new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


def row_key(text: str = "text") -> Column:
    """What a row is known by, as ids may be null or repeated: its id and a hash of its text."""
    return F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash")
    )


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose `row_key` is not among doc_id and text_hash of `gone`."""
    keyed = docs.select(nested(docs), row_key().alias("_key"))
    keys = gone.select(F.struct("doc_id", "text_hash").alias("_key")).distinct()
    return lookup_join(keyed, keys, ["_key"], "left_anti", stage=True).select(*unnested(docs))
