"""The training set on disk."""

from pyspark.sql import DataFrame, functions as F


def write_training_set(
    examples: DataFrame, path: str, fmt: str = "parquet", buckets: int = 16
) -> None:
    """Examples as Parquet or JSON lines, in folders by a hash of the persona.

    Rebalancing gathers the rows of a folder and splits those that grow large, so that a persona
    with very many examples is written by several tasks.
    """
    if fmt not in ("parquet", "json"):
        raise ValueError(f"format must be parquet or json, not {fmt}")
    bucket = F.pmod(F.xxhash64("persona_id"), F.lit(buckets)).cast("int")
    (
        examples.withColumn("persona_bucket", bucket)
        .hint("rebalance", "persona_bucket")
        .write.partitionBy("persona_bucket")
        .format(fmt)
        .save(path)
    )
