"""The memory store on disk: batches in Parquet, and JSON documents in and out."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from persona_spark.operators.store import found_by_ids, latest_per_id
from persona_spark.scale import fits_broadcast

#: Requests of so many ids are handed to the files themselves.
FEW_IDS = 10

CORRUPT = "_corrupt"


def read_parquet_store(
    spark: SparkSession, path: str, schema: StructType | None = None, skip_broken: bool = False
) -> DataFrame:
    """A store in Parquet. A file that cannot be read ends the job, unless `skip_broken` leaves it out."""
    skip = str(skip_broken).lower()
    reader = spark.read.option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip)
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_json_store(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = False, skip_broken: bool = False
) -> DataFrame:
    """Memories kept as JSON, one per line or (`multi_line`) one document per file. Documents that
    cannot be parsed are passed over, as `broken_documents` tells. A file that cannot be read or
    vanishes ends the job, unless `skip_broken` leaves it out."""
    rows = _parsed(spark, path, schema, multi_line, skip_broken)
    return rows.where(F.col(CORRUPT).isNull()).select(*schema.fieldNames())


def broken_documents(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """(file, document) of the documents that `read_json_store` cannot parse. Files that cannot be read
    are not among them: they end this job too."""
    whole = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return (
        spark.read.text(path, wholetext=multi_line)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"), parsed[CORRUPT].alias("_bad"))
        .where("_bad IS NOT NULL")
        .select("file", "document")
    )


def _parsed(spark: SparkSession, path: str, schema: StructType, multi_line: bool, skip_broken: bool) -> DataFrame:
    skip = str(skip_broken).lower()
    return (
        spark.read.schema(StructType([*schema.fields, StructField(CORRUPT, StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", str(multi_line).lower())
        .option("ignoreCorruptFiles", skip)
        .option("ignoreMissingFiles", skip)
        .json(path)
    )


def store_read(store: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All memories, or those asked for in a table (id, pos). An empty request means all."""
    if ids is None or ids.isEmpty():
        return store
    return found_by_ids(store, ids)


def export_json(store: DataFrame, path: str, buckets: int = 64) -> None:
    """Each memory as one line of UTF-8 JSON, spread over folders by a hash of the id. Values JSON
    has no form for become text."""
    document = F.to_json(F.struct(*store.columns), {"ignoreNullFields": "false"})
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    (
        store.select(bucket.alias("id_bucket"), document.alias("value"))
        .hint("rebalance", "id_bucket")
        .write.partitionBy("id_bucket")
        .text(path)
    )


class BucketedStore:
    """A store as Parquet in folders of ids: batches are appended, and the newest row of an id counts.

    `<root>/batch=<n>/of=<buckets>/id_bucket=<b>`. A batch that is written again takes the place of what its first try left,
    nothing else is overwritten, and readers put the rows of an id together. `newest` says which row counts: by default
    that of the last batch and in it the largest `ingest_pos`; with the position first, no row gives way to an older one.
    The number of buckets may change from batch to batch. `rewrite` makes a store without the rows that no longer count.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: StructType, buckets: int = 64, newest: Sequence[str] = ("batch", "ingest_pos")
    ):
        self.spark, self.root, self.schema, self.buckets, self.newest = spark, root.rstrip("/"), schema, buckets, list(newest)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        """All rows of all batches, with batch, of and id_bucket."""
        folders = StructType([StructField("batch", LongType()), StructField("of", IntegerType()), StructField("id_bucket", IntegerType())])
        schema = StructType([*self.schema.fields, *folders.fields])
        try:
            return self.spark.read.schema(schema).parquet(self.root)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def _newest(self, rows: DataFrame) -> DataFrame:
        if len(rows.select("batch").distinct().take(2)) < 2:  # folder names alone; a batch has an id once
            return rows.select(*self.schema.fieldNames())
        order = F.struct(*self.newest)
        return latest_per_id(rows.withColumn("_order", order), "_order").select(*self.schema.fieldNames())

    def read(self) -> DataFrame:
        return self._newest(self._rows())

    def narrowed(self, ids: DataFrame) -> DataFrame:
        """The newest rows of the folders that the ids of a small request belong to; all folders for a large one."""
        rows = self._rows()
        asked = ids.select("id").distinct()
        if not fits_broadcast(asked):
            return self._newest(rows)
        wanted = [r.b for r in asked.where("id is not null").select(self._bucket().alias("b")).distinct().collect()]  # at most all buckets
        rows = rows.where(F.col("id_bucket").isin(wanted) & (F.col("of") == self.buckets) | (F.col("of") != self.buckets))
        few = asked.take(FEW_IDS + 1)
        if len(few) <= FEW_IDS:  # reaches the Bloom filters of the files
            rows = rows.where(F.col("id").isin([r.id for r in few]))
        return self._newest(rows)

    def fetch(self, ids: DataFrame) -> DataFrame:
        """The found rows of a request (id, pos), in no order: only the folders of its ids are opened."""
        return found_by_ids(self.narrowed(ids), ids)

    def next_batch(self) -> int:
        last = self._rows().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def upsert(self, incoming: DataFrame, batch: int | None = None) -> None:
        """Append a batch: of each id its last row by `ingest_pos`, rows without an id not at all. Without a number it is one
        more than the last; a stream gives its own, so that a repeated batch counts once. One writer at a time."""
        number = self.next_batch() if batch is None else batch
        rows = incoming.select(*self.schema.fieldNames())
        if self.spark.conf.get("spark.sql.adaptive.enabled").lower() == "true":
            placed = latest_per_id(rows).withColumn("id_bucket", self._bucket()).hint("rebalance", "id_bucket")
        else:  # as in the batches of a stream, where the hint means nothing: rows move to their folders and are told apart there
            placed = latest_per_id(rows.withColumn("id_bucket", self._bucket()).repartition("id_bucket"), by=("id_bucket", "id"))
        (
            placed.withColumn("of", F.lit(self.buckets))
            .sortWithinPartitions("id_bucket", "id")
            .write.mode("overwrite")
            .option("compression", "zstd")
            .option("parquet.bloom.filter.enabled#id", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .partitionBy("of", "id_bucket")
            .parquet(f"{self.root}/batch={number}")
        )

    def rewrite(self, root: str, buckets: int | None = None) -> "BucketedStore":
        """Write the rows that count as the first batch of a new store, and give that back. Batches that go on arriving belong
        to the new one; numbers start again, so with a stream take the store that orders by position first."""
        fresh = BucketedStore(self.spark, root, self.schema, buckets or self.buckets, self.newest)
        fresh.upsert(self.read(), batch=-1)
        return fresh
