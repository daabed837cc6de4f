"""Keeping the store up to date with dumps as they arrive."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from persona_spark.model import MEMORY, RESPONSE
from persona_spark.operators.pages import object_split, pages_to_memories
from persona_spark.scale import lookup_join
from persona_spark.sources.dumps import page_responses
from persona_spark.sources.store import BucketedStore

STORE_BUCKETS = 64
#: Folders of responses that wait for their chains to close.
PENDING_BUCKETS = 64
#: Up to this many dumps are named in the filter on the waiting responses.
NAMED_DUMPS = 1000
#: A chain that has not closed so long after its last response is given up.
WAIT = "30 days"

PENDING = StructType([*RESPONSE.fields, StructField("dump_bucket", IntegerType())])
#: What is known of a chain: numbers seen, as spans from `starts` to before `stops`; responses that announce another; whether
#: the last one does; whether one came twice or had no number; whether the chain was told to be whole.
STATE = "starts array<bigint>, stops array<bigint>, n_more bigint, last_more boolean, broken boolean, closed boolean"


def memory_store(spark: SparkSession, store_dir: str, buckets: int = STORE_BUCKETS) -> BucketedStore:
    """No row gives way to one listed earlier, so late dumps and repeated batches leave the store as one batch would."""
    return BucketedStore(spark, store_dir, MEMORY, buckets, ("ingest_pos", "batch"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("dump_id"), F.lit(PENDING_BUCKETS)).cast("int")


def pending_responses(spark: SparkSession, in_dir: str, work_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Bring new files of `in_dir` into `work_dir`, in folders of dumps, and give the stream of all that is there.

    Each file is parsed once. The stream's file log makes a response count once, however often a batch is tried.
    """
    reader = spark.readStream.schema(RESPONSE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.json(in_dir).withColumn("dump_bucket", _bucket())
    (
        rows.writeStream.format("parquet")
        .option("compression", "zstd")
        .partitionBy("dump_bucket")
        .option("path", f"{work_dir}/responses")
        .option("checkpointLocation", f"{work_dir}/arrived")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.readStream.schema(PENDING).parquet(f"{work_dir}/responses")


def _with_numbers(starts: list[int], stops: list[int], numbers: list[int]) -> tuple[list[int], list[int], bool]:
    """Spans with more numbers in them, and whether one of these was there before. Linear in spans and new numbers."""
    fresh = sorted(numbers)
    twice = any(a == b for a, b in zip(fresh, fresh[1:]))
    out: list[list[int]] = []
    for start, stop in sorted([*zip(starts, stops), *((n, n + 1) for n in dict.fromkeys(fresh))]):
        if out and start < out[-1][1]:
            twice = True
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [a for a, _ in out], [b for _, b in out], twice


def _milliseconds(wait: str) -> int:
    return int(pd.Timedelta(wait).total_seconds() * 1000) or 1


def close_chains(pending: DataFrame, wait: str = WAIT) -> DataFrame:
    """(dump_id, what) of a stream of responses: `closed` as soon as a dump has all its responses, `given up` when none came for
    `wait` and it is not whole.

    The state of a dump is a few spans of numbers, however long its chain, and goes after `wait`. A chain in which a
    response came twice before it was whole does not close; what comes after it closed changes nothing. Only dump_id,
    response_no and has_more of the stream are read.
    """
    limit = _milliseconds(wait)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            closed = state.get[5]
            state.remove()
            if not closed:
                yield pd.DataFrame({"dump_id": [key[0]], "what": ["given up"]})
            return
        starts, stops, n_more, last_more, broken, closed = state.get if state.exists else ([], [], 0, False, False, False)
        starts, stops = list(starts), list(stops)
        for batch in batches:
            if closed:
                continue
            more = batch["has_more"].fillna(False).astype(bool)
            known = batch["response_no"].notna()
            numbers = batch["response_no"][known].astype("int64")
            last = stops[-1] - 1 if stops else -1
            if len(numbers) and numbers.max() >= last:
                last_more = bool(more[numbers.idxmax()])
            starts, stops, twice = _with_numbers(starts, stops, numbers.tolist())
            broken = broken or twice or not bool(known.all())
            n_more += int(more.sum())
        whole = not broken and starts == [0] and n_more == stops[0] - 1 and not last_more
        state.update((starts, stops, n_more, last_more, broken, closed or whole))
        state.setTimeoutDuration(limit)
        if whole and not closed:
            yield pd.DataFrame({"dump_id": [key[0]], "what": ["closed"]})

    return (
        pending.select("dump_id", "response_no", "has_more")
        .where("dump_id is not null")
        .groupBy("dump_id")
        .applyInPandasWithState(advance, "dump_id bigint, what string", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    )


def closed_responses(spark: SparkSession, work_dir: str, dumps: DataFrame) -> DataFrame:
    """The waiting responses of some dumps. Few dumps are named, so that only their folders are opened."""
    waiting = spark.read.schema(PENDING).parquet(f"{work_dir}/responses")
    few = dumps.select("dump_id", _bucket().alias("b")).take(NAMED_DUMPS + 1)
    if len(few) <= NAMED_DUMPS:
        rows = waiting.where(F.col("dump_bucket").isin(list({r.b for r in few})) & F.col("dump_id").isin([r.dump_id for r in few]))
    else:
        rows = lookup_join(waiting, dumps.select("dump_id"), ["dump_id"], "left_semi", spread=["response_no"])
    return rows.select(*RESPONSE.fieldNames())


def start_available(told: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Start a stateful query over what is there. It makes no batches without data, which time limits would ask for without
    end; so chains are given up in the next batch that brings something."""
    conf, key = told.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:  # a query keeps the settings of its start
        return (
            told.writeStream.foreachBatch(each_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(key, before)


def refresh_batch(told: DataFrame, batch: int, work_dir: str, store_dir: str, buckets: int = STORE_BUCKETS) -> None:
    """Bring the dumps that closed in a batch into the store, as the batch of the same number."""
    spark = told.sparkSession
    dumps = told.where("what = 'closed'").select("dump_id").persist()  # one number per dump
    try:
        if not dumps.isEmpty():
            pages, _ = object_split(page_responses(closed_responses(spark, work_dir, dumps)))
            memory_store(spark, store_dir, buckets).upsert(pages_to_memories(pages), batch)
    finally:
        dumps.unpersist()


def refresh_stream(
    spark: SparkSession,
    in_dir: str,
    store_dir: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    buckets: int = STORE_BUCKETS,
    wait: str = WAIT,
) -> StreamingQuery:
    """Start a query that works through all new dumps and ends.

    Arrived files are first laid down in folders of dumps (`<checkpoint>/work`), then the second query follows the chains in
    keyed state and moves those that close. A batch reads its own files, and the chains that it closes.
    """
    work = f"{checkpoint.rstrip('/')}/work"
    told = close_chains(pending_responses(spark, in_dir, work, files_per_batch), wait)
    return start_available(
        told, f"{checkpoint.rstrip('/')}/chains", lambda batch, number: refresh_batch(batch, number, work, store_dir, buckets)
    )
