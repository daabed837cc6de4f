"""Packing examples into blocks and laying out training steps.

Both need positions in a global order. They are found level by level, so that no task ever sees a
whole persona: rows are numbered inside small buckets, and the buckets' totals are summed up.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from persona_spark.functions import values as V
from persona_spark.functions.permutation import mixed, permuted
from persona_spark.functions.text import words
from persona_spark.operators.runs import run_plans
from persona_spark.prefix import ROWS_PER_BUCKET, prefix_sums, range_bounds, with_part
from persona_spark.scale import lookup_join, whole_div
from persona_spark.session import stage_table

POSITIONS_PER_BUCKET = 65_536
HASH_DIGITS = 4
STEPS_PER_STRETCH = 512


def _before(order: Column, keys: Sequence[str], amount: Column) -> Column:
    """Sum of `amount` over the earlier rows of the group."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(window), F.lit(0))


def running_offsets(
    lengths: DataFrame,
    keys: Sequence[str],
    position: str = "ingest_pos",
    length: str = "n_tokens",
    per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Adds `offset`, the summed lengths of the earlier rows of the same key group. Positions are compared, never divided,
    so any numbers, dates or texts will do. `lengths` should be narrow: it is sorted and written down."""
    return prefix_sums(lengths, keys, [position], length, "offset", per_bucket)


def pack_sequences(
    examples: DataFrame,
    max_len: int = V.MAX_SEQ_LENGTH,
    keys: Sequence[str] = ("persona_id",),
    position: str = "ingest_pos",
    text: str = "text",
    tokenizer=words,
    per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Examples of a group put one after the other and cut into blocks of `max_len` tokens.

    (keys, block_id, members, n_tokens, text). `members` are the ids in order; an example that straddles blocks is a member
    of each. Ids are unique, and order examples of equal position.

    The table is cut into parts of at most `per_bucket` rows (a power of two) in the order of keys and position. The tokens
    of each part are counted, and groups that go on over several parts get the prefix sums of these. Then the texts move
    once, part by part: offsets are summed, blocks cut and put together where they arrive. Only the tokens of blocks at the
    ends of a part, which a group may share with the next part, move again.
    """
    keys = list(keys)
    order = [*keys, position, "id"]
    slot = ["_part", *keys]
    tokens = F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>"))
    parted = with_part(examples.select(*order, text), order, range_bounds(examples, order, per_bucket))
    rows = parted.select(*order, "_part", tokens.alias("_tokens"))

    totals = stage_table(rows.groupBy(*slot).agg(F.sum(F.size("_tokens")).cast("bigint").alias("_total")), "totals")
    several = totals.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    # At most two groups of a part have rows in others, so this is as small as the list of parts.
    shared = totals.join(several, keys, "left_semi") if keys else totals
    spans = prefix_sums(shared, keys, ["_part"], "_total", "_start", per_bucket).select(
        *slot,
        "_start",
        whole_div(F.col("_start"), max_len).alias("_low"),
        whole_div(F.col("_start") + F.col("_total") - 1, max_len).alias("_high"),
    )

    before = Window.partitionBy(*slot).orderBy(position, "id").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.size("_tokens")).over(before), F.lit(0)).cast("bigint")
    placed = (
        lookup_join(rows, spans, slot, "left", stage=True)
        .withColumn("_offset", F.coalesce("_start", F.lit(0).cast("bigint")) + inside)
        .where(F.size("_tokens") > 0)
        .withColumn("_first", whole_div(F.col("_offset"), max_len))
        .withColumn("_last", whole_div(F.col("_offset") + F.size("_tokens") - 1, max_len))
    )
    start, stop = F.col("_offset"), F.col("_offset") + F.size("_tokens")

    def piece(block: Column) -> Column:
        low = F.greatest(block * max_len, start)
        n = F.least((block + 1) * max_len, stop) - low
        cut = F.slice("_tokens", (low - start + 1).cast("int"), n.cast("int"))
        return F.struct(block.alias("block_id"), n.alias("n"), F.array_join(cut, " ").alias("part"))

    def blocks(some: DataFrame, group: Sequence[str], wanted: Column) -> DataFrame:
        pieces = (
            some.select(*slot, position, "id", "_low", "_high", F.explode_outer(F.transform(F.sequence("_first", "_last"), piece)).alias("p"))
            .select(*slot, position, "id", "_low", "_high", "p.*")
            .where(wanted)
        )
        ordered = F.array_sort(F.collect_list(F.struct(position, "id", "n", "part")))
        return pieces.groupBy(*group, "block_id").agg(ordered.alias("_parts")).select(
            *keys,
            "block_id",
            F.transform("_parts", lambda p: p["id"]).alias("members"),
            F.aggregate("_parts", F.lit(0).cast("bigint"), lambda n, p: n + p["n"]).alias("n_tokens"),
            F.array_join(F.transform("_parts", lambda p: p["part"]), " ").alias("text"),
        )

    at_end = (F.col("block_id") == F.col("_low")) | (F.col("block_id") == F.col("_high"))
    reaches_end = (F.col("_first") <= F.col("_low")) | (F.col("_last") >= F.col("_high"))
    within = blocks(placed, slot, F.col("_low").isNull() | ~at_end)
    across = blocks(placed.where(reaches_end), keys, F.col("_low").isNotNull() & at_end)
    return within.unionByName(across)


def training_schedule(
    examples: DataFrame,
    batch_size: int = V.ADAPTER_SCHEDULE["batch_size"],
    accumulation: int = V.ADAPTER_SCHEDULE["accumulation"],
    max_steps: int | None = V.ADAPTER_SCHEDULE["max_steps"],
    num_epochs: int = 1,
    seed: int = V.SCHEDULE_SEED,
    keys: Sequence[str] = ("persona_id",),
    per_bucket: int = POSITIONS_PER_BUCKET,
) -> DataFrame:
    """(keys, epoch, step, micro_batch, id): which example is seen when, for every key group.

    Each epoch runs through all examples in the order of md5(id:epoch:seed). A micro batch holds
    `batch_size` examples and a step `accumulation` micro batches, the last ones of an epoch perhaps
    fewer. `max_steps` counts over all epochs and decides how many there are; without it
    `num_epochs` does. With no keys the whole table is one run. Groups of more than `per_bucket`
    examples are placed in buckets of the leading hex digits of the hash.
    """
    if max_steps is not None and max_steps < 1:
        raise ValueError("max_steps must be at least 1")
    keys = list(keys)
    per_step = batch_size * accumulation
    # Read three times below, so only the ids are, not what it takes to find the examples.
    rows = stage_table(examples.select(*keys, "id"), "schedule-ids")

    def sized(df: DataFrame, n: Column) -> DataFrame:
        steps = F.ceil(n / per_step)
        epochs = F.lit(num_epochs) if max_steps is None else F.ceil(F.lit(max_steps) / steps)
        digits = F.when(n > per_bucket, HASH_DIGITS).otherwise(0)
        return df.withColumns({"_steps": steps, "_epochs": epochs.cast("bigint"), "_digits": digits})

    if keys:
        group = keys
        sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
        rows = lookup_join(rows, sized(sizes, F.col("_n")), group, spread=["id"], stage=True)
    else:
        group = ["_run"]
        rows = sized(rows.withColumn("_run", F.lit(0)), F.lit(max(1, rows.count())))

    shuffled = (
        rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_epochs") - 1)))
        .withColumn("_digest", F.md5(F.concat_ws(":", "id", "epoch", F.lit(str(seed)))))
        .withColumn("_bucket", F.substring("_digest", F.lit(1), F.col("_digits")))
    )
    bucket = [*group, "epoch", "_bucket"]
    small = shuffled.where(F.col("_digits") == 0).withColumn("_start", F.lit(0).cast("bigint"))
    large = shuffled.where(F.col("_digits") > 0)
    counts = large.groupBy(*bucket).agg(F.count("*").alias("_count"), F.first("_steps").alias("_steps"))
    before = _before(F.col("_bucket"), [*group, "epoch"], F.col("_count"))
    starts = counts.select(*bucket, before.alias("_start"), "_steps")
    if max_steps is not None:
        # Only the buckets that reach into the steps wanted are needed at all.
        left = (F.lit(max_steps) - F.col("epoch") * F.col("_steps")) * per_step
        starts = starts.where(F.col("_start") < left)
    placed = small.unionByName(lookup_join(large, starts.drop("_steps"), bucket, stage=True))

    in_bucket = Window.partitionBy(*bucket).orderBy("_digest", "id")
    position = F.col("_start") + F.row_number().over(in_bucket) - 1
    steps = (
        placed.withColumn("_position", position)
        .withColumn("micro_batch", whole_div(F.col("_position"), batch_size))
        .withColumn("step", F.col("epoch") * F.col("_steps") + whole_div(F.col("_position"), per_step))
    )
    if max_steps is not None:
        steps = steps.where(F.col("step") < max_steps)
    return steps.select(*keys, "epoch", "step", "micro_batch", "id")


def shared_schedules(
    examples: DataFrame, runs: DataFrame, keys: Sequence[str] = ("persona_id",), per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, DataFrame]:
    """(run_id, schedule_id, n_steps) and (schedule_id, epoch, step, micro_batch, id): runs, and the schedules they follow.

    `runs` has run_id, the keys of the group it learns from, and batch_size, accumulation, max_steps, num_epochs and seed; of
    these a null or a `max_steps` below 1 means that the epochs decide, as in `runs.run_plans`. Runs of one group, seed,
    batch size and accumulation share a schedule, as long as the longest of them, and follow it for their `n_steps`; it is
    laid out once for all of them. Ids of a group get dense ranks once, by prefix sums; a keyed permutation of the ranks then
    tells where an example stands in each epoch, so nothing is sorted or moved for rows times epochs. Schedules of one
    seed see a group in one order. Ids are unique in a group; a run without examples gives nothing.
    """
    keys = list(keys)
    ranked = prefix_sums(examples.select(*keys, "id").withColumn("_one", F.lit(1)), keys, ["id"], "_one", "_rank", per_bucket)
    ranked = stage_table(ranked.drop("_one"), "ranks")
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("n_examples")) if keys else ranked.agg(F.count("*").alias("n_examples"))
    settings = ["batch_size", "accumulation", "max_steps", "num_epochs", "seed"]
    asked = runs.select("run_id", *keys, *[F.col(c).cast("bigint").alias(c) for c in settings])
    sized = lookup_join(asked, sizes, keys, stage=True) if keys else asked.withColumn("n_examples", F.lit(ranked.count()).cast("bigint"))
    plans = lookup_join(sized, run_plans(sized).withColumnRenamed("max_steps", "n_steps"), ["run_id"], stage=True)
    own = [*keys, "batch_size", "accumulation", "seed", "n_examples", "steps_per_epoch"]
    plans = stage_table(
        plans.where("n_examples > 0 AND total_epochs > 0").withColumn("schedule_id", F.to_json(F.struct(*own), {"ignoreNullFields": "false"})), "plans"
    )
    shared = plans.groupBy("schedule_id", *own).agg(
        F.max("n_steps").alias("_most"), F.max("total_epochs").alias("_epochs")
    )
    on = keys or ["_of"]
    side = [df if keys else df.withColumn("_of", F.lit(0)) for df in (ranked, shared)]
    rows = lookup_join(side[0], side[1], on, spread=["id"], stage=True)
    epochs = F.sequence(F.lit(0).cast("bigint"), F.col("_epochs") - 1)
    seen = rows.select(
        "schedule_id", F.explode_outer(epochs).alias("epoch"), "id", "steps_per_epoch", "_most", "batch_size", "accumulation",
        "n_examples", "seed", "_rank",
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(batch.schema.get_field_index(name)) for name in ("_rank", "n_examples", "seed", "epoch")}
            rank, n, seed, epoch = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in col.values())
            key = mixed(mixed(seed.astype(np.uint64)) ^ epoch.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(permuted(rank, n, key))], [*batch.schema.names, "_position"])

    placed = seen.mapInArrow(place, T.StructType([*seen.schema.fields, T.StructField("_position", T.LongType())]))
    per_step = F.col("batch_size") * F.col("accumulation")
    step = F.col("epoch") * F.col("steps_per_epoch") + F.call_function("div", F.col("_position"), per_step)
    steps = (
        placed.withColumn("step", step)
        .where(F.col("step") < F.col("_most"))
        .select("schedule_id", "epoch", "step", F.call_function("div", F.col("_position"), F.col("batch_size")).alias("micro_batch"), "id")
    )
    # A run sees whole epochs of its own, so what its longer neighbours see later lies behind its last step.
    return plans.select("run_id", "schedule_id", F.least("n_steps", F.col("total_epochs") * F.col("steps_per_epoch")).alias("n_steps")), steps


def followed(schedules: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of shared schedules for every run that follows them: with run_id, in place of schedule_id, for the run's steps.

    Both sides are cut into stretches of steps, so that a schedule that is long or has many runs is spread over tasks.
    """
    cut = schedules.withColumn("_stretch", whole_div(F.col("step"), STEPS_PER_STRETCH))
    last = whole_div(F.col("n_steps") - 1, STEPS_PER_STRETCH)
    asked = runs.where("n_steps > 0").withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    joined = cut.join(asked, ["schedule_id", "_stretch"]).where(F.col("step") < F.col("n_steps"))
    return joined.select("run_id", *[c for c in schedules.columns if c != "schedule_id"])


def run_schedules(examples: DataFrame, runs: DataFrame, keys: Sequence[str] = ("persona_id",), per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(run_id, epoch, step, micro_batch, id) for many runs at once, each with numbers of its own: `shared_schedules` told for
    every run. That is a row per run and example; what is the same for all runs of a schedule is better worked out on
    the schedules, and `followed` by the runs afterwards."""
    plans, steps = shared_schedules(examples, runs, keys, per_bucket)
    return followed(steps, plans)
