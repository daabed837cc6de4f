"""Prefix sums over tables of any size, by scans of totals and of totals of totals."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from persona_spark.scale import lookup_join, whole_div
from persona_spark.session import stage_table

ROWS_PER_BUCKET = 65_536


def _before(order: str, keys: Sequence[str], amount: str) -> Column:
    """Sum of `amount` over the earlier rows of the group."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(window), F.lit(0).cast("bigint"))


def numbered(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """`rows` sorted once over the whole table and written down, with `_no` ascending in that order.

    `_no` is dense inside a part of the sort and says nothing about the values sorted by, so it serves positions of any
    type and with any gaps. `rows` should be narrow and cheap to make: a sort reads them twice.
    """
    return stage_table(rows.orderBy(*order).withColumn("_no", F.monotonically_increasing_id()), "numbered")


def prefix_sums(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amount: str,
    out: str = "before",
    per_bucket: int = ROWS_PER_BUCKET,
    _before_this: int | None = None,
) -> DataFrame:
    """Adds `out`, the sum of `amount` over the earlier rows of the same keys in the order of the columns `order`.

    Rows are numbered by one range sort over (keys, order) and cut into buckets of `per_bucket` numbers. Windows run
    inside buckets only; the buckets' totals get their own prefix sums in the same way, level upon level, until those of a
    group fit one bucket. No task sees a whole group, and no value is divided: order columns may be of any sortable type. Null
    keys are a group, rows that tie in `order` come in any order, and a null amount counts as nothing.
    """
    keys = list(keys)
    ordered = numbered(rows, [*keys, *order]).withColumn("_prefix_in", whole_div(F.col("_no"), per_bucket))
    totals = stage_table(
        ordered.groupBy(*keys, F.col("_prefix_in").alias("_bucket")).agg(F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("_sum")),
        "totals",
    )
    sizes = totals.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else totals.agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    # A level that hardly shrinks, as buckets end with the parts of a sort, is small enough as well.
    if largest <= per_bucket or (_before_this and 2 * largest > _before_this):
        starts = totals.withColumn("_from", _before("_bucket", keys, "_sum"))
    else:
        starts = prefix_sums(totals, keys, ["_bucket"], "_sum", "_from", per_bucket, largest)
    own = [f"_prefix_key{i}" for i in range(len(keys))]
    starts = starts.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("_bucket").alias("_prefix_at"), F.col("_from").alias("_prefix_start"))
    inside = ordered.withColumn("_prefix_inside", _before("_no", [*keys, "_prefix_in"], amount))
    # Null-safe, and hashed by the bucket as well, so that one large group is spread over many tasks.
    same = F.col("_prefix_in") == F.col("_prefix_at")
    for k, o in zip(keys, own):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return inside.join(starts, same).select(*rows.columns, (F.col("_prefix_start") + F.col("_prefix_inside")).alias(out))


def range_bounds(rows: DataFrame, order: Sequence[str], rows_per_part: int = ROWS_PER_BUCKET) -> DataFrame:
    """(part, bound): where each part of the table begins, when it is cut into parts of at most `rows_per_part` rows in the
    order of the columns `order`. Parts ascend with their bounds. `rows_per_part` is a power of two."""
    if rows_per_part < 1 or rows_per_part & (rows_per_part - 1):
        raise ValueError("rows_per_part must be a power of two")
    ordered = numbered(rows.select(*order), order)
    firsts = ordered.where(F.col("_no") % rows_per_part == 0)
    return stage_table(firsts.select(whole_div(F.col("_no"), rows_per_part).alias("part"), F.struct(*order).alias("bound")), "bounds")


def with_part(
    df: DataFrame, order: Sequence[str], bounds: DataFrame, out: str = "_part", fan: int = 512, most: int = 64
) -> DataFrame:
    """`df` with the part of `range_bounds` that each row belongs to.

    The bounds become a search tree: at most `most` entries at the top stand in the plan, each level below is a narrow table
    of nodes with at most `fan` entries, looked up by number. Rows do not move while a level fits a broadcast.
    """
    level = bounds.select(F.col("part").alias("child"), "bound")
    tables = []
    while level.count() > most:
        ranked = prefix_sums(level.withColumn("_one", F.lit(1)), [], ["child"], "_one", "_rank")
        nodes = ranked.groupBy(whole_div(F.col("_rank"), fan).alias("_node")).agg(
            F.array_sort(F.collect_list(F.struct("child", "bound"))).alias("_entries")
        )
        tables.append(stage_table(nodes, "nodes"))
        level = tables[-1].select(F.col("_node").alias("child"), F.element_at("_entries", 1)["bound"].alias("bound"))
    top = sorted(level.collect(), key=lambda r: r.child)  # at most `most` rows
    here = F.struct(*order)
    if not top:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    types = {f.name: f.dataType for f in level.schema["bound"].dataType.fields}
    entries = F.array(
        *[F.struct(F.lit(r.child).cast("bigint").alias("child"), F.struct(*[F.lit(r.bound[c]).cast(t).alias(c) for c, t in types.items()]).alias("bound")) for r in top]
    )

    def found(entries: Column) -> Column:
        """The child of the last entry that does not lie behind the row."""
        return F.element_at(entries, F.size(F.filter(entries, lambda e: e["bound"] <= here)))["child"]

    df = df.withColumn("_node", found(entries))
    for table in reversed(tables):
        df = lookup_join(df, table, ["_node"]).withColumn("_node", found(F.col("_entries"))).drop("_entries")
    return df.withColumnRenamed("_node", out)
