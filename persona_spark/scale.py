"""Joins that hold up when one key owns a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.session import stage_table

PROBE_MAX_ROWS = 50_000
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20

# A key is heavy when it owns more than this share of all rows, so there are at most 1,000 of them.
HEAVY_SHARE = 1 / 1000
HEAVY_MIN_ROWS = 1_000_000
# Rows of a heavy key that should end up in one task.
ROWS_PER_SALT = 1_000_000


def whole_div(c: Column, n: int) -> Column:
    """Whole-number division without the detour over floating point."""
    return F.call_function("div", c, F.lit(n).cast("bigint"))


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Whether `df` has at most `max_rows` rows and `max_bytes` bytes. Reads no more rows than that."""
    max_rows = PROBE_MAX_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    sizes = df.select(_row_bytes().alias("b")).take(max_rows + 1)
    return len(sizes) <= max_rows and sum(r.b for r in sizes) <= max_bytes


def staged_fits_broadcast(staged: DataFrame) -> bool:
    """The same for a table that is written down: it is cheap to measure in full."""
    size = staged.agg(F.count("*").alias("n"), F.sum(_row_bytes()).alias("b")).first()
    return size.n <= BROADCAST_MAX_ROWS and (size.b or 0) <= BROADCAST_MAX_BYTES


def _row_bytes() -> Column:
    return F.octet_length(F.to_json(F.struct("*")))


def heavy_keys(
    df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE, min_rows: int | None = None
) -> dict[int, int]:
    """Hash -> approximate row count of the keys that own more than `share` of the rows.

    One scan of the key columns with a mergeable sketch. It only steers the spreading of rows:
    a missed or a wrongly reported key costs time, never a row.
    """
    min_rows = HEAVY_MIN_ROWS if min_rows is None else min_rows
    top = (
        df.select(F.xxhash64(*keys).alias("h"))
        .agg(F.count("*").alias("n"), F.expr("approx_top_k(h, 1000, 20000)").alias("top"))
        .first()
    )
    floor = max(top.n * share, min_rows)
    return {t["item"]: t["count"] for t in top.top or [] if t["count"] >= floor}


def _salt_ways(keys: Sequence[str], heavy: dict[int, int], rows_per_salt: int) -> Column:
    h = F.xxhash64(*keys)
    ways = F.create_map(
        *[F.lit(x) for key, n in heavy.items() for x in (key, max(2, -(-n // rows_per_salt)))]
    )
    return F.when(h.isin(list(heavy)), ways[h]).otherwise(F.lit(1)).cast("bigint")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    heavy: dict[int, int],
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Equi-join in which the left rows of each heavy key are spread over several tasks by a hash of
    the columns `spread`, and the right rows of those keys are repeated to meet them."""
    ways = _salt_ways(on, heavy, rows_per_salt or ROWS_PER_SALT)
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), ways))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), ways - 1)))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    stage: bool = False,
) -> DataFrame:
    """Join a large left side with a lookup table: broadcast behind a size check, a shuffle beyond it.

    `spread` names left columns that tell rows of one key apart; with it the shuffle salts heavy
    keys. Leave it out where the left keys are unique. `stage` writes the lookup table down first,
    for narrow tables that take work to make: otherwise the size check makes them once more.
    """
    on = list(on)
    if stage:
        right = stage_table(right, "lookup")
    if staged_fits_broadcast(right) if stage else fits_broadcast(right):
        return left.join(F.broadcast(right), on, how)
    return shuffle_join(left, right, on, how, spread)


def shuffle_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread: Sequence[str] | None = None
) -> DataFrame:
    """Join two large sides, with heavy keys of the left one salted if `spread` is given."""
    heavy = heavy_keys(left, on) if spread else {}
    if heavy:
        return salted_join(left, right, on, how, spread, heavy)
    return left.join(right, on, how)
