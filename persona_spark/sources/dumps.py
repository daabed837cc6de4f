"""Saved responses of a paged listing as note pages."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from persona_spark.model import POSITION, RESPONSE
from persona_spark.scale import lookup_join

# An ingest position is a DECIMAL: DUMP_STEP for a dump, RESPONSE_STEP for each of its first FINE_FROM
# responses and 1 for an entry. From then on a response takes 2^ENTRY_BITS of the smallest fraction and
# an entry one, so that all dump numbers and chains of any length that can be stored have places.
# A response lists at most 100 entries; more than 2^ENTRY_BITS are an error.
DUMP_STEP = 1 << 27
RESPONSE_STEP = 1 << 10
FINE_FROM = 1 << 16
FRACTION = 9
ENTRY_BITS = 7
RESPONSE_BITS = 48
DUMP_BITS = 63


def read_responses(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """Response dumps in JSON lines. A file that cannot be read ends the job, unless `skip_broken` leaves
    it out; the chains it belongs to are then found incomplete. Dumps may lie in `dump_id=...` folders."""
    skip = str(skip_broken).lower()
    return (
        spark.read.schema(RESPONSE)
        .option("mode", "PERMISSIVE")
        .option("ignoreCorruptFiles", skip)
        .option("ignoreMissingFiles", skip)
        .json(path)
    )


def _chains(responses: DataFrame) -> DataFrame:
    last = F.max("response_no")
    number = F.count_distinct("response_no")
    return responses.groupBy("dump_id").agg(
        number.alias("_distinct"),
        F.count("*").alias("_n"),
        last.alias("_last"),
        F.count_if(F.coalesce("has_more", F.lit(False))).alias("_more"),
        F.max_by(F.coalesce("has_more", F.lit(False)), "response_no").alias("_open"),
        F.count_if(F.col("response_no").isNull()).alias("_broken"),
    )


def _whole() -> Column:
    whole = (
        (F.col("_broken") == 0)
        & (F.col("_distinct") == F.col("_last") + 1)
        & (F.col("_n") == F.col("_distinct"))
        & (F.col("_more") == F.col("_last"))
        & ~F.col("_open")
    )
    return F.coalesce(whole, F.lit(False))


def complete_dumps(responses: DataFrame) -> DataFrame:
    """(dump_id) of the chains that are there from the first response to one without a next."""
    return _chains(responses).where(_whole()).select("dump_id")


def incomplete_dumps(responses: DataFrame) -> DataFrame:
    """(dump_id, n_responses, last_response, n_broken) of the chains that `page_responses` leaves out. Lines
    that cannot be parsed are `n_broken`; they have no dump_id unless their folder gives it."""
    return _chains(responses).where(~_whole()).select(
        "dump_id", F.col("_n").alias("n_responses"), F.col("_last").alias("last_response"), F.col("_broken").alias("n_broken")
    )


def _checked(value: Column, bits: int, what: str) -> Column:
    fits = (value >= 0) & (value <= (1 << bits) - 1)
    message = F.concat(F.lit(f"no number of {what} from 0 to {(1 << bits) - 1}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(fits, value).otherwise(F.raise_error(message))


def ingest_position() -> Column:
    """The place of an entry among all entries of all dumps, from dump_id, response_no and _entry_no."""
    dump = _checked(F.col("dump_id"), DUMP_BITS, "dumps")
    no = _checked(F.col("response_no"), RESPONSE_BITS, "responses in a dump")
    entry = _checked(F.col("_entry_no").cast("bigint"), ENTRY_BITS, "entries in a response")
    fine = no >= FINE_FROM
    whole = F.least(no, F.lit(FINE_FROM)) * RESPONSE_STEP + F.when(fine, 0).otherwise(entry)
    parts = F.when(fine, F.shiftleft(no - FINE_FROM, ENTRY_BITS) + entry).otherwise(0)
    within = (whole * 10**FRACTION + parts).cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-FRACTION))
    start = dump.cast("decimal(19,0)") * F.lit(Decimal(DUMP_STEP))
    # Precisions that leave the sum its fraction.
    return (start.cast("decimal(28,0)") + within.cast(f"decimal(18,{FRACTION})")).cast(POSITION)


def page_responses(responses: DataFrame) -> DataFrame:
    """Entries of all complete chains in the order they were listed, as `ingest_pos`.

    A chain that lacks a response, or whose last response announces another one, gives nothing; `incomplete_dumps` lists it.
    """
    whole = lookup_join(
        responses, complete_dumps(responses), ["dump_id"], "left_semi", ["response_no"], stage=True
    )
    entry = whole.select(
        "dump_id", "persona_id", "response_no", F.posexplode("results").alias("_entry_no", "_page")
    )
    return entry.select("dump_id", "persona_id", ingest_position().alias("ingest_pos"), "_page.*")
