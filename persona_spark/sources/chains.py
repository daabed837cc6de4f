"""Responses without numbers put in order by their cursors: list ranking by pointer doubling."""

from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.scale import lookup_join
from persona_spark.session import stage_table

#: What can be wrong with a chain, in the order in which it is told.
FAULTS = ("no start", "fork", "join", "gap", "loose", "loop", "open")


def _asked(start: str) -> Column:
    """A response is known by the cursor it was asked with; the first was asked with none."""
    return F.coalesce(F.concat(F.lit("="), start), F.lit(""))


def _named(next_cursor: str, has_more: str) -> Column:
    """The cursor that goes on from a response, null at the end. What a last response names does not count."""
    return F.when(F.coalesce(F.col(has_more), F.lit(False)), F.concat(F.lit("="), next_cursor))


def _pointers(responses: DataFrame) -> DataFrame:
    """(dump_id, at, next, open): narrow, one row per response."""
    more = F.coalesce("has_more", F.lit(False))
    return stage_table(
        responses.select(
            "dump_id", _asked("start_cursor").alias("at"), _named("next_cursor", "has_more").alias("next"),
            (more & F.col("next_cursor").isNull()).alias("open"),
        ),
        "cursors",
    )


def _ranked(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dump_id, at, response_no) of the responses that a way leads to from the first one of their dump, and (dump_id, fault)
    of the dumps in which that are not all, or not in one way only."""
    counted = pointers.groupBy("dump_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("at") == "").alias("firsts"), F.count_if("open").alias("n_open")
    )
    sizes = stage_table(counted, "sizes")
    # Where two were asked with one cursor, or two name the same one, there is no single order.
    forks = pointers.groupBy("dump_id", "at").agg(F.count("*").alias("n")).where("n > 1").select("dump_id", F.lit("fork").alias("fault"))
    joins = pointers.where("next is not null").groupBy("dump_id", "next").agg(F.count("*").alias("n")).where("n > 1").select(
        "dump_id", F.lit("join").alias("fault")
    )
    gaps = pointers.where("next is not null").select("dump_id", F.col("next").alias("at")).join(pointers, ["dump_id", "at"], "left_anti")
    named = pointers.select("dump_id", F.col("next").alias("at"))
    loose = pointers.where(F.col("at") != "").join(named, ["dump_id", "at"], "left_anti").select("dump_id", F.lit("loose").alias("fault"))
    odd = stage_table(
        forks.unionByName(joins)
        .unionByName(gaps.select("dump_id", F.lit("gap").alias("fault")))
        .unionByName(loose)
        .unionByName(sizes.where("firsts = 0").select("dump_id", F.lit("no start").alias("fault")))
        .unionByName(sizes.where("n_open > 0").select("dump_id", F.lit("open").alias("fault")))
        .distinct(),
        "faults",
    )
    single = lookup_join(pointers, odd.select("dump_id").distinct(), ["dump_id"], "left_anti", ["at"])

    # Each response points at the one before it, and knows how many steps that is. A round doubles the steps.
    before = single.where("next is not null").select("dump_id", F.col("next").alias("at"), F.col("at").alias("to"))
    state = single.select("dump_id", "at").join(before, ["dump_id", "at"], "left").select(
        "dump_id", "at", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("steps")
    )
    state = stage_table(state, "ranks")
    longest = sizes.agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach < longest and state.where("to is not null").limit(1).count():
        onward = state.select("dump_id", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        state = stage_table(
            state.join(onward, ["dump_id", "to"], "left").select(
                "dump_id", "at", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0).cast("bigint"))).alias("steps")
            ),
            "ranks",
        )
        reach *= 2
    # Now that each has one before it at most, what does not come from the first response goes round in a circle.
    arrived = F.col("to").isNull()
    loops = state.where(~arrived).select("dump_id", F.lit("loop").alias("fault")).distinct()
    return state.where(arrived).select("dump_id", "at", F.col("steps").alias("response_no")), odd.unionByName(loops)


def chain_faults(responses: DataFrame) -> DataFrame:
    """(dump_id, fault) of the dumps whose responses do not make one chain: `no start` (none was asked without a cursor), `fork`
    (several were asked with one cursor), `join` (several name one as the next), `gap` (a named cursor was never asked
    with), `loose` (one was asked with a cursor that none names), `open` (more was announced and no cursor named), `loop` (responses that only lead to each other)."""
    return _ranked(_pointers(responses))[1]


def number_responses(responses: DataFrame) -> DataFrame:
    """`responses` (dump_id, start_cursor, next_cursor, has_more and others) with `response_no`, from 0 along the cursors.

    Only dumps whose responses make one whole chain come out; `chain_faults` lists the others. Only cursors are moved in
    the rounds, whose number grows with the logarithm of the longest chain; the responses meet their numbers at the end. A
    null dump_id belongs to no dump and gives nothing.
    """
    ranks, faults = _ranked(_pointers(responses))
    whole = lookup_join(ranks, faults.select("dump_id").distinct(), ["dump_id"], "left_anti", ["at"])
    keyed = responses.withColumn("_at", _asked("start_cursor"))
    ranked = whole.withColumnRenamed("at", "_at")
    return lookup_join(keyed, ranked, ["dump_id", "_at"], stage=True).drop("_at")
