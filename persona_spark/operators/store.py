"""The memory store as tables: upsert, look-ups and figures."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.operators.conversations import select_memories
from persona_spark.scale import fits_broadcast, lookup_join, shuffle_join
from persona_spark.session import stage_table


def latest_per_id(batch: DataFrame, order: str = "ingest_pos", by: Sequence[str] = ("id",)) -> DataFrame:
    """The last row of every id; rows without an id are dropped. Equal positions are settled by a
    hash of the row, so the choice is repeatable. Copies meet in the map-side half of the
    aggregate, so an id that fills a large part of the batch is no burden on one task. `by` may name
    columns that hang on the id besides it: rows that already lie by one of these do not move again."""
    rest = [c for c in batch.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest)))
    return (
        batch.where(F.coalesce(F.col("id"), F.lit("")) != "")
        .groupBy(*by)
        .agg(newest.alias("_row"))
        .select(*by, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*batch.columns)
    )


def store_upsert(store: DataFrame, incoming: DataFrame, order: str = "ingest_pos") -> DataFrame:
    """The store with the batch written over it by id. Other rows stay."""
    ids = incoming.select("id").where(F.col("id") != "").distinct()
    kept = lookup_join(store, ids, ["id"], "left_anti")
    return kept.unionByName(latest_per_id(incoming, order))


def newer_than_store(store: DataFrame, incoming: DataFrame, order: str = "ingest_pos") -> DataFrame:
    """The part of a batch that is not older than what the store holds."""
    ids = incoming.select("id").where(F.col("id") != "").distinct()
    held = lookup_join(store.select("id", F.col(order).alias("_held")), ids, ["id"], "left_semi")
    return (
        lookup_join(incoming, held, ["id"], "left", spread=["id", order], stage=True)
        .where(F.col("_held").isNull() | (F.col(order) >= F.col("_held")))
        .drop("_held")
    )


def resolve_selection(
    labels: DataFrame, choices: DataFrame, by: Sequence[str] = ("persona_id", "label"), require_match: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Chosen labels as (ids, unmatched choices). Labels are unique, and a label counts once however
    often it is chosen. `require_match` makes it an error if none matches."""
    by = list(by)
    chosen = choices.select(*by).distinct()
    ids = stage_table(lookup_join(labels.select(*by, "id"), chosen, by), "chosen-ids")
    unmatched = lookup_join(chosen, ids.select(*by), by, "left_anti")
    if require_match and ids.isEmpty():
        raise ValueError("no chosen label belongs to a memory")
    return ids, unmatched


def fetch_by_ids(store: DataFrame, ids: DataFrame, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    """(found, missing) for a request (id, pos): found rows in request order, repeats kept.

    A request that fits is sent to the store's rows, which then stay where they are.
    """
    found = found_by_ids(store, ids)
    missing = lookup_join(ids, present_ids(store, ids), ["id"], "left_anti", ["id", "pos"], stage=True)
    return (found.orderBy("pos") if ordered else found), missing


def found_by_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The found rows of a request (id, pos) alone, in no order."""
    if fits_broadcast(ids):
        found = store.join(F.broadcast(ids), "id")
    else:
        found = shuffle_join(ids, store, ["id"], "inner", spread=["id", "pos"])
    return found.select("id", "pos", *[c for c in store.columns if c != "id"])


def present_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the ids that the store holds, once each."""
    return lookup_join(store.select("id"), ids.select("id").distinct(), ["id"], "left_semi").distinct()


def source_fallback(stored: DataFrame, fresh: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Stored memories, and the fresh ones of each persona for which nothing is stored. With `chosen`, a table
    of ids, only those among the fresh: what nobody chose is not trained on."""
    if chosen is not None:
        fresh = lookup_join(fresh, chosen.select("id").distinct(), ["id"], "left_semi", stage=True)
    have = stored.select("persona_id").distinct()
    return stored.unionByName(lookup_join(fresh, have, ["persona_id"], "left_anti", ["id"], stage=True))


def store_membership(ids: DataFrame, store: DataFrame) -> DataFrame:
    """(id, is_cached) for every id asked for, once each."""
    known = present_ids(store, ids).withColumn("_known", F.lit(True))
    asked = lookup_join(ids.select("id").distinct(), known, ["id"], "left", stage=True)
    return asked.select("id", F.coalesce("_known", F.lit(False)).alias("is_cached"))


def stored_ids(store: DataFrame) -> DataFrame:
    return store.select("id").distinct()


def store_stats(
    store: DataFrame, by: Sequence[str] = (), size: Column | None = None, updated: str | None = None
) -> DataFrame:
    """Number of memories, their size, the last update and whether there are any.

    The size counts the bytes of each memory as JSON, or whatever `size` says.
    """
    size = F.octet_length(F.to_json(F.struct("*"))) if size is None else size
    total = F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
    figures = [
        F.count("*").alias("total_memories"),
        total.alias("size_bytes"),
        F.round(total / F.lit(1024 * 1024), 2).alias("size_mb"),
        (F.count("*") > 0).alias("has_cache"),
    ]
    if updated:
        figures.append(F.max(updated).alias("last_updated"))
    return store.groupBy(*by).agg(*figures)


def workspace_summary(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    pages = F.count_if(F.col("object") == "page")
    databases = F.count_if(F.col("object") == "database")
    return entries.groupBy(*by).agg(
        pages.alias("pages"), databases.alias("databases"), (pages + databases).alias("total_items")
    )


def build_stats(memories: DataFrame, selection: DataFrame | None, examples: DataFrame) -> DataFrame:
    """Per persona: all memories, those selected, and the examples made of them. Counts meet, rows
    do not: each table is counted on its own first."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.select("persona_id", F.lit(name).alias("_what"))

    counted = (
        count(memories, "total")
        .unionByName(count(select_memories(memories, selection), "selected"))
        .unionByName(count(examples, "examples"))
    )

    def tally(name: str) -> Column:
        return F.count_if(F.col("_what") == name).alias(name)

    return counted.groupBy("persona_id").agg(tally("total"), tally("selected"), tally("examples"))
