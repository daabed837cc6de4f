import pytest
from pyspark.sql import functions as F

from persona_spark.operators import ranking, store
from persona_spark.operators.conversations import select_memories

STORE = "id STRING, content STRING, ingest_pos BIGINT"


def as_dict(df):
    return {r.id: r.content for r in df.collect()}


def test_upsert(rows):
    old = rows(STORE, ("a", "a1", 1), ("b", "b1", 2))
    new = rows(STORE, ("b", "b2", 1), ("b", "b3", 5), ("b", "b0", 0), ("", "no", 9), (None, "no", 9), ("c", None, 3))
    once = store.store_upsert(old, new)
    assert as_dict(once) == {"a": "a1", "b": "b3", "c": None}
    assert sorted(map(tuple, store.store_upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_latest_is_one_row_per_id_even_for_copies(rows):
    copies = rows(STORE, *[("x", "t", 1)] * 50, *[("y", f"t{i % 3}", 7) for i in range(30)])
    first = as_dict(store.latest_per_id(copies))
    assert store.latest_per_id(copies).count() == 2
    assert first == as_dict(store.latest_per_id(copies.repartition(5)))


def test_newer_than_store(rows):
    held = rows(STORE, ("a", "", 5), ("b", "", 5))
    batch = rows(STORE, ("a", "old", 4), ("a", "same", 5), ("b", "new", 6), ("c", "first", 1))
    assert sorted(r.content for r in store.newer_than_store(held, batch).collect()) == ["first", "new", "same"]


def test_fetch_in_request_order(rows):
    held = rows(STORE, ("a", "A", 1), ("b", "B", 2))
    ids = rows("id STRING, pos BIGINT", ("b", 0), ("zz", 1), ("a", 2), ("b", 3))
    found, missing = store.fetch_by_ids(held, ids)
    assert [r.content for r in found.collect()] == ["B", "A", "B"]
    assert [(r.id, r.pos) for r in missing.collect()] == [("zz", 1)]


def test_fallback_is_all_or_nothing_per_persona(rows):
    schema = "id STRING, persona_id BIGINT"
    out = store.source_fallback(rows(schema, ("s1", 1)), rows(schema, ("f1", 1), ("f2", 2), ("f3", 2)))
    assert sorted(r.id for r in out.collect()) == ["f2", "f3", "s1"]


def test_membership_and_ids(rows):
    held = rows(STORE, ("a", "", 1), ("a", "", 2))
    asked = rows("id STRING", ("a",), ("a",), ("b",))
    assert sorted(map(tuple, store.store_membership(asked, held).collect())) == [("a", True), ("b", False)]
    assert [r.id for r in store.stored_ids(held).collect()] == ["a"]


def test_stats(rows):
    held = rows(STORE, ("a", "é", 1), ("b", None, 2))
    row = store.store_stats(held, updated="ingest_pos").first()
    assert (row.total_memories, row.has_cache, row.last_updated) == (2, True, 2)
    assert row.size_bytes == len('{"id":"a","content":"é","ingest_pos":1}'.encode()) + len('{"id":"b","ingest_pos":2}')
    empty = store.store_stats(held.where("false")).first()
    assert (empty.total_memories, empty.size_bytes, empty.size_mb, empty.has_cache) == (0, 0, 0.0, False)


def test_summary(rows):
    entries = rows("id STRING, object STRING", ("1", "page"), ("2", "page"), ("3", "database"), ("4", "user"))
    assert tuple(store.workspace_summary(entries).first()) == (2, 1, 3)


def test_build_stats(rows):
    memories = rows("id STRING, persona_id BIGINT", ("a", 1), ("b", 1), ("c", 2))
    chosen = rows("id STRING", ("a",), ("c",))
    got = store.build_stats(memories, chosen, select_memories(memories, chosen).where("id = 'a'")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, 1), (2, 1, 1, 0)]


PAGES = "persona_id BIGINT, id STRING, created_time STRING, ingest_pos BIGINT, label STRING"


def test_display_order(rows):
    df = rows(
        PAGES,
        (1, "a", "2025-01-01", 1, ""), (1, "b", "2025-01-02T00:00:00Z", 2, ""), (1, "c", None, 3, ""), (1, "d", "bad", 4, ""),
        (1, "e", "2025-01-02T00:00:00+00:00", 5, ""), (1, "f", "2025-01-01T23:30:00-05:00", 6, ""), (2, "g", None, 7, ""),
    )
    got = {r.id: r.display_rank for r in ranking.display_order(df).collect()}
    assert got == {"f": 1, "b": 2, "e": 3, "a": 4, "c": 5, "d": 6, "g": 1}


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_display_order_of_one_large_persona(spark, parts):
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("persona_id"),
        F.concat(F.lit("m"), "id").alias("id"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("2025-01-0"), F.col("id") % 3 + 1)).alias("created_time"),
        F.col("id").alias("ingest_pos"),
    ).repartition(parts)
    plain = "row_number() over (partition by persona_id order by created_time desc nulls last, ingest_pos) as display_rank"
    expected = df.selectExpr("id", plain)
    got = ranking.display_order(df).select("id", "display_rank")
    assert got.exceptAll(expected).count() == 0 and got.count() == 3000


def test_last_of_equal_labels(rows):
    df = rows(
        PAGES,
        (1, "a", "2025-01-01T05:00:00", 1, "x"), (1, "b", "2025-01-01T04:00:00", 2, "x"), (1, "c", "2025-01-01T06:00:00", 3, "x"),
        (1, "d", None, 4, "y"), (1, "e", "2020-01-01", 9, "y"), (1, "f", None, 3, "y"), (2, "g", None, 1, "x"),
    )
    assert sorted(map(tuple, ranking.label_lookup(df).collect())) == [(1, "x", "b"), (1, "y", "d"), (2, "x", "g")]


def test_resolve_selection(rows):
    labels = rows("persona_id BIGINT, label STRING, id STRING", (1, "x", "a"), (2, "x", "b"))
    ids, unmatched = store.resolve_selection(labels, rows("persona_id BIGINT, label STRING", (1, "x"), (1, "x"), (1, "q")))
    assert [r.id for r in ids.collect()] == ["a"] and [r.label for r in unmatched.collect()] == ["q"]
    with pytest.raises(ValueError):
        store.resolve_selection(labels, rows("persona_id BIGINT, label STRING", (3, "x")), require_match=True)


@pytest.mark.parametrize("per_bucket", [1, 7, 65_536])
def test_log_tail(spark, per_bucket):
    lines = spark.range(100).select(
        F.when(F.col("id") < 95, "big").otherwise("small").alias("file"), F.col("id").alias("line_no"), F.col("id").alias("line")
    )
    got = ranking.log_tail(lines.repartition(3), 10, per_bucket).collect()
    assert sorted((r.file, r.line, r.truncated) for r in got) == [("big", i, True) for i in range(85, 95)] + [
        ("small", i, False) for i in range(95, 100)
    ]


def test_newest_log(rows):
    lines = rows("file STRING, modified INT", ("a", 1), ("b", 5), ("a", 7), ("c", 5))
    assert [r.file for r in ranking.newest_log(lines).collect()] == ["a", "b", "c"]
    assert [r.file for r in ranking.newest_log(lines, 1).collect()] == ["a"]


def test_large_requests_are_shuffled(spark, rows, monkeypatch):
    from persona_spark import scale

    held = spark.range(300).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("t").alias("content"))
    ids = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "m7").otherwise(F.concat(F.lit("m"), F.col("id") * 3)).alias("id"), F.col("id").alias("pos")
    )
    small = [df.collect() for df in store.fetch_by_ids(held, ids)]
    for name, value in (("PROBE_MAX_ROWS", 2), ("BROADCAST_MAX_ROWS", 2), ("HEAVY_MIN_ROWS", 20), ("ROWS_PER_SALT", 10)):
        monkeypatch.setattr(scale, name, value)
    large = [df.collect() for df in store.fetch_by_ids(held, ids)]
    assert small[0] == large[0] and sorted(small[1]) == sorted(large[1])
    assert len(small[0]) == 150 and len(small[1]) == 50
