import gzip
import json

import pytest
from pyspark.sql import functions as F

from persona_spark.model import MEMORY
from persona_spark.operators.store import stored_ids
from persona_spark.plans.ingest import browse_list, ingest_memories
from persona_spark.sources import dumps, logs, store, training_set
from persona_spark.streaming import refresh as refresh_module
from persona_spark.streaming.refresh import memory_store, refresh_stream


def page(i, text, **more):
    block = {"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": text}]}}
    return {"id": i, "object": "page", "created_time": "2025-01-01T00:00:00.000Z", "properties": {}, "_blocks": [block], **more}


def response(dump, no, pages, more, persona=1):
    return {"dump_id": dump, "persona_id": persona, "response_no": no, "results": pages, "has_more": more, "next_cursor": None}


def save(folder, name, *responses, broken=""):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in responses) + broken)


def listed(spark, folder):
    out = dumps.page_responses(dumps.read_responses(spark, str(folder)))
    return [(r.dump_id, r.id) for r in out.orderBy("ingest_pos").collect()]


def test_only_whole_chains_count(spark, tmp_path):
    d = tmp_path / "in"
    save(d, "a.json", response(2, 1, [page("c", "")], False), response(2, 0, [page("a", ""), page("b", "")], True))
    save(d, "open.json", response(3, 0, [page("x", "")], True))
    save(d, "gap.json", response(4, 0, [page("x", "")], True), response(4, 2, [page("x", "")], False))
    save(d, "late.json", response(5, 1, [page("x", "")], False))
    save(d, "ends_early.json", response(6, 0, [page("x", "")], False), response(6, 1, [page("x", "")], False))
    save(d, "twice.json", response(7, 0, [page("x", "")], False), response(7, 0, [page("x", "")], False))
    save(d, "empty.json", response(8, 0, [], False))
    save(d, "first.json", response(1, 0, [page("a", "")], None))
    save(d, "broken.json", response(9, 0, [page("x", "")], True), broken='{"dump_id": 9, "resp')
    assert listed(spark, d) == [(1, "a"), (2, "a"), (2, "b"), (2, "c")]


def test_a_response_larger_than_its_place_is_an_error(spark, tmp_path):
    save(tmp_path, "a.json", response(1, 0, [{"id": str(i)} for i in range(129)], False))
    with pytest.raises(Exception, match="no number of entries in a response"):
        listed(spark, tmp_path)


def test_dumps_numbered_by_milliseconds(spark, tmp_path):
    save(tmp_path, "a.json", response(1764585600001, 0, [page("b", "")], False), response(1764585600000, 0, [page("a", "")], False))
    assert [i for _, i in listed(spark, tmp_path)] == ["a", "b"]


def test_dumps_of_any_length_and_number_keep_their_order(spark):
    """Positions alone, for chains too long to write down here."""
    top = (1 << 63) - 1
    numbers = [0, 1, 16_383, 16_384, 65_535, 65_536, 65_537, 131_072, 10**9, (1 << 48) - 1]
    places = [(d, n, e) for d in (0, 1, 1764585600000, 1764585600001, top - 1, top) for n in numbers for e in (0, 127)]
    rows = spark.createDataFrame(places, "dump_id BIGINT, response_no BIGINT, _entry_no INT")
    got = rows.withColumn("p", dumps.ingest_position()).orderBy("p").collect()
    assert [tuple(r)[:3] for r in got] == places and len({r.p for r in got}) == len(places)


def test_a_dump_of_more_than_16384_responses_is_read(spark, tmp_path):
    n = 17_000
    save(tmp_path, "a.json", *[response(1, i, [{"id": str(i), "object": "page"}], i < n - 1) for i in range(n)])
    assert listed(spark, tmp_path) == [(1, str(i)) for i in range(n)]


def test_ingest_takes_the_newest_page(spark, tmp_path):
    save(tmp_path, "a.json", response(1, 0, [page("a", "one"), {"id": "d", "object": "database"}], False))
    save(tmp_path, "b.json", response(2, 0, [page("a", "two"), page("", "none"), page("b", "x", _content="given")], False))
    got = ingest_memories(dumps.read_responses(spark, str(tmp_path))).orderBy("id").collect()
    assert [(r.id, r.title, r.content, r.alt_content) for r in got] == [("a", "Memory", None, "two"), ("b", "Memory", None, "given")]


def test_json_store_passes_over_broken_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "content": "ü", "ingest_pos": 1}, indent=2))
    (tmp_path / "b.json").write_text('{"id": "b", "content": ')
    got = store.read_json_store(spark, str(tmp_path), MEMORY, multi_line=True).collect()
    assert [(r.id, r.content) for r in got] == [("a", "ü")]
    broken = store.broken_documents(spark, str(tmp_path), MEMORY, multi_line=True).collect()
    assert [(r.file.rsplit("/", 1)[1], r.document) for r in broken] == [("b.json", '{"id": "b", "content": ')]


def test_a_broken_parquet_file_is_no_silent_loss(spark, rows, tmp_path):
    rows("id STRING", ("a",)).coalesce(1).write.parquet(str(tmp_path / "s"))
    (tmp_path / "s" / "part-x.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        store.read_parquet_store(spark, str(tmp_path / "s"), "id STRING").count()
    assert store.read_parquet_store(spark, str(tmp_path / "s"), "id STRING", skip_broken=True).count() == 1


def test_a_broken_json_file_is_no_silent_loss(spark, tmp_path):
    whole = gzip.compress("".join(json.dumps({"id": str(i), "ingest_pos": i}) + "\n" for i in range(5000)).encode())
    for name, data in (("a", whole), ("b", whole[: len(whole) // 2])):
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / "s" / f"{name}.json.gz").write_bytes(data)
    with pytest.raises(Exception):
        store.read_json_store(spark, str(tmp_path / "s"), MEMORY).collect()
    assert 5000 <= len(store.read_json_store(spark, str(tmp_path / "s"), MEMORY, skip_broken=True).collect()) < 10_000


def test_a_broken_dump_file_is_no_silent_loss(spark, tmp_path):
    save(tmp_path / "d", "a.json", response(1, 0, [page("a", "")], False), response(2, 0, [page("b", "")], True))
    rest = gzip.compress("".join(json.dumps(response(2, 1, [page(f"{i}", f"{i * i}") for i in range(100)], False)) + "\n").encode())
    (tmp_path / "d" / "b.json.gz").write_bytes(rest[: len(rest) // 2])
    with pytest.raises(Exception):
        listed(spark, tmp_path / "d")
    read = dumps.read_responses(spark, str(tmp_path / "d"), skip_broken=True)
    assert [r.id for r in dumps.page_responses(read).collect()] == ["a"]
    assert [(r.dump_id, r.n_responses, r.last_response, r.n_broken) for r in dumps.incomplete_dumps(read).collect()] == [(2, 1, 0, 0)]


def test_store_read(spark, rows, tmp_path):
    rows("id STRING, content STRING", ("a", "A"), ("b", "B")).write.parquet(str(tmp_path / "s"))
    held = store.read_parquet_store(spark, str(tmp_path / "s"))
    ids = rows("id STRING, pos BIGINT", ("b", 1), ("q", 2))
    assert [r.content for r in store.store_read(held, ids).collect()] == ["B"]
    assert store.store_read(held, ids.where("false")).count() == store.store_read(held).count() == 2


STORED = "id STRING, content STRING, ingest_pos BIGINT"


def bucketed(spark, rows, path, **more):
    return store.BucketedStore(spark, str(path), rows(STORED, ("", "", 0)).schema, **more)


def test_bucketed_store(spark, rows, tmp_path):
    files = bucketed(spark, rows, tmp_path / "s", buckets=4)
    assert files.read().count() == 0 and files.next_batch() == 0
    files.upsert(rows(STORED, *[(f"i{k}", "v1", k) for k in range(40)]))
    before = files.read()
    files.upsert(rows(STORED, ("i3", "v2", 1), ("new", "v2", 100), ("", "no", 1), (None, "no", 1)))
    assert files.next_batch() == 2
    got = {r.id: r.content for r in files.read().collect()}
    assert len(got) == 41 and got["i3"] == got["new"] == "v2" and got["i4"] == "v1"
    assert {r.content for r in before.collect()} == {"v1"}  # a reader keeps what it opened
    by_position = bucketed(spark, rows, tmp_path / "s", buckets=4, newest=("ingest_pos", "batch"))
    assert {r.id: r.content for r in by_position.read().collect()}["i3"] == "v1"  # no row gives way to an older one
    files.upsert(rows(STORED, ("new", "v3", 1)), batch=1)  # the second batch again
    assert {r.id: r.content for r in files.read().collect()} == {f"i{k}": "v1" for k in range(40)} | {"new": "v3"}


def test_a_store_is_rewritten_with_another_number_of_buckets(spark, rows, tmp_path):
    files = bucketed(spark, rows, tmp_path / "s", buckets=4)
    for version in ("v1", "v2", "v3"):
        files.upsert(rows(STORED, *[(f"i{k}", version, k) for k in range(20)]))
    fresh = files.rewrite(str(tmp_path / "t"), buckets=7)
    assert sorted(fresh.read().collect()) == sorted(files.read().collect())
    assert fresh._rows().count() == 20 and files._rows().count() == 60
    fresh.upsert(rows(STORED, ("i1", "v4", 1)))
    assert [r.content for r in fresh.fetch(rows("id STRING, pos INT", ("i1", 0))).collect()] == ["v4"]


def files_read(df):
    """Number of files that the scans of a plan have opened."""
    df.collect()

    def opened(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return opened(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return opened(plan.plan())
        own = plan.metrics().get("numFiles").get().value() if plan.nodeName().startswith("Scan parquet") else 0
        return own + sum(opened(plan.children().apply(i)) for i in range(plan.children().size()))

    return opened(df._jdf.queryExecution().executedPlan())


def test_a_request_opens_only_the_folders_of_its_ids(spark, rows, tmp_path, monkeypatch):
    files = bucketed(spark, rows, tmp_path / "s", buckets=64)
    files.upsert(spark.range(5000).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("v").alias("content"), F.col("id").alias("ingest_pos")))
    asked = rows("id STRING, pos INT", *[(f"i{k}", k) for k in range(12)], ("i3", 99), ("missing", 5), (None, 6))
    buckets = {r.b for r in asked.where("id is not null").select(files._bucket().alias("b")).distinct().collect()}
    assert files_read(files.read()) == 64 and files_read(files.narrowed(asked)) == len(buckets) <= 13
    found = sorted((r.id, r.pos) for r in files.fetch(asked).collect())
    assert found == sorted([(f"i{k}", k) for k in range(12)] + [("i3", 99)])
    monkeypatch.setattr("persona_spark.scale.PROBE_MAX_ROWS", 2)  # a large request reads all and finds the same
    assert sorted((r.id, r.pos) for r in files.fetch(asked).collect()) == found


def test_files_have_bloom_filters_on_ids(spark, rows, tmp_path):
    import pyarrow.parquet as pq

    files = bucketed(spark, rows, tmp_path / "s", buckets=1)
    files.upsert(spark.range(5000).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("v").alias("content"), F.col("id").alias("ingest_pos")))
    few = files.narrowed(rows("id STRING, pos INT", ("i77", 1)))
    scan = next(x for x in few._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "EqualTo(id,i77)" in scan.split("PushedFilters: ")[1]
    assert [r.id for r in few.collect()] == ["i77"]
    jvm = spark._jvm
    name = next(p for p in (tmp_path / "s").rglob("*.parquet"))
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(name)), jvm.org.apache.hadoop.conf.Configuration())
    columns = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file).getFooter().getBlocks().get(0).getColumns()
    assert [columns.get(k).getBloomFilterOffset() > 0 for k in range(2)] == [True, False]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_training_set(spark, tmp_path, fmt):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5).alias("persona_id"), F.lit("t").alias("text"))
    training_set.write_training_set(df, str(tmp_path / "t"), fmt)
    back = spark.read.schema(df.schema).format(fmt).load(str(tmp_path / "t"))
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == 100
    with pytest.raises(ValueError):
        training_set.write_training_set(df, str(tmp_path / "u"), "csv")


def test_log_lines_keep_their_numbers_across_splits(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 3), ("empty.log", 0), ("c.txt", 9)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\r\n" if i == 2 else f"{name} line {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = logs.log_read(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5003
    assert all(r.line.rstrip("\r") == f"{r.file} line {r.line_no}" for r in got)


def test_stream_equals_batch_whatever_arrives_when(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def refresh():
        refresh_stream(spark, str(folder), out, checkpoint, files_per_batch=1).awaitTermination()
        rows = memory_store(spark, out).read().collect()
        return {r.id: (r.alt_content, r.ingest_pos) for r in rows}

    save(folder / "dump_id=5", "r1.json", response(5, 1, [page("b", "b5")], False))
    assert refresh() == {}
    save(folder / "dump_id=9", "r0.json", response(9, 0, [page("a", "a9"), page("c", "c9")], False))
    save(folder / "dump_id=7", "r0.json", response(7, 0, [page("a", "a7")], True))
    assert {k: v[0] for k, v in refresh().items()} == {"a": "a9", "c": "c9"}
    save(folder / "dump_id=5", "r0.json", response(5, 0, [page("a", "a5")], True))  # late: completes an older dump
    final = refresh()
    assert {k: v[0] for k, v in final.items()} == {"a": "a9", "b": "b5", "c": "c9"}
    batch = ingest_memories(dumps.read_responses(spark, str(folder))).collect()
    assert {r.id: (r.alt_content, r.ingest_pos) for r in batch} == final == refresh()


def states(spark, tmp_path, *batches, wait="30 days"):
    """(dump_id, what) told by each batch of files, each run after a restart."""
    told = []
    for k, batch in enumerate(batches):
        save(tmp_path / "in", f"b{k}.json", *batch)
        seen = refresh_module.close_chains(refresh_module.pending_responses(spark, str(tmp_path / "in"), str(tmp_path / "w")), wait)
        rows = []
        refresh_module.start_available(seen, str(tmp_path / "ck"), lambda b, _, rows=rows: rows.extend(map(tuple, b.collect()))).awaitTermination()
        told.append(sorted(rows))
    return told


def test_chains_close_once_and_only_when_whole(spark, tmp_path):
    part = lambda d, no, more: response(d, no, [page(f"{d}{no}", "")], more)
    told = states(
        spark, tmp_path,
        [part(1, 0, False), part(2, 1, True), part(3, 0, True), part(4, 0, False), part(4, 0, False), part(5, 0, None)],
        [part(2, 0, True), part(3, 2, False), part(6, 1, False), part(6, 0, False)],
        [part(2, 2, False), part(1, 0, False), part(5, 1, False)],
    )
    assert told == [[(1, "closed"), (5, "closed")], [], [(2, "closed")]]


def test_chains_that_never_close_are_given_up(spark, tmp_path):
    part = lambda d, no, more: response(d, no, [page(f"{d}{no}", "")], more)
    told = states(spark, tmp_path, [part(1, 0, True)], [part(2, 0, True)], [part(1, 1, False)], wait="1 milliseconds")
    assert told[0] == [] and (1, "given up") in told[1]
    assert (1, "closed") not in told[2]  # the rest came too late


def test_a_batch_reads_only_chains_that_closed(spark, tmp_path, monkeypatch):
    read = []
    real = refresh_module.closed_responses
    monkeypatch.setattr(refresh_module, "closed_responses", lambda *a: read.append(real(*a)) or read[-1])
    for k in range(6):
        save(tmp_path / "in", f"d{k}.json", response(k, 0, [page(f"p{k}", "")], k == 5))
        refresh_stream(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert files_read(read[0]) == 1  # that of its own folder
    assert [sorted(r.dump_id for r in df.collect()) for df in read] == [[0], [1], [2], [3], [4]]
    assert memory_store(spark, str(tmp_path / "s")).read().count() == 5


def test_log_lines_survive_another_split_size(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(50_000)))
    lines = logs.log_read(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = lines.selectExpr("count(*) AS n", "count(DISTINCT line_no) AS d", "sum(CAST(line = concat('line ', line_no - 1) AS INT)) AS ok").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == (50_000, 50_000, 50_000)


def test_copies_of_a_page_are_listed_once_each(rows):
    schema = "id STRING, created_time STRING, properties MAP<STRING, STRING>, persona_id BIGINT, ingest_pos BIGINT"
    pages = rows(schema, *[("a", "2025-01-02", {}, 1, i) for i in range(3)])
    assert sorted(r.display_rank for r in browse_list(pages).collect()) == [1, 2, 3]


def test_a_batch_of_a_stream_has_a_file_per_folder(spark, tmp_path):
    pages = [page(f"p{i}", "x") for i in range(60)]
    for k in range(2):
        save(tmp_path / "in", f"d{k}.json", response(k, 0, pages, False))
    refresh_stream(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), buckets=4).awaitTermination()
    assert sorted(p.parent.name for p in (tmp_path / "s").rglob("*.parquet")) == [f"id_bucket={b}" for b in range(4)]
    stored = memory_store(spark, str(tmp_path / "s"), 4).read()
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()  # one batch: each id once
    assert sorted((r.id, int(r.ingest_pos) >> 27) for r in stored.collect()) == sorted((f"p{i}", 1) for i in range(60))
