"""The saved responses that the checks make of documents."""

import re

import pytest

from persona_checks.fixtures import Tables


@pytest.fixture
def tables(spark, tmp_path):
    documents = [(i, f"text {i}", "web", "en") for i in (*range(0, 70), 3)]  # one twice
    events = [(i, "2025-01-02 03:04:05", "error" if i == 101 else "view") for i in (*range(0, 65), 64, 100, 101)]
    made = {
        "documents": spark.createDataFrame(documents, "doc_id BIGINT, text STRING, source STRING, lang STRING"),
        "events": spark.createDataFrame(events, "event_id BIGINT, ts STRING, event_type STRING").selectExpr("event_id", "CAST(ts AS TIMESTAMP) ts", "event_type"),
        "labels": spark.createDataFrame([(5,), (5,), (12,)], "doc_id BIGINT"),
    }
    for name, df in made.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return Tables(spark, str(tmp_path))


def test_responses(tables):
    got = {(r.dump_id, r.response_no): r for r in tables.responses().collect()}
    assert len(got) == 14
    ids = lambda d, no: [p.id for p in got[d, no].results]
    assert ids(0, 0) == ["m0", "m1", "m2", "m3", "m3", *[f"m{i}" for i in range(4, 10)]]
    assert ids(1000000, 0) == ["m0", "m1", "m2", "m3", "m3", "m4", "m5", *[f"m{i}" for i in range(5, 10)]]  # labelled twice
    assert ids(1, 1) == ["m60", "m61", "m62", "m63", "m64", "m64"]  # an event twice, documents without one
    line = lambda d, no, k: got[d, no].results[k]._blocks[1].paragraph.rich_text[0].plain_text
    assert (line(0, 1, 2), line(1000000, 1, 2), line(1000000, 1, 3)) == ("text 12", "v2 text 12", "text 13")
    assert [(got[k].has_more, got[k].next_cursor) for k in ((0, 3), (0, 4), (1, 1), (1000001, 1))] == [
        (True, "after-3"), (False, None), (False, None), (True, None),
    ]


def test_texts_move_once(spark, tables):
    """However large the other tables are: whatever does not fit a broadcast is shuffled as numbers."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    try:
        query = tables.responses()._jdf.queryExecution()
        plan = query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        for name in names:
            spark.conf.unset(name)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) > 3
    assert [m for m in moved if "text#" in m or "results#" in m] == [m for m in moved if "lang#" in m]
    assert sum("lang#" in m for m in moved) == 1
