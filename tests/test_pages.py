import json

import pytest
from pyspark.sql import functions as F

from persona_spark.functions import pages as P
from persona_spark.functions.text import WHITE_SPACE, has_text, strip, words
from persona_spark.model import PAGE
from persona_spark.operators import pages


def page_table(spark, *page_dicts):
    raw = spark.createDataFrame([(json.dumps(p),) for p in page_dicts], "value STRING")
    return raw.select(F.from_json("value", PAGE).alias("p")).select("p.*")


def para(*segments, kind="paragraph"):
    return {"type": kind, kind: {"rich_text": [{"plain_text": s} for s in segments]}}


def title(*segments):
    return {"type": "title", "title": [{"plain_text": s} for s in segments]}


def test_flatten_blocks(spark):
    nested = para("outer")
    nested["children"] = [para("inner")]
    df = page_table(
        spark,
        {"id": "a", "_blocks": [para("one ", "two"), {"type": "divider", "divider": {}}, para(kind="heading_1"), para("end")]},
        {"id": "b", "_blocks": []},
        {"id": "c"},
        {"id": "d", "_blocks": [nested, {"type": "image", "image": {"url": "u"}}, para("ü\n\"q\"")]},
        {"id": "e", "_blocks": [{"type": "paragraph", "paragraph": {"rich_text": [{"href": "x"}, {"plain_text": "y"}]}}]},
        {"id": "f", "_blocks": [{"type": "gone"}, {"paragraph": {}}]},
    )
    got = {r.id: r.content for r in pages.flatten_blocks(df).collect()}
    assert got == {"a": "one two\n\nend", "b": "", "c": None, "d": 'outer\nü\n"q"', "e": "y", "f": ""}


def test_display_title(spark):
    df = page_table(
        spark,
        {"id": "p1", "properties": {"Tags": {"type": "multi_select"}, "T": title("My ", "day ")}},
        {"id": "p2", "properties": {"T": title(" "), "Name": title("Named")}},
        {"id": "0123456789abcdef", "properties": {}},
        {"id": "", "properties": {"T": title()}},
        {"properties": {"Name": {"type": "rich_text", "title": [{"plain_text": "no"}]}}},
        {"id": "p3", "properties": {"First": title("first"), "Second": title("second")}},
        {"id": "short"},
    )
    got = [r.display_title for r in pages.display_title(df).collect()]
    assert got == ["My day", "Named", "Page 89abcdef", "Untitled Page", "Untitled Page", "first", "Page short"]


def test_prompt_title_differs_from_display_title(spark):
    df = page_table(
        spark,
        {"id": "1", "properties": {"title": title(" One ", "two")}},
        {"id": "2", "properties": {"Name": title("Named")}},
        {"id": "3", "properties": {"title": title()}},
        {"id": "4", "properties": {"title": {"type": "rich_text"}}},
    ).withColumn("title", F.lit("plain"))
    got = [r.title for r in pages.prompt_title(df).orderBy("id").collect()]
    assert got == [" One ", "plain", "Memory", "Memory"]


@pytest.mark.parametrize(
    "value,day",
    [
        ("2025-10-30T09:15:00.000Z", "2025-10-30"),
        ("2025-10-30", "2025-10-30"),
        ("2025-10-30T23:30:00-05:00", "2025-10-30"),
        ("2025-10-30 00:10+14:00", "2025-10-30"),
        ("30-10-2025", None),
        ("2025-10", None),
        ("2025", None),
        ("2025-02-30", None),
        ("2025-10-30T25:00", None),
        ("2025-10-30T09:15:00.000Z and more", None),
        ("0000-01-01", None),
        ("", None),
        (None, None),
    ],
)
def test_created_date(rows, value, day):
    df = rows("t STRING", (value,)).select(P.created_date(F.col("t")).cast("string"))
    assert df.first()[0] == day


def test_display_label(rows):
    df = rows("display_title STRING, created_time STRING", ("A", "2025-10-03T09:15:00.000Z"), ("B", "?"))
    assert [r.label for r in pages.display_label(df).collect()] == ["A (Oct 03, 2025)", "B"]


def test_first_truthy_and_blank(rows):
    df = rows(
        "id STRING, content STRING, alt_content STRING, date STRING, created_time STRING",
        ("1", "", "alt", "", "c"),
        ("2", "  \n", "alt", "d", "c"),
        ("3", None, None, None, None),
        ("4", "  ", "", "", ""),
        ("5", " x ", "alt", None, "c"),
    )
    settled = pages.first_truthy_fields(df)
    assert [(r.content, r.created_time) for r in settled.orderBy("id").collect()] == [
        ("alt", "c"), ("  \n", "d"), (None, None), ("  ", None), (" x ", "c"),
    ]
    assert [r.id for r in pages.drop_blank(settled).orderBy("id").collect()] == ["1", "5"]


def test_white_space_is_that_of_python(rows):
    spaces = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    assert set(WHITE_SPACE) == set(spaces)
    data = [(i, f"{c}a{c}b c{c}{c}") for i, c in enumerate(spaces)]
    df = rows("i INT, t STRING", *data)
    got = df.select("i", strip(F.col("t")).alias("s"), words(F.col("t")).alias("w"), has_text(F.lit("x")).alias("h"))
    for r, (_, t) in zip(got.orderBy("i").collect(), data):
        assert (r.s, r.w) == (t.strip(), t.split())
    assert not any(r[0] for r in rows("t STRING", *[(c * 3,) for c in spaces]).select(has_text(F.col("t"))).collect())


def test_union_pages_fills_missing_columns(rows):
    out = pages.union_pages(rows("id STRING, a INT", ("x", 1)), rows("id STRING, b INT", ("x", 2)))
    assert sorted(map(tuple, out.collect()), key=str) == [("x", 1, None), ("x", None, 2)]


def test_object_split(rows):
    df = rows("id STRING, object STRING", ("1", "page"), ("2", "database"), ("3", "user"), ("4", None))
    found, databases = pages.object_split(df)
    assert [r.id for r in found.collect()] == ["1"] and [r.id for r in databases.collect()] == ["2"]


@pytest.mark.parametrize("kind", ["DATE", "TIMESTAMP", "TIMESTAMP_NTZ"])
def test_times_of_other_types_count_as_their_text(spark, kind):
    """Label, prompts and order of a date or timestamp are those of its text."""
    from persona_spark.functions.templates import PromptPool
    from persona_spark.operators.conversations import prompt_candidates
    from persona_spark.operators.ranking import display_order

    pool = PromptPool(identity=[], about_title=["What of {title}?"], open_ended=[], greetings=[], about_date=["And {date}?"])
    days = ["2025-01-02", "2024-12-31", None]
    typed = spark.createDataFrame([(str(k), 1, k, "T", d, "2020-02-02") for k, d in enumerate(days)], "id STRING, persona_id INT, ingest_pos INT, title STRING, d STRING, created_time STRING")
    seen = {}
    for name, date in (("typed", F.col("d").cast(kind)), ("text", F.col("d"))):
        settled = pages.first_truthy_fields(typed.withColumn("date", date).withColumn("created_time", F.col("created_time").cast(kind if name == "typed" else "string")).drop("d"))
        assert dict(settled.dtypes)["created_time"] == "string"
        labels = pages.display_label(settled, "title").select("id", "created_date", "label")
        prompts = prompt_candidates(settled, pool).select("id", "candidates")
        ranks = display_order(settled).select("id", "display_rank")
        seen[name] = [sorted(map(tuple, df.collect())) for df in (labels, prompts, ranks)]
    assert seen["typed"] == seen["text"]
    assert [str(r[1]) for r in seen["typed"][0]] == ["2025-01-02", "2024-12-31", "2020-02-02"]
    direct = display_order(typed.withColumn("created_time", F.col("d").cast(kind)))
    assert {r.id: r.display_rank for r in direct.collect()} == {"0": 1, "1": 2, "2": 3}
