import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from persona_spark.operators import checks


#: name, age, the codes expected
PEOPLE = [
    (None, None, ["name_missing"]), ("", "", ["name_missing"]), (" ", "5", ["name_missing", "name_too_short"]),
    ("X", "-1", ["age_out_of_range", "name_too_short"]), ("Bob", "0", []), ("Bob", "150", []), ("Bob", "151", ["age_out_of_range"]),
    ("Bob", "+5", []), ("Bob", " 25 ", []), ("Bob", "1_00", []), ("Bob", "1__0", ["age_not_integer"]), ("Bob", "_1", ["age_not_integer"]),
    ("Bob", "3.5", ["age_not_integer"]), ("Bob", "1e2", ["age_not_integer"]), ("Bob", " ", ["age_not_integer"]),
    ("Bob", "9" * 60, ["age_out_of_range"]), ("Bob", "-" + "9" * 60, ["age_out_of_range"]), ("Bob", "0" * 60 + "7", []),
    ("n" * 100, "5", []), ("n" * 101, "x", ["age_not_integer", "name_too_long"]), ("é", "-0", ["name_too_short"]),
    ("Bob", "+-5", ["age_not_integer"]),
]


def test_persona_errors(rows):
    df = rows("i INT, name STRING, age STRING", *[(i, *p[:2]) for i, p in enumerate(PEOPLE)])
    valid, rejected = checks.validate_personas(df)
    bad = {r.i: r.errors for r in rejected.collect()}
    assert bad == {i: codes for i, (_, _, codes) in enumerate(PEOPLE) if codes}
    assert {r.i for r in valid.collect()} == {i for i, p in enumerate(PEOPLE) if not p[2]}


def test_personas_without_columns(rows):
    valid, rejected = checks.validate_personas(rows("persona_id BIGINT", (1,)))
    assert valid.count() == 0 and rejected.first().errors == ["name_missing"]


@pytest.mark.parametrize(
    "name,error",
    [
        (None, "empty"), ("", "empty"), ("abc", "no_separator"), ("a/b/c", "too_many_separators"), ("//", "too_many_separators"),
        ("/a", "empty_half"), ("a/", "empty_half"), ("/", "empty_half"), ("-a/b", "illegal_characters"), ("a/b c", "illegal_characters"),
        ("a/é", "illegal_characters"), ("a.b_c-1/D.2", None), ("a/b\n", None), ("a/b\r", "illegal_characters"),
    ],
)
def test_model_names(rows, name, error):
    assert checks.validate_model_names(rows("model_name STRING", (name,))).first().error == error


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["<", ":", "/", "?|", '"*', ">\\"]), st.sampled_from([" ", "  ", "_ "]), st.sampled_from(["ab", "é", "c\t"])), min_size=1, max_size=9), min_size=20, max_size=30))
def test_file_names(spark, parts):
    """Names put together from forbidden signs, gaps and words, so that what must remain is known."""
    names = [("".join(bad + gap + word for bad, gap, word in name), "".join("_" + word for _, _, word in name)) for name in parts]
    df = spark.createDataFrame(names, "name STRING, expected STRING")
    assert [(r.file_name, r.expected) for r in checks.sanitize_names(df).collect()] == [(e, e) for _, e in names]
