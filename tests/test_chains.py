"""Responses put in order by their cursors."""

import random

import pytest

from persona_spark.sources import chains, dumps

SCHEMA = "dump_id long, start_cursor string, next_cursor string, has_more boolean, payload string, at int, steps string"


def chain(dump, n, end=None, more=False):
    """(dump_id, start_cursor, next_cursor, has_more, payload and columns that clash with inner names)"""
    name = lambda k: f"{dump}/{k}"
    return [(dump, name(k) if k else None, name(k + 1) if k < n - 1 else end, k < n - 1 or more, str(k), 1, "s") for k in range(n)]


@pytest.fixture
def shuffled(rows):
    def make(*data):
        data = list(data)
        random.Random(1).shuffle(data)
        return rows(SCHEMA, *data)

    return make


def numbers(df):
    return sorted((r.dump_id, r.response_no, r.payload) for r in chains.number_responses(df).collect())


def faults(df):
    return sorted(map(tuple, chains.chain_faults(df).collect()))


def test_chains_of_many_lengths(shuffled):
    lengths = [1, 2, 3, 4, 5, 8, 9, 64, 65, 300]
    df = shuffled(*[r for d, n in enumerate(lengths) for r in chain(d, n)])
    assert numbers(df) == sorted((d, k, str(k)) for d, n in enumerate(lengths) for k in range(n))
    assert faults(df) == []


def test_a_last_response_may_name_a_cursor(shuffled):
    assert numbers(shuffled(*chain(1, 3, end="1/1"))) == [(1, 0, "0"), (1, 1, "1"), (1, 2, "2")]


def test_faults_are_listed_and_give_nothing(shuffled):
    whole = chain(0, 4)
    loop = chain(1, 3) + [(1, "a", "b", True, "x", 1, "s"), (1, "b", "a", True, "y", 1, "s")]
    back = chain(2, 4, end="2/2", more=True)
    fork = chain(3, 4) + [(3, "3/2", None, False, "again", 1, "s")]
    gap = [r for r in chain(4, 5) if r[4] != "2"]
    headless = chain(5, 4)[1:]
    open_end = chain(6, 2, more=True)
    repeated = chain(7, 2) * 2
    start_again = chain(8, 1) + [(8, "8/x", None, False, "z", 1, "s")]
    df = shuffled(*whole, *loop, *back, *fork, *gap, *headless, *open_end, *repeated, *start_again)
    assert numbers(df) == [(0, k, str(k)) for k in range(4)]
    found = faults(df)
    assert {d for d, _ in found} == set(range(1, 9))
    assert {(1, "loop"), (2, "join"), (3, "fork"), (4, "gap"), (5, "no start"), (6, "open"), (7, "fork"), (8, "loose")} <= set(found)


def test_nulls_and_empty(shuffled, rows):
    assert numbers(shuffled((None, None, None, False, "p", 1, "s"), *chain(1, 2))) == [(1, 0, "0"), (1, 1, "1")]
    assert numbers(rows(SCHEMA)) == [] and faults(rows(SCHEMA)) == []
    assert numbers(shuffled((1, None, None, None, "p", 1, "s"))) == [(1, 0, "p")]


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(chains, "stage_table", lambda df, name: staged.append(name) or stage(df, name))
    from persona_spark.session import stage_table as stage

    for n, most in ((16, 5), (256, 9)):
        staged.clear()
        df = spark.createDataFrame(chain(1, n), SCHEMA)
        assert chains.number_responses(df).count() == n
        assert staged.count("ranks") <= most


def test_numbered_responses_give_pages(spark, rows):
    page = "struct<id: string, object: string, created_time: string, properties: map<string, string>, _content: string, _blocks: array<map<string, string>>>"
    schema = f"dump_id long, persona_id long, start_cursor string, next_cursor string, has_more boolean, results array<{page}>"
    listed = [(9, 1, None if k == 0 else f"c{k}", f"c{k + 1}" if k < 3 else None, k < 3, [(f"p{k}{e}", "page", None, None, None, None) for e in range(2)]) for k in (2, 0, 3, 1)]
    out = dumps.page_responses(chains.number_responses(rows(schema, *listed))).orderBy("ingest_pos").collect()
    assert [r.id for r in out] == [f"p{k}{e}" for k in range(4) for e in range(2)]
