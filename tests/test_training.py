import hashlib
import math
import random

import pytest

from persona_spark.operators import training


def examples(spark, n, personas=3, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        persona = 0 if rng.random() < 0.5 else rng.randrange(personas)
        words = [f"w{i}_{k}" for k in range(rng.choice([0, 1, 3, 7, 40]))]
        data.append((persona, f"e{i}", i * 3, " ".join(words)))
    return data, spark.createDataFrame(data, "persona_id BIGINT, id STRING, ingest_pos BIGINT, text STRING")


@pytest.mark.parametrize("max_len,per_bucket", [(10, 65_536), (10, 16), (1, 8), (1000, 16), (7, 1), (3, 2)])
def test_packing_loses_no_token(spark, max_len, per_bucket):
    data, df = examples(spark, 120)
    got = training.pack_sequences(df.repartition(5), max_len, per_bucket=per_bucket).orderBy("persona_id", "block_id").collect()
    for persona in {d[0] for d in data}:
        tokens = [(d[1], w) for d in sorted(data, key=lambda d: d[2]) if d[0] == persona for w in d[3].split()]
        blocks = [r for r in got if r.persona_id == persona]
        assert [r.block_id for r in blocks] == list(range(math.ceil(len(tokens) / max_len)))
        for r in blocks:
            part = tokens[r.block_id * max_len : (r.block_id + 1) * max_len]
            assert r.text.split(" ") == [w for _, w in part] and r.n_tokens == len(part)
            assert r.members == list(dict.fromkeys(i for i, _ in part))


def plain_schedule(ids, batch, accum, max_steps, epochs, seed):
    per_step = batch * accum
    steps = math.ceil(len(ids) / per_step)
    out = []
    for epoch in range(epochs if max_steps is None else math.ceil(max_steps / steps)):
        order = sorted(ids, key=lambda i: hashlib.md5(f"{i}:{epoch}:{seed}".encode()).hexdigest())
        for pos, i in enumerate(order):
            step = epoch * steps + pos // per_step
            if max_steps is None or step < max_steps:
                out.append((epoch, step, pos // batch, i))
    return sorted(out)


@pytest.mark.parametrize("per_bucket", [20, 65_536])
@pytest.mark.parametrize("batch,accum,max_steps,epochs", [(2, 4, 7, 1), (1, 8, None, 2), (3, 2, 1, 1), (2, 4, 60, 1)])
def test_schedule(spark, batch, accum, max_steps, epochs, per_bucket):
    data, df = examples(spark, 90)
    got = training.training_schedule(df.repartition(4), batch, accum, max_steps, epochs, 5, per_bucket=per_bucket).collect()
    for persona in {d[0] for d in data}:
        ids = [d[1] for d in data if d[0] == persona]
        mine = sorted((r.epoch, r.step, r.micro_batch, r.id) for r in got if r.persona_id == persona)
        assert mine == plain_schedule(ids, batch, accum, max_steps, epochs, 5)


def test_schedule_without_groups(spark):
    data, df = examples(spark, 50)
    got = training.training_schedule(df, 2, 4, None, 1, 9, keys=())
    assert sorted(map(tuple, got.collect())) == plain_schedule([d[1] for d in data], 2, 4, None, 1, 9)


def test_steps_must_be_positive(spark):
    with pytest.raises(ValueError):
        training.training_schedule(examples(spark, 3)[1], max_steps=0)


def test_offsets_match_a_running_sum(spark):
    lengths = [(k % 2, f"i{k}", k * 1000, (k * 7) % 11) for k in range(200)]
    df = spark.createDataFrame(lengths, "persona_id BIGINT, id STRING, ingest_pos BIGINT, n_tokens BIGINT")
    got = {r.id: r.offset for r in training.running_offsets(df, ["persona_id"], per_bucket=16).collect()}
    sums = [0, 0]
    for persona, i, _, n in lengths:
        assert got[i] == sums[persona]
        sums[persona] += n


def packed(df, max_len, **more):
    return {(r.persona_id, r.block_id): (r.members, r.text) for r in training.pack_sequences(df, max_len, **more).collect()}


@pytest.mark.parametrize("dumps", [[2**52 - 1, 2**52, 2**52 + 1], [1_700_000_000_000_000_000 + k for k in (0, 1, 10**15)], [0, 10**6, 2 * 10**6]])
def test_order_of_dumps_of_any_number(spark, dumps):
    from pyspark.sql import functions as F

    from persona_spark.sources.dumps import ingest_position

    rows = [(1, f"e{k}", d, 0, e, f"w{k}") for k, (d, e) in enumerate((d, e) for d in dumps for e in range(3))]
    df = spark.createDataFrame(rows, "persona_id BIGINT, id STRING, dump_id BIGINT, response_no BIGINT, _entry_no INT, text STRING")
    df = df.select("persona_id", "id", ingest_position().alias("ingest_pos"), "text").orderBy(F.rand(1))
    for per_bucket in (2, 65_536):
        assert packed(df, 4, per_bucket=per_bucket) == {
            (1, b): ([f"e{k}" for k in range(4 * b, min(9, 4 * b + 4))], " ".join(f"w{k}" for k in range(4 * b, min(9, 4 * b + 4)))) for b in range(3)
        }


def test_positions_may_be_times_or_texts(spark):
    df = spark.sql("SELECT 1L AS persona_id, id, timestamp_micros(id * 7) AS at, string(id + 100) AS name, concat('w', id) AS text FROM range(40)")
    df = df.withColumn("id", df.id.cast("string"))
    for position in ("at", "name"):
        assert packed(df, 15, position=position, per_bucket=4)[(1, 2)] == ([str(k) for k in range(30, 40)], " ".join(f"w{k}" for k in range(30, 40)))


def test_null_texts_keys_and_positions(spark):
    rows = [(None, "a", 1, "x y"), (None, "b", None, "z"), (1, "c", 2, None), (1, "d", 3, "v"), (2, "e", 1, "  ")]
    df = spark.createDataFrame(rows, "persona_id BIGINT, id STRING, ingest_pos BIGINT, text STRING")
    assert packed(df, 2) == {(None, 0): (["b", "a"], "z x"), (None, 1): (["a"], "y"), (1, 0): (["d"], "v")}
    assert packed(df.limit(0), 2) == {}


def test_one_group_over_all_parts_without_keys(spark):
    data, df = examples(spark, 60)
    got = training.pack_sequences(df, 11, keys=(), per_bucket=4).orderBy("block_id").collect()
    assert " ".join(r.text for r in got).split() == [w for d in data for w in d[3].split()]
    assert [r.n_tokens for r in got[:-1]] == [11] * (len(got) - 1)


def exchanges(df):
    import contextlib
    import io
    import re

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    plan = out.getvalue()
    return [line for line in plan.split("\n") if re.search(r"\bExchange hash", line)]


def test_texts_move_once(spark):
    """Blocks inside a part are put together where the window's exchange has brought the texts."""
    plan = exchanges(training.pack_sequences(examples(spark, 40)[1], 10, per_bucket=8))
    assert len(plan) == 3 and sum("block_id" in line for line in plan) == 1  # the second half repeats the first exchange
    assert len([line for line in plan if "_part" in line]) == 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 65_537])
def test_permutations_are_whole_and_differ_by_key(n):
    import numpy as np

    from persona_spark.functions.permutation import permuted

    orders = [permuted(np.arange(n), np.full(n, n), np.full(n, key)) for key in range(4)]
    for order in orders:
        assert sorted(order.tolist()) == list(range(n))
    if n >= 16:
        assert len({o.tobytes() for o in orders}) == 4
        assert all(np.mean(o == np.arange(n)) < 0.4 for o in orders)
    with pytest.raises(ValueError):
        permuted(np.array([n]), np.array([n]), np.array([1]))


def test_a_permutation_spreads_evenly():
    import numpy as np

    from persona_spark.functions.permutation import permuted

    counts = np.zeros((12, 12))
    for key in range(6000):
        np.add.at(counts, (np.arange(12), permuted(np.arange(12), np.full(12, 12), np.full(12, key))), 1)
    assert abs(counts / 500 - 1).max() < 0.25


RUNS = "run_id INT, persona_id BIGINT, batch_size INT, accumulation INT, max_steps INT, num_epochs INT, seed INT"


def test_runs_with_numbers_of_their_own(spark):
    data, df = examples(spark, 90)
    ids = {p: {d[1] for d in data if d[0] == p} for p in range(3)}
    runs = spark.createDataFrame([(1, 0, 2, 4, 7, 1, 1), (2, 0, 3, 1, None, 2, 2), (3, 1, 1, 8, -1, 3, 1), (4, 77, 1, 1, 5, 1, 1), (5, 0, 2, 4, 60, 1, 1)], RUNS)
    for per_bucket in (8, 65_536):
        got = training.run_schedules(df.repartition(3), runs, per_bucket=per_bucket).collect()
        seen = {}
        for r in got:
            seen.setdefault((r.run_id, r.epoch), []).append(r)
        assert {k[0] for k in seen} == {1, 2, 3, 5}
        n = len(ids[0])
        for epoch in range(2):
            rows = seen[2, epoch]
            assert {r.id for r in rows} == ids[0] and len(rows) == n
            assert sorted((r.step - epoch * math.ceil(n / 3), r.micro_batch) for r in rows) == [(k // 3, k // 3) for k in range(n)]
        assert {r.id for r in seen[3, 2]} == ids[1] and max(r.step for r in seen[3, 2]) == 3 * math.ceil(len(ids[1]) / 8) - 1
        assert sorted({r.step for r in got if r.run_id == 1}) == list(range(min(7, math.ceil(n / 8) * math.ceil(7 / math.ceil(n / 8)))))
        assert max(r.step for r in got if r.run_id == 5) == 59
        same = [{(r.epoch, r.id, r.step) for r in got if r.run_id == run and r.step < 7} for run in (1, 5)]
        assert same[0] == same[1]  # one seed, one order
        order = {e: [r.id for r in sorted(seen[2, e], key=lambda r: (r.step, r.id))] for e in (0, 1)}
        assert order[0] != order[1]


def test_runs_over_one_table_without_keys(spark):
    data, df = examples(spark, 30)
    runs = spark.createDataFrame([(1, 9, 4, 2, None, 1, 1), (2, 9, 30, 1, 2, 1, 1)], RUNS).drop("persona_id")
    got = training.run_schedules(df, runs, keys=()).collect()
    assert sorted(r.id for r in got if r.run_id == 1) == sorted(d[1] for d in data)
    assert sorted(r.step for r in got if r.run_id == 2) == [0] * 30 + [1] * 30
    assert training.run_schedules(df.limit(0), runs, keys=()).count() == 0


def test_no_sort_of_rows_times_epochs(spark):
    data, df = examples(spark, 30)
    runs = spark.createDataFrame([(1, 0, 4, 2, None, 5, 1)], RUNS)
    plan = training.run_schedules(df, runs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Sort" not in plan and "Window" not in plan


def test_runs_of_one_kind_share_a_schedule(spark):
    _, df = examples(spark, 90)
    runs = spark.createDataFrame([(i, 0, 2, 1, 1 + i % 5 if i % 2 else None, 1 + i % 3, 7) for i in range(300)], RUNS)
    plans, steps = training.shared_schedules(df, runs)
    n = df.where("persona_id = 0").count()
    assert steps.count() == 3 * n and steps.select("schedule_id").distinct().count() == 1  # not 300 times
    seen = {}
    for r in training.followed(steps, plans).collect():
        seen.setdefault(r.run_id, []).append((r.epoch, r.id, r.step, r.micro_batch))
    assert {i: len(rows) for i, rows in seen.items()} == {i: min(n, 2 * (1 + i % 5)) if i % 2 else n * (1 + i % 3) for i in range(300)}
    assert set(seen[4]) <= set(seen[2]) and set(seen[1]) <= set(seen[2])
