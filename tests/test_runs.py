import pytest

from persona_spark.functions import values as V
from persona_spark.operators import runs


def test_resolve_runs(rows):
    df = rows(
        "run_id BIGINT, selected_model STRING, custom_model STRING, mode STRING, output_name STRING, tags STRING, age DOUBLE",
        (1, "o/m", " me/x ", "Full Fine-tune (Slow)", "n", " a,, b ,", 30.9),
        (2, "o/m", "  ", "LoRA", "n2", "", 0.0),
        (3, "o/m", None, None, "n3", None, None),
    )
    got = [tuple(r) for r in runs.resolve_runs(df).orderBy("run_id").collect()]
    assert got == [
        (1, "me/x", True, "merged_16bit", "./outputs/n", ["a", "b"], "30"),
        (2, "o/m", False, "lora", "./outputs/n2", [], ""),
        (3, "o/m", False, "lora", "./outputs/n3", None, ""),
    ]


def test_clamp_settings(spark, rows):
    cases = [
        ("training", "batch_size", "", "2"), ("training", "batch_size", "0", "2"), ("training", "batch_size", "-3", "1"),
        ("training", "batch_size", "7.9", "7"), ("training", "batch_size", None, "2"), ("training", "batch_size", "x", "2"),
        ("training", "warmup_steps", "-1", "0"), ("model", "max_seq_length", "5", "128"), ("model", "max_new_tokens", "31", "32"),
        ("model", "temperature", "-0.5", "-0.5"), ("model", "temperature", "0.0", "0.7"), ("training", "optimizer", "", "adamw_8bit"),
        ("training", "optimizer", "sgd", "sgd"), ("system", "gpu_ids", " 0,1 ", "0,1"), ("unsloth", "packing", "True", "true"),
        ("unsloth", "packing", "false", "false"), ("unsloth", "packing", None, "false"), ("own", "key", None, None), ("own", "key", "0", "0"),
    ]
    df = rows("run_id BIGINT, section STRING, key STRING, value STRING", *[(i, *c[:3]) for i, c in enumerate(cases)])
    got = runs.clamp_settings(df, runs.setting_rules(spark)).orderBy("run_id").collect()
    assert [r.value for r in got] == [c[3] for c in cases]


def test_model_lookup(spark, rows):
    df = rows("run_id BIGINT, model_id STRING", (1, V.MODELS[3][0]), (2, "acme/own"), (3, "bare"))
    got = [tuple(r) for r in runs.model_lookup(df, runs.model_registry(spark)).orderBy("run_id").select("model_name", "description", "vram", "params").collect()]
    unknown = (V.CUSTOM_MODEL, V.UNKNOWN, V.UNKNOWN)
    assert got == [V.MODELS[3][1:], ("own", *unknown), ("bare", *unknown)]


def test_layers(rows):
    base = runs.defaults_for_runs(rows("run_id BIGINT", (1,), (2,)), (("a", "x", "0"), ("a", "y", "0")))
    user = rows("run_id BIGINT, section STRING, key STRING, value STRING", (1, "a", "x", "1"), (1, "b", "z", "1"), (2, "a", "x", None))
    typed = runs.dotted_updates(rows("run_id BIGINT, name STRING, value STRING", (1, "a.x", "2"), (1, "plain", "2"), (2, "a.b.c", "2")))
    got = {(r.run_id, r.section, r.key): r.value for r in runs.layered_settings(base, user, typed).collect()}
    assert got == {
        (1, "a", "x"): "2", (1, "a", "y"): "0", (1, "b", "z"): "1", (2, "a", "x"): None, (2, "a", "y"): "0", (2, "a", "b.c"): "2",
    }


def test_run_summary(rows):
    log = rows(
        "run_id BIGINT, step BIGINT, loss DOUBLE, learning_rate DOUBLE",
        (1, 1, 0.5, 0.1), (1, 3, None, 0.2), (1, 2, 0.4, None), (2, 9, 0.9, None), (3, 1, None, None),
    )
    got = {r.run_id: tuple(r)[1:] for r in runs.run_summary(log.repartition(4)).collect()}
    assert got == {1: (3, 0.0, 0.2, 0.4), 2: (9, 0.9, 0.0, 0.9), 3: (1, 0.0, 0.0, None)}


def test_last_entry_counts_under_any_order(rows):
    log = [(1, 5, 1, 0.9, 0.1), (1, 10, 2, 0.5, 0.2), (1, 10, 3, None, None), (2, 1, 1, None, 0.3)]
    for entries in (log, log[::-1]):
        got = runs.run_summary(rows("run_id INT, step INT, entry_no INT, loss DOUBLE, learning_rate DOUBLE", *entries))
        assert sorted(map(tuple, got.collect())) == [(1, 10, 0.0, 0.0, 0.5), (2, 1, 0.0, 0.3, None)]


def test_nulls_override_and_stay(rows):
    schema = "run_id INT, section STRING, key STRING, value STRING"
    got = runs.layered_settings(rows(schema, (1, "a", "k", "x"), (1, "a", "only", None)), rows(schema, (1, "a", "k", None)))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "k", None), (1, "a", "only", None)]


def test_defaults_once_per_run(rows):
    one = (("a", "k", "v"),)
    assert [tuple(r) for r in runs.defaults_for_runs(rows("run_id INT", (1,), (1,)), one).collect()] == [(1, "a", "k", "v")]


def test_age_that_is_no_number(rows):
    df = rows("age STRING", ("ten",), ("7.9",), ("0",), (None,), ("nan",))
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(runs.age_text(F.col("age"))).collect()] == ["", "7", "", "", ""]


def test_effective_settings(rows):
    schema = "run_id INT, section STRING, key STRING, value STRING"
    settings = rows(
        schema, (1, "lora", "r", "8"), (1, "lora", "use_rslora", "false"), (1, "unsloth", "use_rslora", "true"), (1, "unsloth", "packing", None),
        (1, "training", "packing", "x"), (2, "lora", "r", "8"), (2, "unsloth", "packing", "y"), (3, "lora", "r", "4"), (4, "lora", "r", "1"),
    )
    plans = rows("run_id INT, full_tuning BOOLEAN", (1, False), (1, False), (2, True), (3, False))
    assert sorted(map(tuple, runs.effective_settings(settings, plans).collect()), key=str) == sorted([
        (1, "lora", "r", "8"), (1, "lora", "use_rslora", "true"), (1, "lora", "use_gradient_checkpointing", "unsloth"), (1, "lora", "use_loftq", "false"),
        (1, "unsloth", "use_rslora", "true"), (1, "unsloth", "packing", None), (1, "training", "use_rslora", "true"), (1, "training", "packing", None),
        (2, "unsloth", "packing", "y"), (2, "training", "packing", "y"), (3, "lora", "r", "4"),
    ], key=str)


def test_plans_of_runs(rows):
    schema = "run_id INT, n_examples INT, batch_size INT, accumulation INT, max_steps INT, num_epochs INT"
    plans = runs.run_plans(rows(schema, (1, 10, 2, 4, None, 3), (2, 16, 2, 4, 7, 1), (3, 5, 1, 1, -1, 2), (4, 0, 2, 4, 60, 1), (5, 16, 2, 4, 4, 9)))
    assert {r.run_id: tuple(r)[1:] for r in plans.collect()} == {
        1: (2, 6, 3), 2: (2, 7, 4), 3: (5, 10, 2), 4: (None, 60, None), 5: (2, 4, 2)
    }
    log = rows("run_id INT, step INT, loss DOUBLE, learning_rate DOUBLE", (1, 3, 0.5, 0.1), (4, 2, 0.1, 0.1), (9, 1, 0.1, 0.1))
    got = {r.run_id: (r.current_step, r.max_steps, r.current_epoch, r.total_epochs) for r in runs.run_summary(log, plans).collect()}
    assert got == {1: (3, 6, 1.5, 3), 4: (2, 60, None, None), 9: (1, None, None, None)}


def test_effective_settings_of_many_runs_without_an_extra_pass(rows, monkeypatch):
    """Beyond a broadcast the settings are made for what is kept and for the two sections that meet, no third time."""
    from persona_spark import scale

    monkeypatch.setattr(scale, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(scale, "PROBE_MAX_ROWS", 0)
    monkeypatch.setattr(scale, "heavy_keys", lambda *a, **k: pytest.fail("looked through all settings"))
    settings = rows("run_id INT, section STRING, key STRING, value STRING", (1, "unsloth", "a", "x"), (1, "training", "a", "y"), (1, None, "k", "v"), (2, "lora", "r", "1"))
    got = runs.effective_settings(settings, rows("run_id INT, full_tuning BOOLEAN", (1, False), (2, True)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "unsloth", "a", "x"), (1, "training", "a", "x"), (1, None, "k", "v")], key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
