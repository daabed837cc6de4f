"""Run requests, settings, the model registry and run logs."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from persona_spark.functions import values as V
from persona_spark.functions.text import strip, truthy_text
from persona_spark.scale import lookup_join


def model_registry(spark: SparkSession) -> DataFrame:
    """The models on offer: ten rows."""
    return spark.createDataFrame(V.MODELS, list(V.MODEL_COLUMNS))


def setting_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.SETTING_RULES, "section STRING, key STRING, kind STRING, default_value STRING, minimum DOUBLE"
    )


def resolve_runs(requests: DataFrame, full_label: str = V.FULL_TUNING_LABEL) -> DataFrame:
    """Run request -> run plan: model, save method, output folder, tags and age as they will be used."""
    custom = strip(F.col("custom_model"))
    full = F.contains(F.col("mode"), F.lit(full_label))
    tags = F.filter(F.transform(F.split("tags", ","), strip), lambda t: t != "")
    plans = requests.select(
        "run_id",
        F.coalesce(truthy_text(custom), F.col("selected_model")).alias("model_id"),
        F.coalesce(full, F.lit(False)).alias("full_tuning"),
        F.when(full, F.lit(V.SAVE_MERGED)).otherwise(F.lit(V.SAVE_ADAPTER)).alias("save_method"),
        F.concat(F.lit(V.OUTPUT_ROOT), F.col("output_name")).alias("output_dir"),
        tags.alias("tags"),
        *([age_text(F.col("age")).alias("age")] if "age" in requests.columns else []),
    )
    return plans


def age_text(age: Column) -> Column:
    """A number as the text of its whole part; missing, zero and what is no number give an empty text."""
    return F.coalesce(F.nullif(age.try_cast("double"), F.lit(0.0)).try_cast("bigint").cast("string"), F.lit(""))


def clamp_settings(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """Settings as they will be saved: empty, zero and false values become the default, numbers are
    cast and kept at or above the minimum. Keys without a rule stay as they are."""
    value = F.col("value")
    number = value.try_cast("double")
    falsy = truthy_text(value).isNull() | (F.lower(value) == "false") | F.coalesce(number == 0, F.lit(False))
    kind = F.col("kind")
    whole = F.greatest(number.try_cast("bigint"), F.col("minimum").cast("bigint")).cast("string")
    numeric = F.when(kind == "int", whole).when(kind == "float", strip(value))
    clamped = (
        F.when(kind.isNull(), value)
        .when(kind == "bool", F.when(falsy, F.lit("false")).otherwise(F.lit("true")))
        .when(kind.isin("text", "stripped") & truthy_text(value).isNull(), F.col("default_value"))
        .when(kind == "stripped", strip(value))
        .when(kind == "text", value)
        .when(falsy | number.isNull(), F.col("default_value"))
        .otherwise(numeric)
    )
    joined = lookup_join(settings, rules, ["section", "key"], "left", spread=["run_id"])
    return joined.withColumn("value", clamped).drop("kind", "default_value", "minimum")


def model_lookup(runs: DataFrame, registry: DataFrame, model: str = "model_id") -> DataFrame:
    """Registry columns for each run; a model that is not on offer is named after its last part."""
    offers = registry.select(
        F.col("id").alias(model),
        F.col("name").alias("model_name"),
        *[c for c in registry.columns if c not in ("id", "name")],
    )
    joined = lookup_join(runs, offers, [model], "left", spread=["run_id"])
    unknown = {"description": V.CUSTOM_MODEL, "vram": V.UNKNOWN, "params": V.UNKNOWN}
    found = F.col("model_name").isNotNull()
    filled = {
        c: F.when(found, F.col(c)).otherwise(F.lit(v)) for c, v in unknown.items() if c in offers.columns
    }
    return joined.withColumns(
        {**filled, "model_name": F.coalesce(F.col("model_name"), F.substring_index(model, "/", -1))}
    )


def defaults_for_runs(runs: DataFrame, defaults=V.DEFAULT_SETTINGS) -> DataFrame:
    """The default settings of each run (run_id, section, key, value), one row per setting."""
    rows = F.array(
        *[F.struct(*[F.lit(v).alias(c) for c, v in zip(V.SETTING_COLUMNS, row)]) for row in defaults]
    )
    return runs.select("run_id").distinct().select("run_id", F.explode(rows).alias("s")).select("run_id", "s.*")


def dotted_updates(updates: DataFrame) -> DataFrame:
    """(run_id, name, value) with names like `section.key` as a settings layer; others are left out."""
    name = F.col("name")
    cut = F.instr(name, ".")
    return updates.where(cut > 0).select(
        "run_id",
        F.substring(name, F.lit(1), cut - 1).alias("section"),
        F.substring(name, cut + 1, F.length(name)).alias("key"),
        "value",
    )


def layered_settings(defaults: DataFrame, *layers: DataFrame) -> DataFrame:
    """(run_id, section, key, value): later layers win key by key, also with a
    null; keys of any layer are kept. Of equal keys in one layer the largest value counts."""
    ranked = [
        layer.select("run_id", "section", "key", "value", F.lit(rank).alias("_rank"))
        for rank, layer in enumerate((defaults, *layers))
    ]
    return _last_of(reduce(DataFrame.unionByName, ranked))


def _last_of(stacked: DataFrame) -> DataFrame:
    """Of each key the row of the largest `_rank`."""
    last = F.max(F.struct("_rank", "value"))["value"]
    return stacked.groupBy("run_id", "section", "key").agg(last.alias("value"))


def effective_settings(settings: DataFrame, plans: DataFrame) -> DataFrame:
    """(run_id, section, key, value) as a run uses them, from its settings and `plans` (run_id, full_tuning).

    All values of the speed-up section go over those for training. Three of them go over the adapter's, missing
    ones as their stand-ins, where a run has both sections. Runs tuned in full have no adapter section. Settings of
    runs without a plan are left out; a run counts once however often it is planned.
    """
    modes = plans.groupBy("run_id").agg(F.max("full_tuning").alias("_full"))
    # No look for heavy runs first: it would make all settings once more, and the grouping below goes by key.
    known = lookup_join(settings, modes, ["run_id"], "inner", stage=True)
    own = known.where(~(F.col("_full") & (F.col("section") == V.ADAPTER_SECTION))).drop("_full")
    place = F.struct(F.col("section").alias("section"), F.lit(0).alias("_rank"))
    over_training = F.struct(F.lit(V.TRAINING_SECTION).alias("section"), F.lit(1).alias("_rank"))
    places = F.when(F.col("section") == V.SPEEDUP_SECTION, F.array(place, over_training)).otherwise(F.array(place))
    placed = own.select("run_id", "key", "value", F.explode_outer(places).alias("_p")).select("run_id", "_p.section", "key", "value", "_p._rank")
    names = [k for k, _ in V.ADAPTER_TAKES]
    both = (
        own.where(F.col("section").isin(V.ADAPTER_SECTION, V.SPEEDUP_SECTION))
        .groupBy("run_id")
        .agg(
            F.count_distinct("section").alias("_sections"),
            *[
                F.max(F.when((F.col("section") == V.SPEEDUP_SECTION) & (F.col("key") == k), F.struct("value"))).alias(k)
                for k in names
            ],
        )
        .where("_sections = 2")
    )
    taken = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.when(F.col(k).isNull(), F.lit(v)).otherwise(F.col(k)["value"]).alias("value"))
            for k, v in V.ADAPTER_TAKES
        ]
    )
    over_adapter = both.select(
        "run_id", F.lit(V.ADAPTER_SECTION).alias("section"), F.explode_outer(taken).alias("_t")
    ).select("run_id", "section", "_t.*", F.lit(2).alias("_rank"))
    return _last_of(placed.unionByName(over_adapter))


def run_plans(runs: DataFrame) -> DataFrame:
    """(run_id, steps_per_epoch, max_steps, total_epochs) from n_examples, batch_size, accumulation, max_steps and num_epochs.

    The last step of an epoch may be short. Where `max_steps` is given (above 0) it decides and the epochs follow, a part of
    one counting as one; else the epochs decide and the steps follow. A run without examples has no figures.
    """
    n = F.col("n_examples").cast("bigint")
    per_step = (F.col("batch_size") * F.col("accumulation")).cast("bigint")
    steps = F.when(n > 0, _ceil_div(n, per_step))
    given = F.coalesce(F.col("max_steps") > 0, F.lit(False))
    return runs.withColumn("_steps", steps).select(
        "run_id",
        F.col("_steps").alias("steps_per_epoch"),
        F.when(given, F.col("max_steps")).otherwise(F.col("_steps") * F.col("num_epochs")).cast("bigint").alias("max_steps"),
        F.when(given, _ceil_div(F.col("max_steps").cast("bigint"), F.col("_steps"))).otherwise(F.col("num_epochs")).cast("bigint").alias("total_epochs"),
    ).withColumn("total_epochs", F.when(F.col("steps_per_epoch").isNotNull(), F.col("total_epochs")))


def _ceil_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a + b - 1, b)


def run_summary(run_log: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Per run the last step and what its last log entry says; 0 where that entry lacks a figure.
    `last_seen_loss` is the newest loss that was logged at all. Entries of one step are told apart by
    `entry_no`, if the log has it, and both figures come from one entry; rows may lie in any order.

    With the `run_plans` of the runs there are also max_steps, current_epoch (steps over those of an epoch, with its
    fraction) and total_epochs; null for a run without a plan.
    """
    loss, step = F.col("loss"), F.col("step")
    entry = F.col("entry_no") if "entry_no" in run_log.columns else F.lit(0)
    place = F.struct(step.alias("step"), entry.alias("entry_no"), "loss", "learning_rate")
    last = F.max(place)
    summary = run_log.groupBy("run_id").agg(
        F.max(step).alias("current_step"),
        F.coalesce(last["loss"], F.lit(0.0)).alias("loss"),
        F.coalesce(last["learning_rate"], F.lit(0.0)).alias("learning_rate"),
        F.max(F.when(loss.isNotNull(), place))["loss"].alias("last_seen_loss"),
    )
    if plans is None:
        return summary
    epoch = F.col("current_step") / F.col("steps_per_epoch")
    return lookup_join(summary, plans, ["run_id"], "left").select(
        *summary.columns, "max_steps", epoch.alias("current_epoch"), "total_epochs"
    )
