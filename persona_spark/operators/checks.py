"""Checks of personas and model names. Failures are codes, not sentences."""

from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.functions import text
from persona_spark.functions import values as V
from persona_spark.functions.text import has_text, truthy_text


def persona_errors(name: Column, age: Column) -> Column:
    """All error codes that apply to one persona, as an array."""
    digits = F.replace(text.strip(age), F.lit("_"), F.lit(""))
    is_integer = text.strip(age).rlike(r"\A[+-]?\d+(_\d+)*\z")
    number = digits.try_cast("decimal(38,0)")
    in_range = F.coalesce((number >= V.AGE_MIN) & (number <= V.AGE_MAX), F.lit(False))
    given_age, given_name = truthy_text(age), truthy_text(name)
    return F.array_compact(
        F.array(
            F.when(~has_text(name), F.lit("name_missing")),
            F.when(given_age.isNotNull() & ~is_integer, F.lit("age_not_integer")),
            F.when(given_age.isNotNull() & is_integer & ~in_range, F.lit("age_out_of_range")),
            F.when(F.char_length(given_name) < V.NAME_MIN_CHARS, F.lit("name_too_short")),
            F.when(F.char_length(given_name) > V.NAME_MAX_CHARS, F.lit("name_too_long")),
        )
    )


def validate_personas(personas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); the rejected ones carry `errors`."""

    def column(name: str) -> Column:
        return F.col(name) if name in personas.columns else F.lit(None).cast("string")

    checked = personas.withColumn("errors", persona_errors(column("name"), column("age")))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def model_name_error(name: Column) -> Column:
    """Code of the first rule a model name breaks, null when it breaks none."""
    owner, repo = F.split_part(name, F.lit("/"), F.lit(1)), F.split_part(name, F.lit("/"), F.lit(2))
    slashes = F.length(name) - F.length(F.replace(name, F.lit("/"), F.lit("")))
    pattern = rf"\A{V.MODEL_NAME_PART}\n?\z"
    return (
        F.when(truthy_text(name).isNull(), F.lit("empty"))
        .when(slashes == 0, F.lit("no_separator"))
        .when(slashes > 1, F.lit("too_many_separators"))
        .when((owner == "") | (repo == ""), F.lit("empty_half"))
        .when(~(owner.rlike(pattern) & repo.rlike(pattern)), F.lit("illegal_characters"))
    )


def validate_model_names(models: DataFrame, name: str = "model_name") -> DataFrame:
    return models.withColumn("error", model_name_error(F.col(name)))


def sanitize_names(df: DataFrame, name: str = "name", into: str = "file_name") -> DataFrame:
    return df.withColumn(into, text.sanitize_name(F.col(name)))
