"""Questions in, answers out: the two batch jobs around an outside generator."""

from pyspark.sql import DataFrame, functions as F

from persona_spark.functions import chat
from persona_spark.functions import values as V
from persona_spark.functions.templates import (
    UnknownFieldError,
    fill_template,
)
from persona_spark.functions.text import has_text, truthy_text
from persona_spark.model import CONVERSATION
from persona_spark.operators.conversations import persona_fields
from persona_spark.scale import lookup_join


def inference_requests(
    questions: DataFrame,
    personas: DataFrame,
    template: str | None,
    structure: str | None = None,
    *,
    fallback: str,
) -> DataFrame:
    """Adds `messages`, the optional system and the user message of each question.

    `questions` has question_id, persona_id, message and perhaps system_prompt, which overrides the
    template. Only the eight known persona fields count here; a template that names another one is
    sent as it stands, as is the template of a question without a persona; any other fault in a template is
    an error. Without a template the system text is `fallback`. Blank questions are skipped and a blank
    system text is left out.
    """
    asked = questions.where(has_text(F.col("message")))
    if template:
        try:
            filled = fill_template(template, persona_fields(personas, extras=False))
            if structure:
                filled = F.concat(filled, F.lit("\n\n" + structure))
        except UnknownFieldError:
            filled = F.lit(template)
        prompts = personas.select("persona_id", filled.alias("_filled"))
        asked = lookup_join(asked, prompts, ["persona_id"], "left", spread=["question_id"])
        system = F.coalesce(F.col("_filled"), F.lit(template))
    else:
        system = F.lit(fallback)
    if "system_prompt" in questions.columns:
        system = F.coalesce(truthy_text(F.col("system_prompt")), system)
    system_message = F.struct(F.lit("system").alias("role"), system.alias("content"))
    user_message = F.struct(F.lit("user").alias("role"), F.col("message").alias("content"))
    messages = F.filter(
        F.array(system_message, user_message), lambda m: (m["role"] == "user") | has_text(m["content"])
    )
    return asked.withColumn("messages", messages.cast(CONVERSATION)).drop("_filled")


def request_texts(requests: DataFrame, template: chat.ChatTemplate = chat.TURN_TEMPLATE) -> DataFrame:
    """Adds `prompt`, the text to hand to the generator."""
    return requests.withColumn("prompt", chat.render_chat(F.col("messages"), template, True))


def sampling_params(requests: DataFrame) -> DataFrame:
    """Sampling settings with the values that stand for "off" replaced."""
    fallback = V.SAMPLING_FALLBACK

    def set_or(name: str):
        value = F.col(name)
        return F.coalesce(F.nullif(value, F.lit(0).cast(requests.schema[name].dataType)), F.lit(fallback[name]))

    temperature = F.col("temperature")
    return requests.withColumns(
        {
            "temperature": F.when(temperature > V.MIN_TEMPERATURE, temperature).otherwise(
                F.lit(fallback["temperature"])
            ),
            "top_p": set_or("top_p"),
            "top_k": set_or("top_k"),
            "repetition_penalty": set_or("repetition_penalty"),
        }
    )


def extract_response(
    generations: DataFrame, raw: str = "raw", prompt: str | None = None, strict: bool = True
) -> DataFrame:
    given = None if prompt is None else F.col(prompt)
    return generations.withColumn("response", chat.extract_response(F.col(raw), given, strict))


def extract_response_header(generations: DataFrame, raw: str = "raw") -> DataFrame:
    return generations.withColumn("response", chat.extract_response_header(F.col(raw)))
