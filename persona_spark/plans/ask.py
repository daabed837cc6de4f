"""Questions to generator input, generator output to answers."""

from pyspark.sql import DataFrame

from persona_spark.functions import chat
from persona_spark.operators.inference import (
    extract_response,
    inference_requests,
    request_texts,
    sampling_params,
)


def prepare_requests(
    questions: DataFrame,
    personas: DataFrame,
    template: str | None,
    structure: str | None,
    chat_template: chat.ChatTemplate = chat.TURN_TEMPLATE,
    *,
    fallback: str,
) -> DataFrame:
    """Questions with `prompt`, and with their sampling settings put in order if they carry any."""
    asked = inference_requests(questions, personas, template, structure, fallback=fallback)
    requests = request_texts(asked, chat_template)
    return sampling_params(requests) if "temperature" in questions.columns else requests


def read_answers(generations: DataFrame, prompt: str | None = None) -> DataFrame:
    return extract_response(generations, prompt=prompt)
