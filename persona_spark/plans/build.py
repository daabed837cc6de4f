"""Memories and personas to a training set."""

from pyspark.sql import DataFrame

from persona_spark.functions import chat
from persona_spark.functions import values as V
from persona_spark.functions.templates import PromptPool
from persona_spark.operators import conversations as C
from persona_spark.operators.pages import drop_blank, first_truthy_fields, prompt_title


def prompted_memories(
    memories: DataFrame,
    personas: DataFrame,
    selection: DataFrame | None = None,
    *,
    template: str,
    structure: str | None,
    pool: PromptPool,
    seed: int = V.SCHEDULE_SEED,
) -> DataFrame:
    """Selected memories with text, each with its system prompt, user prompt and answer (`content`).

    The selection comes first: what is not wanted is never searched for text."""
    chosen = C.select_memories(memories, selection)
    selected = prompt_title(drop_blank(first_truthy_fields(chosen)))
    asked = C.pick_prompt(C.prompt_candidates(selected, pool), seed)
    return C.attach_persona(asked, C.persona_prompt(personas, template, structure))


def build_training_set(
    memories: DataFrame,
    personas: DataFrame,
    selection: DataFrame | None = None,
    chat_template: chat.ChatTemplate = chat.TURN_TEMPLATE,
    **options,
) -> DataFrame:
    """(id, persona_id, ingest_pos, conversations, text). `options` are those of `prompted_memories`:
    the wording (template, structure, pool) has to be given."""
    prompted = prompted_memories(memories, personas, selection, **options)
    return C.render_chat(C.to_conversation(prompted), chat_template)
