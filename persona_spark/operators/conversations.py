"""From memories and personas to training conversations."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from persona_spark.functions import chat, tokens
from persona_spark.functions import pages as P
from persona_spark.functions import values as V
from persona_spark.functions.templates import (
    PromptPool,
    TemplateError,
    fill_template,
)
from persona_spark.functions.text import hash_number, iso_text, words
from persona_spark.model import CONVERSATION
from persona_spark.scale import lookup_join


def select_memories(
    memories: DataFrame, selection: DataFrame | None, require_selection: bool = False
) -> DataFrame:
    """Memories whose id is selected. No selection or an empty one means all of them."""
    if selection is None or selection.isEmpty():
        if require_selection:
            raise ValueError("no memories selected")
        return memories
    spread = ["id", "ingest_pos"] if "ingest_pos" in memories.columns else None
    return lookup_join(memories, selection.select("id").distinct(), ["id"], "left_semi", spread)


def persona_fields(personas: DataFrame, extras: bool = True) -> dict[str, Column]:
    """Template fields of a persona table: the known eight with their defaults, then other columns."""
    fields = {}
    for name in V.PERSONA_FIELDS:
        default = F.lit(V.DEFAULT_PERSONA_NAME if name == "name" else "")
        fields[name] = F.coalesce(F.col(name), default) if name in personas.columns else default
    if extras:
        for name in personas.columns:
            if name not in fields and name != "persona_id":
                fields[name] = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return fields


def persona_prompt(personas: DataFrame, template: str | None, structure: str | None = None) -> DataFrame:
    """(persona_id, system_prompt). A missing template and an unknown field are errors."""
    if not template:
        raise TemplateError("a persona template is required")
    prompt = fill_template(template, persona_fields(personas))
    if structure:
        prompt = F.concat(prompt, F.lit("\n\n" + structure))
    return personas.select("persona_id", prompt.alias("system_prompt"))


def prompt_candidates(memories: DataFrame, pool: PromptPool) -> DataFrame:
    """Adds `candidates`, the ordered user prompts that fit the memory."""
    long_date = F.date_format(P.created_date(iso_text(memories, "created_time")), V.LONG_DATE)
    return memories.withColumn("candidates", pool.candidates(F.col("title"), long_date))


def pick_prompt(memories: DataFrame, seed: int = V.SCHEDULE_SEED) -> DataFrame:
    """Adds `user_prompt`, one of the candidates. The choice hangs on id and seed only, so it is the
    same in every run and under every partitioning."""
    index = hash_number(F.col("id"), F.lit(str(seed))) % F.size("candidates")
    return memories.withColumn("user_prompt", F.get("candidates", index.cast("int")))


def attach_persona(memories: DataFrame, prompts: DataFrame) -> DataFrame:
    """The system prompt of its persona on every memory."""
    return lookup_join(memories, prompts, ["persona_id"], "inner", spread=["id"])


def to_conversation(memories: DataFrame) -> DataFrame:
    """(id, persona_id, conversations): the system, user and assistant messages."""

    def message(role: str, content: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))

    triple = F.array(
        message("system", "system_prompt"), message("user", "user_prompt"), message("assistant", "content")
    )
    kept = [c for c in ("id", "persona_id", "ingest_pos") if c in memories.columns]
    return memories.select(*kept, triple.cast(CONVERSATION).alias("conversations"))


def render_chat(
    conversations: DataFrame,
    template: chat.ChatTemplate | chat.TextTemplate = chat.TURN_TEMPLATE,
    add_generation_prompt: bool = False,
    messages: str = "conversations",
) -> DataFrame:
    return conversations.withColumn(
        "text", chat.render_chat(F.col(messages), template, add_generation_prompt)
    )


def supervised_spans(
    examples: DataFrame,
    instruction_marker: str = V.TURN_USER,
    response_marker: str = V.TURN_MODEL,
) -> DataFrame:
    cut = examples.withColumn("_segments", chat.response_segments(F.col("text"), response_marker))
    spans = chat.supervised_spans(F.col("_segments"), instruction_marker, response_marker)
    return cut.withColumn("spans", spans).drop("_segments")


def token_labels(
    examples: DataFrame,
    tokenizer: tokens.Tokenizer = tokens.word_tokens,
    instruction_marker: str = V.TURN_USER,
    response_marker: str = V.TURN_MODEL,
    ignored: int = tokens.IGNORED,
    text: str = "text",
) -> DataFrame:
    """Adds `input_ids` and `labels`, one label per token: its id where the token begins inside an answer, else `ignored`.

    Arrow batches: tokens and answers are two ascending lists of places, merged in time linear in both. A tokenizer gets a few
    texts at a time, however large the batches are: its tokens as Python numbers take many times the room of the text. A
    null text has no tokens. Columns of these names are replaced.
    """
    kept = [c for c in examples.columns if c not in ("input_ids", "labels")]

    numbers = pa.list_(pa.int32())

    def labelled(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in rows.column(rows.num_columns - 1).to_pylist()]
        ids, labels = [], []
        for body, (found, starts, _) in zip(texts, tokenizer(texts)):
            coded = np.asarray(found, np.int32)
            inside = tokens.learned(starts, *tokens.answer_spans(body, instruction_marker, response_marker))
            ids.append(coded)
            labels.append(np.where(inside, coded, np.int32(ignored)))
        columns = [*rows.columns[:-1], pa.array(ids, numbers), pa.array(labels, numbers)]
        return pa.RecordBatch.from_arrays(columns, [*rows.schema.names[:-1], "input_ids", "labels"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in tokens.portions(batch.column(batch.num_columns - 1)):
                yield labelled(batch.slice(start, n))

    rows = examples.select(*kept, F.col(text).cast("string").alias("_tokenized"))
    schema = T.StructType([*examples.select(*kept).schema.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "labels")]])
    return rows.mapInArrow(label, schema)


def cap_length(
    examples: DataFrame, max_len: int = V.MAX_SEQ_LENGTH, tokenizer=words, text: str = "text"
) -> DataFrame:
    """Adds `n_tokens` (before the cut) and `tokens`, at most `max_len` of them."""
    tokens = examples.withColumn("tokens", tokenizer(F.col(text)))
    return tokens.withColumn("n_tokens", F.size("tokens")).withColumn(
        "tokens", F.slice("tokens", 1, max_len)
    )


def map_examples(examples: DataFrame, fn, schema) -> DataFrame:
    """A user function over Arrow batches of examples (an iterator of pandas frames in and out)."""
    return examples.mapInPandas(fn, schema)
