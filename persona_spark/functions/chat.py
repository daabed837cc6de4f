"""Chat templates, the parts of a text that are learned, and answers cut out of generated text."""

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from persona_spark.functions import values as V
from persona_spark.functions.template_text import TextTemplate
from persona_spark.functions.text import strip


@dataclass(frozen=True)
class ChatTemplate:
    """How messages become one text. With `system_in_user` the system text opens the first user turn."""

    bos: str
    turn_open: str  # takes {role}
    turn_close: str
    roles: Mapping[str, str] = field(default_factory=dict)
    system_in_user: bool = False
    strip_content: bool = True

    def opening(self, role: str) -> str:
        return self.turn_open.replace("{role}", self.roles.get(role, role))


TURN_TEMPLATE = ChatTemplate(
    bos=V.BOS,
    turn_open="<start_of_turn>{role}\n",
    turn_close=V.TURN_END + "\n",
    roles={"assistant": "model"},
    system_in_user=True,
)
HEADER_TEMPLATE = ChatTemplate(
    bos="<|begin_of_text|>",
    turn_open="<|start_header_id|>{role}<|end_header_id|>\n\n",
    turn_close=V.PIPE_EOT,
)


def render_chat(
    messages: Column, template: ChatTemplate | TextTemplate = TURN_TEMPLATE, add_generation_prompt: bool = False
) -> Column:
    """Messages (role, content) as one text. Texts to learn from go without the bos marker of the turn
    dialect, as a trainer adds its own; prompts for a generator keep it. So it is with a template given as text."""

    if isinstance(template, TextTemplate):
        text = template.render(messages, add_generation_prompt)
        opened = F.startswith(text, F.lit(V.BOS))
        return text if add_generation_prompt else F.when(opened, F.substring(text, len(V.BOS) + 1, 1 << 30)).otherwise(text)

    def body(m: Column) -> Column:
        return strip(m["content"]) if template.strip_content else m["content"]

    def opening(role: Column) -> Column:
        before, after = template.turn_open.split("{role}")
        name = F.lit(None).cast("string")
        for source, shown in template.roles.items():
            name = F.coalesce(name, F.when(role == source, F.lit(shown)))
        return F.concat(F.lit(before), F.coalesce(name, role), F.lit(after))

    def turn(m: Column, prefix: Column) -> Column:
        return F.concat(opening(m["role"]), prefix, body(m), F.lit(template.turn_close))

    if template.system_in_user:
        has_system = F.get(messages, F.lit(0))["role"] == "system"
        system = F.when(has_system, F.concat(body(F.get(messages, F.lit(0))), F.lit("\n\n"))).otherwise("")
        turns = F.when(has_system, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
        rendered = F.transform(turns, lambda m, i: turn(m, F.when(i == 0, system).otherwise("")))
    else:
        rendered = F.transform(messages, lambda m: turn(m, F.lit("")))
    bos = template.bos if add_generation_prompt else template.bos.removeprefix(V.BOS)
    parts = [F.lit(bos), F.array_join(rendered, "")]
    if add_generation_prompt:
        parts.append(F.lit(template.opening("assistant")))
    return F.concat(*parts)


def response_segments(text: Column, response_marker: str = V.TURN_MODEL) -> Column:
    """The text cut at each response marker."""
    return F.split(text, re.escape(response_marker))


def supervised_spans(
    segments: Column, instruction_marker: str = V.TURN_USER, response_marker: str = V.TURN_MODEL
) -> Column:
    """Character ranges (start inclusive, end exclusive, from 0) that a trainer learns from: after
    each response marker up to the next instruction marker. `segments` is the text cut at the
    response markers, best as a column of its own, since it is used several times."""
    marker = len(response_marker)

    def span(segment: Column, i: Column) -> Column:
        before = F.aggregate(
            F.slice(segments, F.lit(1), i + 1), F.lit(0), lambda acc, s: acc + F.length(s) + marker
        )
        stop = F.instr(segment, instruction_marker)
        length = F.when(stop > 0, stop - 1).otherwise(F.length(segment))
        return F.struct(before.alias("start"), (before + length).alias("end"))

    return F.transform(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), span)


def _after_last(raw: Column, marker: str) -> Column:
    return F.substring_index(raw, marker, -1)


def _before_first(raw: Column, marker: str) -> Column:
    return F.substring_index(raw, marker, 1)


def extract_response(raw: Column, prompt: Column | None = None, strict: bool = True) -> Column:
    """The answer inside raw generated text; the first dialect whose marker occurs decides.

    In the pipe dialect what follows the last end marker is kept, so an answer closed by it comes out
    empty; `strict=False` takes the text before the marker instead.
    """
    piped = _after_last(raw, V.PIPE_ASSISTANT)
    piped = _after_last(piped, V.PIPE_END) if strict else _before_first(piped, V.PIPE_END)
    answer = (
        F.when(
            F.contains(raw, F.lit(V.TURN_MODEL_OPEN)),
            _before_first(_after_last(raw, V.TURN_MODEL_OPEN), V.TURN_END),
        )
        .when(F.contains(raw, F.lit(V.PIPE_ASSISTANT)), _before_first(piped, V.PIPE_EOT))
        .when(F.contains(raw, F.lit(V.PLAIN_ASSISTANT)), _after_last(raw, V.PLAIN_ASSISTANT))
    )
    if prompt is not None:
        answer = answer.when(F.startswith(raw, prompt), F.substring(raw, F.length(prompt) + 1, F.length(raw)))
    answer = answer.otherwise(raw)
    for marker in (V.TURN_END, V.PIPE_END, V.PIPE_EOT):
        answer = F.replace(answer, F.lit(marker), F.lit(""))
    return strip(answer)


def extract_response_header(raw: Column) -> Column:
    """The answer after the last assistant header; text without one stays as it is."""
    return F.when(
        F.contains(raw, F.lit(V.HEADER_ASSISTANT)),
        strip(_before_first(_after_last(raw, V.HEADER_ASSISTANT), V.PIPE_EOT)),
    ).otherwise(raw)
