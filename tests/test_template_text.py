"""Chat templates given as text."""

import pytest
from pyspark.sql import functions as F

from persona_spark.functions.template_text import TemplateSyntaxError, TextTemplate
from persona_spark.operators import conversations as C

TALK = [("system", " Be kind. "), ("user", "Hi"), ("assistant", "Hello\n"), ("user", "Bye")]

MARKED = "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
LINED = """{% for message in messages %}
{% if message['role'] == 'user' %}
{{ '<|user|>\\n' + message['content'] + eos_token }}
{% elif message['role'] == 'system' %}
{{ '<|system|>\\n' + message['content'] + eos_token }}
{% elif message['role'] == 'assistant' %}
{{ '<|assistant|>\\n'  + message['content'] + eos_token }}
{% endif %}
{% if loop.last and add_generation_prompt %}
{{ '<|assistant|>' }}
{% endif %}
{% endfor %}"""
HEADED = "{{ bos_token }}{% for message in messages %}{{ '<|start_header_id|>' + message['role'] + '<|end_header_id|>\\n\\n'+ message['content'] | trim + '<|eot_id|>' }}{% endfor %}{% if add_generation_prompt %}{{ '<|start_header_id|>assistant<|end_header_id|>\\n\\n' }}{% endif %}"
BRACKETED = "{{ bos_token }}{% for m in messages[1:] %}{% if m.role == 'user' %}[INST] {% if loop.first and messages[0].role == 'system' %}{{ messages[0].content | trim ~ '\\n\\n' }}{% endif %}{{ m.content }} [/INST]{% else %} {{ m.content | trim }}{{ eos_token }}{% endif %}{% endfor %}"


@pytest.fixture
def render(spark):
    def make(source, talk=TALK, prompt=False, **variables):
        df = spark.createDataFrame([(talk,)], "conversations array<struct<role: string, content: string>>")
        return C.render_chat(df, TextTemplate(source, **variables), prompt).first().text

    return make


def test_public_dialects(render):
    assert render(MARKED) == "<|im_start|>system\n Be kind. <|im_end|>\n<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nHello\n<|im_end|>\n<|im_start|>user\nBye<|im_end|>\n"
    assert render(MARKED, TALK[1:2], True) == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n"
    assert render(LINED, eos_token="</s>") == "<|system|>\n Be kind. </s>\n<|user|>\nHi</s>\n<|assistant|>\nHello\n</s>\n<|user|>\nBye</s>\n"
    assert render(LINED, TALK[1:2], True, eos_token="</s>") == "<|user|>\nHi</s>\n<|assistant|>\n"
    assert render(HEADED, TALK[:2], True, bos_token="<|begin_of_text|>") == (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nBe kind.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nHi<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\n"
    )
    assert render(BRACKETED, bos_token="<s>", eos_token="</s>") == "<s>[INST] Be kind.\n\nHi [/INST] Hello</s>[INST] Bye [/INST]"


def test_the_bos_marker_goes_from_texts_to_learn_from(render):
    source = "{{ bos_token }}{% for m in messages %}{{ m.content }}{% endfor %}"
    assert render(source, TALK[1:2], bos_token="<bos>") == "Hi" and render(source, TALK[1:2], True, bos_token="<bos>") == "<bos>Hi"


@pytest.mark.parametrize(
    "source,text",
    [
        ("{% for m in messages %}{{ loop.index }}{{ loop.index0 }}{% if not loop.last %},{% endif %}{% endfor %}", "10,21,32,43"),
        ("{{ messages | length }}{{ messages[-1].content | upper }}{{ messages[9].content }}", "4BYE"),
        ("a {#- not this -#} b{# nor this #}", "a  b"),
        ("{{ 'it\\'s' + \"\\t\\\\\" }}", "it's\t\\"),
        ("{% if (true and not false) or x == 'y' %}yes{% else %}no{% endif %}", "yes"),
        ("{% if x %}{{ x | length }}{% endif %}|{% if not '' %}empty{% endif %}", "2|empty"),
        ("  {%- if x == 'xy' -%}  in  {%- endif -%}  out", "inout"),
    ],
)
def test_parts_of_the_grammar(render, source, text):
    assert render(source, x="xy") == text


def test_nulls_and_no_messages(spark, render):
    assert render(MARKED, [("user", None), (None, "x")]) == "<|im_start|>user\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n"
    assert render(MARKED, []) == ""
    df = spark.createDataFrame([(None,)], "conversations array<struct<role: string, content: string>>")
    assert C.render_chat(df, TextTemplate(HEADED, bos_token="")).first().text is None


def test_texts_are_never_expanded(render):
    assert render("{% for m in messages %}{{ m.content }}{% endfor %}", [("user", "{{ bos_token }}{% if %}")]) == "{{ bos_token }}{% if %}"


def test_a_template_may_refuse_a_conversation(render):
    source = "{% for m in messages %}{% if m.role == 'tool' %}{{ raise_exception('no tools') }}{% endif %}{{ m.content }}{% endfor %}"
    assert render(source, TALK[1:3]) == "HiHello\n"
    with pytest.raises(Exception, match="no tools"):
        render(source, [("tool", "x")])


@pytest.mark.parametrize(
    "source",
    [
        "{% set x = 1 %}", "{% for a in others %}{% endfor %}", "{% for m in messages %}", "{% if true %}", "{{ unknown }}", "{{ messages }}",
        "{{ m.content }}", "{{ 'a' | reverse }}", "{{ 1 < 2 }}", "{{ messages[0].name }}", "{{ loop.first }}", "{% endif %}", "{{ 'a'", "{{ ('a' }}",
        "{% for m in messages %}{{ m['content'].strip() }}{% endfor %}", "{% macro x() %}", "{{ messages[-1:] }}", "{{ loop.depth }}",
    ],
)
def test_what_is_not_understood_is_an_error(spark, source):
    with pytest.raises(TemplateSyntaxError):
        TextTemplate(source)


def test_stays_inside_the_engine(spark):
    df = spark.createDataFrame([(TALK,)], "conversations array<struct<role: string, content: string>>")
    plan = df.select(TextTemplate(LINED, eos_token="</s>").render(F.col("conversations")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
