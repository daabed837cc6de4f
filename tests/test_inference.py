import pytest
from pyspark.sql import functions as F

from persona_spark.functions import chat
from persona_spark.functions.templates import TemplateError
from persona_spark.operators import inference


@pytest.fixture
def personas(rows):
    return rows("persona_id BIGINT, name STRING, pet STRING", (1, "Ann", "cat"))


QUESTION = "question_id STRING, persona_id BIGINT, message STRING, system_prompt STRING"


def messages(df):
    return {r.question_id: [(m.role, m.content) for m in r.messages] for r in df.collect()}


def test_requests(rows, personas):
    asked = rows(
        QUESTION,
        ("own", 1, "q", "Mine"), ("blank", 1, "q", " "), ("filled", 1, "q", ""), ("stranger", 7, "q", None),
        ("nobody", None, " q ", None), ("skipped", 1, " \n", "x"), ("missing", 1, None, "x"),
    )
    got = messages(inference.inference_requests(asked, personas, "I am {name}", "S", fallback="F"))
    user = ("user", "q")
    assert got == {
        "own": [("system", "Mine"), user], "blank": [user], "filled": [("system", "I am Ann\n\nS"), user],
        "stranger": [("system", "I am {name}"), user], "nobody": [("system", "I am {name}"), ("user", " q ")],
    }


def test_requests_without_or_with_unfit_template(rows, personas):
    asked = rows(QUESTION, ("a", 1, "q", None))
    assert messages(inference.inference_requests(asked, personas, None, "S", fallback="Fall"))["a"][0] == ("system", "Fall")
    raw = messages(inference.inference_requests(asked, personas, "{name} {pet}", "S", fallback="F"))
    assert raw["a"][0] == ("system", "{name} {pet}")


@pytest.mark.parametrize("template", ["{name:>5}", "{name!r}", "{name", "{0}"])
def test_broken_templates_are_not_sent(rows, personas, template):
    with pytest.raises(TemplateError):
        inference.inference_requests(rows(QUESTION, ("a", 1, "q", None)), personas, template, None, fallback="F")


def test_sampling(rows):
    df = rows(
        "temperature DOUBLE, top_p DOUBLE, top_k INT, repetition_penalty DOUBLE",
        (0.1, 0.0, 0, 0.0), (0.11, 0.5, 7, 1.2), (None, None, None, None), (-1.0, 1.0, 1, 1.0),
    )
    assert [tuple(r) for r in inference.sampling_params(df).collect()] == [
        (1.0, 0.95, 64, 1.0), (0.11, 0.5, 7, 1.2), (1.0, 0.95, 64, 1.0), (1.0, 1.0, 1, 1.0),
    ]


#: raw text, the answer with "prompt" as the prompt, the answer without one
RAW = [
    ("<bos><start_of_turn>user\nq<end_of_turn>\n<start_of_turn>model\n a <end_of_turn>x", "a", "a"),
    ("<start_of_turn>model\none<end_of_turn><start_of_turn>model\ntwo", "two", "two"),
    ("<|assistant|>a<|end|>", "", ""),
    ("<|assistant|>a<|end|> b <|eot_id|>c", "b", "b"),
    ("<|assistant|>first<|assistant|> second<|eot_id|>", "second", "second"),
    ("Assistant: one Assistant: two<|end|> ", "two", "two"),
    ("<|assistant|> Assistant: x", "Assistant: x", "Assistant: x"),
    ("promptanswer<end_of_turn>", "answer", "promptanswer"),
    ("other prompt", "other prompt", "other prompt"),
    ("", "", ""),
    ("<|end|><|eot_id|>", "", ""),
    ("prompt", "", "prompt"),
]


def test_responses(rows):
    df = rows("raw STRING, prompt STRING", *[(r, "prompt") for r, _, _ in RAW])
    with_prompt = {r.raw: r.response for r in inference.extract_response(df, prompt="prompt").collect()}
    assert with_prompt == {raw: answer for raw, answer, _ in RAW}
    without = {r.raw: r.response for r in inference.extract_response(df).collect()}
    assert without == {raw: answer for raw, _, answer in RAW}


def test_lenient_pipe_dialect(rows):
    df = rows("raw STRING", ("<|assistant|>a<|end|>",))
    assert inference.extract_response(df).first().response == ""
    assert inference.extract_response(df, strict=False).first().response == "a"


def test_header_dialect(rows):
    head = "<|start_header_id|>assistant<|end_header_id|>"
    df = rows("raw STRING", (f"{head}no<|eot_id|>{head}\n\nyes <|eot_id|> rest",), (" left alone ",), (f"{head}open ",))
    assert [r.response for r in inference.extract_response_header(df).collect()] == ["yes", " left alone ", "open"]


def test_render_then_extract_gives_the_answer_back(rows):
    answers = [" plain ", "two\nlines", "ünï", "Assistant: odd", "<b>"]
    df = rows("a STRING", *[(a,) for a in answers])
    message = F.array(
        F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("a").alias("content")),
    )
    out = inference.extract_response(df.withColumn("raw", chat.render_chat(message)))
    assert all(r.response == r.a.strip() for r in out.collect())


def test_an_echo_without_answer_markers_loses_the_whole_prompt(rows):
    bare = chat.ChatTemplate(bos="<bos>", turn_open="[{role}] ", turn_close="\n")
    message = F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")))
    df = rows("a STRING", ("yes",)).withColumn("prompt", chat.render_chat(message, bare, add_generation_prompt=True))
    assert df.first().prompt == "<bos>[user] q\n[assistant] "
    echoed = df.withColumn("raw", F.concat("prompt", "a"))
    assert inference.extract_response(echoed, prompt="prompt").first().response == "yes"
