import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from persona_spark.functions import chat, tokens
from persona_checks.wording import POOL
from persona_spark.functions.templates import PromptPool, TemplateError
from persona_spark.operators import conversations as C
from persona_spark.plans.build import build_training_set

PERSONA = "persona_id BIGINT, name STRING, age STRING, bio STRING, pet STRING"


@pytest.fixture
def personas(rows):
    return rows(PERSONA, (1, "Bob {age}", "5", "{bio} {{x}}", "cat"), (2, None, None, None, None))


def test_template_is_filled_once(personas):
    got = C.persona_prompt(personas, "{name}|{age}|{{age}}|{hobbies}|{bio}|{pet}").orderBy("persona_id").collect()
    assert [r.system_prompt for r in got] == ["Bob {age}|5|{age}||{bio} {{x}}|cat", "the user||{age}|||"]


def test_structure_follows_a_blank_line(personas):
    assert C.persona_prompt(personas, "{age}", "S").first().system_prompt == "5\n\nS"


@pytest.mark.parametrize("template", [None, "", "{unknown}", "{age:>3}", "{age!r}", "{0}", "{}", "{a.b}", "{age", "}"])
def test_bad_templates(personas, template):
    with pytest.raises(TemplateError):
        C.persona_prompt(personas, template)


def test_pool_shape(rows):
    df = rows("id STRING, title STRING, created_time STRING", ("a", "My DAY", "2025-03-04"), ("b", "T", "bad"))
    dated, undated = C.prompt_candidates(df, POOL).orderBy("id").collect()
    assert [len(g) for g in (POOL.identity, POOL.about_title, POOL.open_ended, POOL.greetings, POOL.about_date)] == [4, 3, 4, 3, 2]
    assert (len(dated.candidates), len(undated.candidates)) == (16, 14)
    assert all("my day" in p for p in dated.candidates[4:7])
    assert all("March 04, 2025" in p for p in dated.candidates[14:])
    own = PromptPool(("a",), ("b {title}",), (), (), ("c {date}",))
    assert C.prompt_candidates(df, own).orderBy("id").first().candidates == ["a", "b my day", "c March 04, 2025"]


def test_pick_does_not_depend_on_layout(spark):
    df = spark.range(500).select(
        F.concat(F.lit("m"), "id").alias("id"), F.lit("t").alias("title"), F.lit("2025-03-04").alias("created_time")
    )

    def picks(d, seed=1):
        return {r.id: r.user_prompt for r in C.pick_prompt(C.prompt_candidates(d, POOL), seed).collect()}

    first = picks(df)
    assert first == picks(df.repartition(7).orderBy(F.rand(3)))
    assert first != picks(df, seed=2)
    assert len(set(first.values())) == 16


def test_select_memories(rows):
    memories = rows("id STRING, ingest_pos BIGINT", ("a", 1), ("b", 2), ("c", 3))
    chosen = rows("id STRING", ("b",), ("b",), ("zz",))
    none = chosen.where("false")
    assert [r.id for r in C.select_memories(memories, chosen).collect()] == ["b"]
    assert C.select_memories(memories, none).count() == C.select_memories(memories, None).count() == 3
    with pytest.raises(ValueError):
        C.select_memories(memories, none, require_selection=True)


def test_conversation_keeps_the_memory_as_it_is(rows, personas):
    memories = rows(
        "id STRING, persona_id BIGINT, title STRING, content STRING, alt_content STRING, created_time STRING, ingest_pos BIGINT",
        ("a", 1, None, " text\n", None, None, 1), ("b", 9, None, "no such persona", None, None, 2), ("c", 1, None, " ", "x", None, 3),
    )
    built = build_training_set(memories, personas, template="{name}", structure=None, pool=POOL).collect()
    assert [r.id for r in built] == ["a"]
    system, user, assistant = built[0].conversations
    assert (system.role, system.content) == ("system", "Bob {age}")
    assert user.role == "user" and user.content
    assert (assistant.role, assistant.content) == ("assistant", " text\n")


MESSAGES = "array<struct<role:string,content:string>>"


def render(rows, messages, **options):
    df = rows(f"m {MESSAGES}", (messages,))
    return df.select(chat.render_chat(F.col("m"), **options)).first()[0]


def test_render_turns(rows):
    talk = [("system", "S "), ("user", "u1"), ("assistant", "a1"), ("user", "u2")]
    assert render(rows, talk, add_generation_prompt=True) == (
        "<bos><start_of_turn>user\nS\n\nu1<end_of_turn>\n<start_of_turn>model\na1<end_of_turn>\n"
        "<start_of_turn>user\nu2<end_of_turn>\n<start_of_turn>model\n"
    )
    assert render(rows, talk[1:2]) == "<start_of_turn>user\nu1<end_of_turn>\n"
    assert render(rows, talk[:2], template=chat.HEADER_TEMPLATE, add_generation_prompt=True) == (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>"
        "<|start_header_id|>user<|end_header_id|>\n\nu1<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
    )


def test_spans_cut_exactly_the_answers(rows):
    talk = [("system", "S"), ("user", "ü1"), ("assistant", "a ä 1"), ("user", "u2"), ("assistant", ""), ("user", "u3")]
    df = rows(f"m {MESSAGES}", (talk,)).select(chat.render_chat(F.col("m")).alias("text"))
    row = C.supervised_spans(df).first()
    assert [row.text[s.start : s.end] for s in row.spans] == ["a ä 1<end_of_turn>\n", "<end_of_turn>\n"]
    plain = rows("text STRING", ("no markers",))
    assert C.supervised_spans(plain).first().spans == []


def test_cap_length(rows):
    row = C.cap_length(rows("text STRING", (" a  b\nc d",)), 3).first()
    assert (row.n_tokens, row.tokens) == (4, ["a", "b", "c"])
    assert C.cap_length(rows("text STRING", ("  ",)), 3).first().tokens == []
    letters = C.cap_length(rows("text STRING", ("abcd",)), 2, tokenizer=lambda c: F.split(c, ""))
    assert letters.first().tokens == ["a", "b"]


def test_exact_tokenizer_as_a_pandas_udf(rows):
    import pandas as pd

    @F.pandas_udf("array<string>")
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(list)

    assert C.cap_length(rows("text STRING", ("abcd",)), 3, tokenizer=letters).first().tokens == ["a", "b", "c"]


def plain_mask(text, starts):
    """Character by character, as the markers stand."""
    inside, k, mask = False, 0, []
    while k < len(text):
        for marker, opens in (("<start_of_turn>model\n", True), ("<start_of_turn>user\n", False)):
            if text.startswith(marker, k):
                mask += [False] * len(marker)
                k += len(marker)
                inside = opens
                break
        else:
            mask.append(inside)
            k += 1
    return [mask[s] for s in starts]


PIECES = ["<start_of_turn>user\n", "<start_of_turn>model\n", "<end_of_turn>\n", "hello there ", "ä 日本 ", "x", " ", "<start_of_turn>", "model\n", ""]


@given(st.lists(st.sampled_from(PIECES), max_size=25))
@settings(max_examples=300, deadline=None)
def test_labels_equal_a_mask_made_character_by_character(pieces):
    text = "".join(pieces)
    (ids, starts, stops), = tokens.word_tokens([text])
    letters = list(range(len(text)))
    for places in (starts, letters):
        assert tokens.learned(places, *tokens.answer_spans(text)).tolist() == plain_mask(text, places)
    assert [text[a:b] for a, b in zip(starts, stops)] == text.split() or "\x1c" in text


def test_token_labels(rows):
    text = "<start_of_turn>user\nhow are you<end_of_turn>\n<start_of_turn>model\nfine thanks<end_of_turn>\n<start_of_turn>user\nok"
    examples = rows("id INT, text STRING, labels STRING, _tokenized INT", (1, text, "x", 7), (2, None, "x", 7), (3, "", "x", 7), (4, "no marker", "x", 7))
    got = {r.id: r for r in C.token_labels(examples.drop("_tokenized")).collect()}
    assert [x != -100 for x in got[1].labels] == [False] * 5 + [True] * 2 + [False] * 2
    assert all(a == b for a, b in zip(got[1].labels, got[1].input_ids) if a != -100)
    assert got[2].labels == got[3].labels == [] and got[4].labels == [-100, -100] and got[1].text == text


def test_token_labels_by_a_vocabulary(rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    text = "<start_of_turn>user\nhow are you<end_of_turn>\n<start_of_turn>model\nwonderful, thank you<end_of_turn>\n"
    coded = tokens.library_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    row = C.token_labels(rows("text STRING", (text,)), coded).first()
    (ids, starts, stops), = coded([text])
    assert row.input_ids == ids
    taught = [text[a:b] for a, b, x in zip(starts, stops, row.labels) if x != -100]
    assert "".join(taught).startswith("wonderful, thank you<end") and len(row.labels) == len(ids)


def test_very_many_turns_take_linear_time():
    import time

    text = "".join(f"<start_of_turn>user\nq{k}\n<start_of_turn>model\na{k} b\n" for k in range(60_000))
    began = time.process_time()
    (_, starts, _), = tokens.word_tokens([text])
    assert int(tokens.learned(starts, *tokens.answer_spans(text)).sum()) == 120_000
    assert time.process_time() - began < 20


def test_token_labels_a_portion_at_a_time(spark):
    """However many texts a batch has, and one that is longer than a portion."""
    def told(texts):
        assert len(texts) <= tokens.PORTION_TEXTS and sum(map(len, texts[:-1])) < tokens.PORTION_BYTES
        return tokens.word_tokens(texts)

    body = F.when(F.col("id") == 7, F.repeat(F.lit("b "), tokens.PORTION_BYTES)).when(F.col("id") == 8, F.lit(None)).otherwise(F.repeat(F.lit("a "), F.col("id").cast("int") % 5000))
    got = C.token_labels(spark.range(0, 1500, 1, 1).select("id", body.alias("text")), told).select("id", F.size("input_ids"), F.size("labels")).collect()
    n = {i: tokens.PORTION_BYTES if i == 7 else 0 if i == 8 else i for i in range(1500)}
    assert [tuple(r) for r in got] == [(i, n[i], n[i]) for i in range(1500)]
