"""Chat formatting by prefix-target expansion: one example per assistant turn, all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, NAMED, END = "<|", "|>\n", "<|end|>\n"

#: Control strings all start with "<", which no escaped text holds. "%" is escaped so that it can be undone.
ESCAPES = (("%", "%25"), ("<", "%3C"))
#: The marker behind a role starts with "|", which no escaped role holds.
ROLE_ESCAPES = (*ESCAPES, ("|", "%7C"))


def escape(c: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in escapes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def expand_examples(turns: DataFrame) -> DataFrame:
    """Examples of all conversations: conv_id, example_no, n_turns, is_last, formatted, loss_start, loss_chars.

    `formatted` holds the turns up to an assistant turn, marked and escaped; only the text of that last turn is
    under the loss mask, from code point `loss_start` on for `loss_chars` code points. Turns after the last
    assistant turn, or a conversation without one, come as one more example whose mask is empty, so that nothing
    is lost. Turns are put in order of turn, role and text, nulls first; repeated rows stay. Null texts and roles
    are empty ones, rows with a null conv_id make one conversation, and other columns are left out.

    Turns meet in one shuffle by conversation; a conversation is one row from there on, as any format of whole
    conversations needs. Examples are made from it one at a time.
    """
    def clean(name: str) -> Column:
        return F.coalesce(name, F.lit("")).alias(name)

    grouped = (
        turns.select("conv_id", "turn", clean("role"), clean("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    )
    piece = F.transform(
        "_turns",
        lambda t: F.concat(F.lit(OPEN), escape(t.role, ROLE_ESCAPES), F.lit(NAMED), escape(t.text), F.lit(END)),
    )
    pieces = grouped.withColumn("_pieces", piece)
    ends = F.expr(
        "filter(sequence(1, size(_turns)), i -> _turns[i - 1].role = 'assistant' OR i = size(_turns))"
    )
    return (
        pieces.withColumn("_ends", ends)
        .select("conv_id", "_turns", "_pieces", F.posexplode("_ends").alias("example_no", "n_turns"))
        .select(
            "conv_id",
            "example_no",
            "n_turns",
            (F.col("n_turns") == F.size("_turns")).alias("is_last"),
            F.concat_ws("", F.slice("_pieces", F.lit(1), F.col("n_turns"))).alias("formatted"),
            F.when(
                F.expr("_turns[n_turns - 1].role = 'assistant'"),
                F.length(F.expr("_pieces[n_turns - 1]")) - len(OPEN + "assistant" + NAMED + END),
            )
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("loss_chars"),
        )
        .withColumn("loss_start", F.length("formatted") - len(END) - F.col("loss_chars"))
    )


def parse_turns(formatted: Column) -> Column:
    """The roles and texts of a formatted example, as array<struct<role,text>>."""
    pieces = F.split(F.substring(formatted, len(OPEN) + 1, 2**31 - 1), r"<\|end\|>\n(<\||$)")
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(p, NAMED, 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(p, F.instr(p, NAMED) + len(NAMED), F.length(p))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its examples: all turns, and all text under the loss mask."""
    read = examples.withColumn(
        "_loss", unescape(F.expr("substring(formatted, CAST(loss_start AS INT) + 1, CAST(loss_chars AS INT))"))
    )
    turns = parse_turns(F.col("formatted"))
    lines = F.concat_ws("", F.transform("_parsed", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    per = (
        read.withColumn("_parsed", F.when(F.col("is_last"), turns))
        .select(
            "conv_id",
            "example_no",
            "_loss",
            F.length("formatted").alias("_chars"),
            F.when(F.col("is_last"), F.size("_parsed")).alias("_n"),
            F.when(F.col("is_last"), F.sha2(lines, 256)).alias("_sha"),
        )
    )
    return (
        per.groupBy("conv_id")
        .agg(
            F.max("_n").cast("bigint").alias("n_turns"),
            F.max("_sha").alias("turns_sha256"),
            F.sort_array(F.collect_list(F.struct("example_no", "_loss"))).alias("_losses"),
            F.sum("_chars").cast("bigint").alias("formatted_chars"),
            F.count("*").alias("n_examples"),
        )
        .withColumn("_all", F.concat_ws("", F.col("_losses._loss")))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("_all").cast("bigint").alias("loss_chars"),
            F.sha2("_all", 256).alias("loss_sha256"),
            "formatted_chars",
            "n_examples",
        )
    )
