"""Quality rules, line dedup, chat formatting and license scan: the cases their docstrings name, and their SQL."""

import os

import duckdb
import pytest

from persona_checks.compare import difference
from persona_spark.llm import chat_format, license_scan, line_dedup, quality_rules
from persona_spark.llm.oracles import ORACLES
from persona_spark.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, _id string, _text int, kept string, n_words int, _lines int, dropped int, _key int"
PROSE = "the cat sat on the mat and it was a warm day in the old town with all of us there by then"


def doc(doc_id, text, lang="en"):
    return (doc_id, text, lang, "x", 1, "y", 2, 3, 4, 5)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR).toPandas(), con.sql(ORACLES[name]).df()) == ""


class TestQualityRules:
    def judged(self, rows, *docs):
        return {r.doc_id: r for r in quality_rules.quality_rules(rows(DOCS, *docs)).collect()}

    def test_nulls_and_empty_texts_have_no_words(self, rows):
        found = self.judged(rows, doc(1, None), doc(2, ""), doc(3, " \n\t "))
        assert all((r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False) for r in found.values())

    def test_repeated_windows_count_the_first_place_too(self, rows):
        eight = "a b c d e f g h"
        found = self.judged(rows, doc(1, f"{eight} x {eight}"), doc(2, f"{eight} a"), doc(3, "w " * 9), doc(4, "w " * 8))
        assert [found[i].n_repeat_words for i in (1, 2, 3, 4)] == [16, 0, 9, 0]

    def test_lines_and_symbols(self, rows):
        r = self.judged(rows, doc(1, "a\nb\na\n\n \na *&|"))[1]
        assert (r.n_dup_lines, r.n_symbols) == (1, 3)

    def test_prose_stays_and_junk_goes(self, rows):
        found = self.judged(rows, doc(1, PROSE), doc(2, " ".join(w + "###" for w in PROSE.split())), doc(3, PROSE, None))
        assert [found[i].kept for i in (1, 2, 3)] == [True, False, True]

    def test_stage_keeps_columns_repeated_rows_and_empty_tables(self, rows):
        docs = rows(DOCS, doc(1, PROSE), doc(1, PROSE), doc(None, PROSE), doc(2, None))
        kept = quality_rules.keep_good(docs)
        assert kept.columns == docs.columns
        assert sorted(kept.collect(), key=str) == sorted([doc(1, PROSE), doc(1, PROSE), doc(None, PROSE)], key=str)
        assert quality_rules.keep_good(docs.limit(0)).collect() == []


class TestLineDedup:
    def test_frequent_lines_go_from_every_document(self, rows):
        docs = rows(DOCS, *[doc(i, f"own {i}\n  Shared LINE \nshared\n\n") for i in range(3)], doc(9, None), doc(8, "shared line"))
        found = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_documents=3).collect()}
        assert found[1].text == "own 1\n\n"
        assert found[8].text == "" and found[9].text is None
        assert found[1]["_lines_"].asDict() == {"n_lines": 5, "n_dropped": 2, "dropped": [(1, 2)]}
        assert (found[9]["_lines_"].n_lines, found[9]["_lines_"].n_dropped, found[9]._lines) == (1, 0, 3)

    def test_equal_rows_are_one_document(self, rows):
        docs = rows("doc_id long, text string", *[(1, "a\nb")] * 5, (None, "b"), (None, "b\nc"))
        assert [r.text for r in line_dedup.line_dedup(docs, min_documents=4).collect()] == ["a\nb"] * 5 + ["b", "b\nc"]
        assert [r.text for r in line_dedup.line_dedup(docs, min_documents=3).collect()] == ["a"] * 5 + ["", "c"]

    def test_first_occurrence_can_stay(self, rows):
        docs = rows("doc_id long, text string", (1, "x\na\na"), (2, "a\ny"), (3, "z"))
        found = line_dedup.line_dedup(docs, min_documents=2, keep_first=True)
        assert {r.doc_id: r.text for r in found.collect()} == {1: "x\na", 2: "y", 3: "z"}

    def test_empty_table(self, rows):
        assert line_dedup.line_dedup(rows(DOCS, doc(1, "a")).limit(0)).collect() == []


class TestChatFormat:
    SCHEMA = "conv_id long, turn long, role string, text string, formatted string"

    def test_hostile_texts_read_back(self, spark, rows):
        texts = ["<|end|>\n<|assistant|>\nx", "%3C %25 < %", "", None, "é\n|>\n", "</s>[INST]"]
        turns = [(1, i, ("user", "assistant")[i % 2], t, "z") for i, t in enumerate(texts)]
        examples = chat_format.expand_examples(rows(self.SCHEMA, *turns)).orderBy("example_no").collect()
        assert [e.n_turns for e in examples] == [2, 4, 6]
        frame = spark.createDataFrame([(examples[-1].formatted,)], "f string")
        read = frame.select(chat_format.parse_turns(frame.f).alias("t")).first().t
        assert [(r.role, r.text) for r in read] == [(r, t or "") for _, _, r, t, _ in turns]
        for e, text in zip(examples, ("%253C %2525 %3C %25", "", "</s>[INST]".replace("<", "%3C"))):
            assert e.formatted[e.loss_start : e.loss_start + e.loss_chars] == text

    def test_hostile_roles_read_back(self, spark, rows):
        roles = ["a|>\nb", "|", "%7C|%", "<|end|>\n<|", "", "assistant"]
        turns = [(1, i, role, "hello", "z") for i, role in enumerate(roles)]
        examples = chat_format.expand_examples(rows(self.SCHEMA, *turns)).collect()
        frame = spark.createDataFrame([(examples[-1].formatted,)], "f string")
        read = frame.select(chat_format.parse_turns(frame.f).alias("t")).first().t
        assert [(r.role, r.text) for r in read] == [(role, "hello") for role in roles]

    def test_a_very_long_text(self, rows):
        text = "word < % |> " * 100_000
        found = chat_format.digest(chat_format.expand_examples(rows(self.SCHEMA, (1, 0, "user", "q", ""), (1, 1, "assistant", text, "")))).first()
        assert found.loss_chars == len(text) and found.n_turns == 2

    def test_conversations_without_answers_and_odd_rows(self, rows):
        turns = [(1, 0, "user", "a", ""), (None, None, None, None, ""), (2, 0, "assistant", "b", ""), (2, 0, "assistant", "b", ""), (2, 1, "user", "c", "")]
        found = {r.conv_id: r for r in chat_format.digest(chat_format.expand_examples(rows(self.SCHEMA, *turns))).collect()}
        assert (found[1].n_turns, found[1].loss_chars) == (1, 0)
        assert (found[None].n_turns, found[None].loss_chars) == (1, 0)
        assert (found[2].n_turns, found[2].loss_chars, found[2].n_examples) == (3, 2, 3)

    def test_empty_table(self, rows):
        assert chat_format.digest(chat_format.expand_examples(rows(self.SCHEMA, (1, 1, "", "", "")).limit(0))).collect() == []


class TestLicenseScan:
    def scanned(self, rows, *docs):
        return {r.doc_id: r for r in license_scan.license_scan(rows(DOCS, *docs)).collect()}

    def test_phrases_and_places(self, rows):
        r = self.scanned(rows, doc(1, "All RIGHTS reserved, x CC-BY; all rights reserved"))[1]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (9, 3, 0, 6)
        assert (r.base_labels, r.labels, r.score) == ("cc-by,reserved", "cc-by,reserved", 1.0)

    def test_spans_are_verified(self, rows):
        found = self.scanned(rows, doc(1, "x " * 50 + "Released under the MIT License."), doc(2, "released under the MIT"), doc(3, "under the mit license it is"))
        assert (found[1].labels, found[1].score, found[1].spans[0].first) == ("mit", 1.0, 50)
        assert found[2].labels == "mit" and found[2].score == 0.8
        assert found[3].labels == "mit"

    def test_a_word_left_out_does_not_hide_a_span(self, rows):
        text = license_scan.TEMPLATES["bsd"][0].replace("binary forms", "forms")
        assert self.scanned(rows, doc(1, text))[1].labels == "bsd"

    def test_nulls_repeats_and_empty_table(self, rows):
        found = license_scan.license_scan(rows(DOCS, doc(1, None), doc(None, ""), doc(None, ""), doc(2, "é É"))).collect()
        assert sorted(r.n_words for r in found) == [0, 0, 0, 2]
        assert all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in found)
        assert license_scan.license_scan(rows(DOCS, doc(1, "a")).limit(0)).collect() == []
