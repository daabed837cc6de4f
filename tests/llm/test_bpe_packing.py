"""Chunked BPE against the library, and packing against its own rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from persona_spark.llm import chunk_bpe, packing, word_bpe as word_bpe_module
from persona_spark.llm.word_bpe import word_bpe

ALPHABET = "abcXYZ'’ \n\t.,!09éÉß²½_\x1c\x85\xa0´ıİsStTrReEvVmMlLdD'''   <|>Σσς́"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_encoder_equals_library(library, text):
    bpe = word_bpe()
    assert bpe.encode(text) == ids_of(library, text)
    assert bpe.decode(bpe.encode(text)) == library.decode(bpe.encode(text), skip_special_tokens=False)


def test_forgotten_words_are_learned_again(library, monkeypatch):
    monkeypatch.setattr(word_bpe_module, "MAX_REMEMBERED", 20)
    bpe, chance = word_bpe_module.WordBpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(4)
    for _ in range(200):
        text = " ".join(f"w{chance.choice('abcdefgh')}{chance.choice('ijklmnop')}x" for _ in range(12))
        assert bpe.encode(text) == ids_of(library, text)


def test_control_strings_are_left_to_the_library(library):
    text = "a <|endoftext|> b <|startoftext|>"
    assert word_bpe().encode(text) == ids_of(library, text)
    assert 49407 in word_bpe().encode(text)


def test_chunks_cut_anywhere_are_repaired(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "ZERO_BITS", 3)
    monkeypatch.setattr(chunk_bpe, "MIN_SHARED_CHARS", 2)
    chance, reused = random.Random(5), 0
    for _ in range(600):
        text = "".join(chance.choice(ALPHABET[:-8]) for _ in range(chance.randrange(0, 250)))
        bpe = word_bpe()
        if bpe.is_plain(text):
            found = {k: chunk_bpe.encode_chunk(bpe, text[a:b]) for a, b, k in chunk_bpe.chunk_keys(text)}
            ids, n = chunk_bpe.encode_document(bpe, text, found)
            reused += n
            assert ids == ids_of(library, text)
    assert reused > 100


def test_chunks_depend_on_content_alone():
    chance = random.Random(6)
    text = "".join(chance.choice("abcde ") for _ in range(5000))
    ends = chunk_bpe.chunk_ends(text)
    moved = [e - 100 for e in chunk_bpe.chunk_ends("x" * 100 + text) if e > 120]
    assert set(e for e in ends if e > 20) == set(moved) and len(ends) > 5


def test_query_rows(spark, rows, library):
    shared = " ".join(f"word{i} of a long shared passage" for i in range(60))
    texts = [None, "", "a", shared, "x " + shared, shared + " tail", shared, "Ärger Σ " + shared, "w" * 5000]
    docs = rows("doc_id long, text string, _id int, key string", *[(i, t, 1, "k") for i, t in enumerate(texts)], (None, shared, 1, "k"), (3, shared, 1, "k"))
    found = chunk_bpe.chunk_bpe(docs, keep_ids=True).collect()
    assert len(found) == 11
    for r in found:
        assert r.ids == ids_of(library, shared if r.doc_id is None else texts[r.doc_id])
    assert sum(r.n_reused for r in found) > 1000
    assert chunk_bpe.chunk_bpe(docs.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_patterns_use_every_piece_once_and_fit(counts):
    used: dict[int, int] = {}
    for times, pattern in packing.slack_patterns(counts, 64):
        assert sum(length * n for length, n in pattern.items()) <= 64
        for length, n in pattern.items():
            used[length] = used.get(length, 0) + times * n
    assert used == counts


def test_a_bin_is_as_full_as_it_can_be():
    assert packing.slack_patterns({60: 1, 3: 5, 4: 1}, 64)[0] == (1, {60: 1, 4: 1})
    assert packing.slack_patterns({33: 2, 31: 2, 30: 4}, 64) == [(2, {33: 1, 31: 1}), (2, {30: 2})]
    with pytest.raises(ValueError):
        packing.slack_patterns({65: 1}, 64)


def test_packed_sequences(spark, rows, library, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_BUCKET", 10)
    chance = random.Random(7)
    texts = [None, "", *["a " * chance.randrange(1, 90) for _ in range(60)]]
    docs = rows("doc_id long, text string, length string", *[(i, t, "x") for i, t in enumerate(texts)], *[(None, "b b", "x")] * 30)
    found = packing.best_fit_packing(docs, max_tokens=32, keep_ids=True).collect()
    by_doc: dict = {}
    for r in found:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id is not None:
            by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, 32 * len(pieces), 32))
        assert sum((r.ids for r in pieces), []) == ids_of(library, t) + [0]
    assert sum(r.doc_id is None for r in found) == 30
    sequences: dict = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    for members in sequences.values():
        place = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 32
    assert len(sequences) <= -(-sum(r.length for r in found) // 32) + 1
    assert packing.best_fit_packing(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["", " ", "It's a test, isn't it? 123", "ÄÖÜ straße ſ", "日本語 and more", "a <|endoftext|> b", "word " * 3000, "x" * 5000])
def test_bytes_are_the_ids(text):
    bpe = word_bpe()
    for _ in range(2):
        assert np.frombuffer(bpe.encode_bytes(text), "<u4").tolist() == bpe.encode_whole(text)


def test_forgotten_words_are_learned_again(monkeypatch):
    from persona_spark.llm import word_bpe as W

    monkeypatch.setattr(W, "MAX_REMEMBERED", 10)
    bpe = W.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(60):
        text = " ".join(f"{a}word{k}{b}" for a in "abc" for b in "xyz")
        assert np.frombuffer(bpe.encode_bytes(text), "<u4").tolist() == bpe.encode_whole(text)


def test_every_placed_piece_of_the_query_is_its_documents(spark):
    """The whole table against the library: pieces, checksums, and sequences without gaps or overlaps."""
    import zlib
    from collections import defaultdict

    import pyarrow.parquet as pq

    from persona_spark.llm.queries import QUERIES
    from tests.llm.test_native import SF_DIR

    want = {}
    for row in pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        ids = word_bpe().encode_whole(row["text"] or "") + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[row["doc_id"], piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    found = QUERIES["op4_best_fit_packing"](spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(sequences) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 1
