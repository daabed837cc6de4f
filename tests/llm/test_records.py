"""Token records: frames, files, index, and the ids of the library."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from persona_spark.llm import token_records as T
from persona_spark.llm.byte_bpe import byte_bpe
from persona_spark.llm.queries import QUERIES
from tests.llm.test_native import SF_DIR

DOCS = "doc_id long, text string, value int, _doc int, file string, shard int, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def plain(library, docs):
    """(doc_id, start, n_tokens, ids_crc32) for (doc_id, text) in order."""
    out, start = [], 0
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def doc(doc_id, text):
    return (doc_id, text, 1, 2, "f", 3, "n")


def test_query_equals_the_library(spark, library):
    table = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = plain(library, sorted((r["doc_id"], r["text"]) for r in table))
    found = QUERIES["op11_token_records"](spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == want


def test_every_code_point_is_encoded_as_by_the_library(library):
    bpe = byte_bpe()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4096):
        text = "".join(f"a{c} {c}1{c}{c}!{c}  {c}b" for c in map(chr, points[k : k + 4096]))
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a" * 300_000, " " * 300_000, "\n " * 50_000, "x<|endoftext|>y", "<|endoftext|>", "it's we'LL\r\n\tgo  ", "日本語 Ελληνικά é"])
def test_odd_texts_are_encoded_as_by_the_library(library, text):
    assert byte_bpe().encode(text) == library.encode(text, add_special_tokens=False).ids


def test_nulls_repeats_ties_long_texts_and_clashing_names(rows, library):
    long = "word and other words\n" * 20_000
    docs = [(None, "b"), (None, None), (1, ""), (2, long), (3, "x"), (3, "y"), (3, "x"), (-5, "neg"), (2**62, "far")]
    found = T.token_records(rows(DOCS, *[doc(*d) for d in docs])).collect()
    got = sorted([tuple(r) for r in found], key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -5, 1, 2, 3, 3, 3, 2**62]
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    want = sorted((str(d), n, crc) for d, _, n, crc in plain(library, docs))
    assert sorted((str(d), n, crc) for d, _, n, crc in got) == want


def test_empty_table(rows):
    assert T.token_records(rows(DOCS)).collect() == []


def test_small_blocks_and_shuffled_reads(spark, rows, library, tmp_path, monkeypatch):
    docs = [(i, f"text of number {i} " * (i % 7)) for i in range(500)]
    folder = str(tmp_path / "records")
    monkeypatch.setattr(T, "BLOCKS_PER_FILE", 2)
    T.write_records(rows(DOCS, *[doc(*d) for d in docs]), folder, block_bytes=256)
    index = T.read_index(spark, folder)
    assert index.select("file").distinct().count() > 8  # more files than shards
    assert [r.doc_id for r in index.orderBy("shard", "block", "record").collect()] == list(range(500))
    some = index.where("doc_id % 3 = 0").orderBy(F.xxhash64("doc_id"))
    got = T.read_at(some).collect()
    want = {d: library.encode(t, add_special_tokens=False).ids + [0] for d, t in docs}
    assert len(got) == 167 and all(r.ids == want[r.doc_id] for r in got)
    assert [r.doc_id for r in got] == [r.doc_id for r in some.collect()]


@pytest.mark.parametrize("at", [3, 9, 40, -4])
def test_damaged_files_are_noticed(at):
    header = T.frame(T.HEADER.pack(T.MAGIC, 2, 0, 0, 1))
    record = T.frame(T.PREFIX.pack(1, 7) + np.arange(5, dtype="<u2").tobytes())
    data = bytearray(header + b"\n" + record + b"\n")
    assert [T.unpacked(p, w)[1].tolist() for *_, w, p in T.records_of(memoryview(data))] == [[0, 1, 2, 3, 4]]
    data[at] ^= 1
    with pytest.raises(T.BrokenRecord):
        list(T.records_of(memoryview(bytes(data))))


def test_cut_files_are_noticed():
    data = T.frame(T.HEADER.pack(T.MAGIC, 2, 0, 0, 2)) + b"\n" + T.frame(T.PREFIX.pack(1, 7)) + b"\n"
    with pytest.raises(T.BrokenRecord):
        list(T.records_of(memoryview(data)))
