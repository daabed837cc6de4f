"""run() of the pipeline against a plain version, stage by stage, and the stages on odd tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from persona_spark.llm import kneser_ney
from persona_spark.llm.common import read
from persona_spark.llm.oracles import quality_sql
from persona_spark.llm.word_bpe import word_bpe
from tests.llm.test_models import PlainModel, plain_components
from tests.llm.test_native import SF_DIR

WHITE = " \t\n\x0b\x0c\r"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def signed_hash(text):
    return xxhash.xxh64(text.encode(), seed=42).intdigest()


def lower_rank(values, share):
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


def plain_rules(docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs))
    kept = {i for i, k in con.sql(f"SELECT doc_id, kept FROM ({quality_sql('documents')})").fetchall() if k}
    return [d for d in docs if d["doc_id"] in kept]


def plain_classifier(docs, labels):
    good = {i for i in labels if all(q == 1 and t == 0 for q, t in labels[i])}
    held = lambda d: signed_hash(d["text"]) % kneser_ney.HELD_OUT == 0  # noqa: E731  (a power of two: the sign is no matter)
    model = PlainModel([d["text"] for d in docs if d["doc_id"] in good and not held(d)])
    logs = {d["doc_id"]: model.log_perplexity(d["text"]) for d in docs if d["text"]}
    fit = defaultdict(list)
    for d in docs:
        if d["doc_id"] in good and held(d):
            fit[d["lang"]].append(logs[d["doc_id"]])
    middle = {lang: lower_rank(v, 0.5) for lang, v in fit.items()}
    spread = lower_rank([x - middle[lang] for lang, v in fit.items() for x in v], kneser_ney.QUANTILE)
    over_all = lower_rank([x for v in fit.values() for x in v], kneser_ney.QUANTILE)
    limit = {lang: lower_rank(v, kneser_ney.QUANTILE) if len(v) >= kneser_ney.LEAST_HELD else middle[lang] + spread for lang, v in fit.items()}
    return [d for d in docs if d["doc_id"] not in logs or logs[d["doc_id"]] <= limit.get(d["lang"], over_all) + 1e-9]


def plain_lines(docs):
    key = lambda line: line.strip(WHITE).translate(LOW)
    found = Counter(k for d in docs for k in {key(x) for x in (d["text"] or "").split("\n")} if k)
    return [d | {"text": "\n".join(x for x in (d["text"] or "").split("\n") if found[key(x)] < 10)} for d in docs]


def plain_copies(docs):
    groups = plain_components({d["doc_id"]: d["text"] for d in docs})
    return [d for d in docs if groups[d["doc_id"]][1] in (d["doc_id"], None) or groups[d["doc_id"]][0] == 0]


def plain_pieces(docs):
    out = set()
    for d in docs:
        ids = word_bpe().encode_whole(d["text"] or "") + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            out.add((d["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())))
    return out


def test_run_equals_a_plain_version(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    labels = defaultdict(list)
    for r in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist():
        labels[r["doc_id"]].append((r["quality"], r["toxic"]))
    plain = [plain_rules, lambda d: plain_classifier(d, labels), plain_lines, plain_copies]
    frame = read(spark, SF_DIR, "documents")
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, plain):
        frame = stage(spark, frame, SF_DIR).cache()
        docs = by_hand(docs)
        assert {(r.doc_id, r.text) for r in frame.collect()} == {(d["doc_id"], d["text"]) for d in docs}, name
        assert frame.count() == len(docs)
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == plain_pieces(docs) and len(found) == len(plain_pieces(docs))
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048


PROSE = "the cat sat on the mat and it was a warm day in the old town with all of us there by then number"
ODD = "doc_id long, text string, lang string, source string, n_chars int, _row int, kept boolean, key string, text_hash int"


@pytest.fixture
def odd(rows, spark, tmp_path):
    rows("doc_id long, quality int, toxic int", *[(i, 1, 0) for i in range(40)]).write.parquet(str(tmp_path / "labels.parquet"))

    def make(*docs):
        return rows(ODD, *[(i, t, lang, None, 3, 1, None, "k", 2) for i, t, lang in docs])

    return make, str(tmp_path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, odd, name, stage):
    make, folder = odd
    own = [(i, f"{PROSE} {hashlib.md5(str(i).encode()).hexdigest()} {i}\nand a line of document {i}", "en") for i in range(40)]
    long = (50, "\n".join(f"{PROSE} {k} of the very long one" for k in range(4000)), "en")
    docs = make(*own, own[3], own[3], (None, None, None), (None, PROSE, "fr"), (60, "", "xx"), (61, None, "en"), long)
    out = stage(spark, docs, folder)
    if name == "best_fit_packing":
        found = out.collect()
        assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    else:
        assert out.columns == docs.columns
        found = {r.doc_id for r in out.collect()}
        assert found <= {r.doc_id for r in docs.collect()} and set(range(40)) - {3} <= found and 3 in found
    empty = stage(spark, make(), folder)
    assert empty.count() == 0 and empty.columns == out.columns


def test_labelled_junk_that_rules_leave_does_not_pass_for_prose(spark):
    """Alone, the classifier rejects most of the junk labelled as such and keeps good texts."""
    from persona_spark.llm.queries import QUERIES

    found = QUERIES["op2_kneser_ney"](spark, SF_DIR).join(read(spark, SF_DIR, "labels"), "doc_id")
    share = {r.quality: r.k for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] >= 0.95 and share.get(0, 0) <= 0.5
