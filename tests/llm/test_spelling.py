"""Spelling variants against all pairs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from persona_spark.llm import spelling as S

WORDS = "word string, n long, near string, key int"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


def grouped(rows, counts, **more):
    return {tuple(r) for r in S.spelling_variants(rows(WORDS, *[(w, n, "x", 1) for w, n in counts.items()]), **more).collect()}


@pytest.mark.parametrize("symbols", [2, 16])
def test_small_alphabets_with_many_near_words(rows, symbols):
    rng = random.Random(symbols)
    counts = {"".join(rng.choice("abqrÀé") for _ in range(rng.randint(3, 6))): rng.choice([1, 2, 30, 400]) for _ in range(400)}
    assert grouped(rows, counts, symbols=symbols) == plain(counts)


def test_chains_ties_and_long_words(rows):
    long = "".join(random.Random(1).choices("abcdefg", k=30_000))
    counts = {
        "achlichau": 5000, "chlichau": 50, "chlichäau": 2, "aaaaaaaa": 20, "aaaaaaab": 20, "aaaaaaac": 2,
        "ééééééé": 1000, "éééééé": 3, "ÀÀÀÀÀÀÀ": 9, long: 40, long[:15_000] + long[15_001:]: 2, "lonely": 1,
    }
    found = {r[0]: r for r in grouped(rows, counts)}
    assert set(found.values()) == plain(counts)
    assert found["chlichäau"][2] == "achlichau" and found["aaaaaaac"][1] == "aaaaaaaa"


def test_each_neighbour_once():
    words = ["aabbc", "aaaaa", "abcde", "c" * 5]
    reduced = S.Reduced(words, 4)
    for i, word in enumerate(words):
        symbols = [ord(c) % 4 for c in word]
        want = {tuple(symbols[:k] + symbols[k + 1 :]) for k in range(5)}
        want |= {tuple(symbols[:k] + [s] + symbols[k + 1 :]) for k in range(5) for s in range(4)} - {tuple(symbols)}
        want |= {tuple(symbols[:k] + [s] + symbols[k:]) for k in range(6) for s in range(4)}
        letters = "dabc"  # of these symbols
        keys = {int(S.Reduced(["".join(letters[s] for s in w)], 4).keys()[0]) for w in want}
        for tile in (1, 100):
            got = [int(k) for start in range(0, 6, tile) for rows, key in reduced.neighbours(start, start + tile) for r, k in zip(rows, key) if r == i]
            assert len(got) == len(want) and set(got) == keys


def test_vocabulary_equals_a_plain_count(rows):
    texts = [(1, "Straßen-Straßen ÀÉCOLES écoles Übermut"), (None, "Wandering WANDERING wandering9wandering"), (2, None), (3, ""), (4, "short word"), (1, "Straßen-Straßen ÀÉCOLES"), (7, "Zauberkugeln " * 9000)]
    want = Counter()
    for doc_id, text in texts:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 3 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                want[word] += 1
    docs = rows("doc_id long, text string, word string, n int, _run string, _h int, _doc int", *[(*t, "w", 1, "r", 2, 3) for t in texts])
    found = S.vocabulary(docs, misspell=3)
    assert {(r.word, r.n) for r in found.collect()} == {(w, n) for w, n in want.items() if n >= 2}


def test_empty_and_null(rows):
    assert grouped(rows, {}) == set()
    found = S.spelling_variants(rows(WORDS, (None, 3, "x", 1), ("abcdefg", 2, "x", 1))).collect()
    assert [tuple(r) for r in found] == [("abcdefg", None, "abcdefg", 2, 0, None)]


def test_a_full_sieve_loses_nothing(rows, monkeypatch):
    monkeypatch.setattr(S, "MAX_SIEVE", 1 << 15)
    counts = {"".join(random.Random(i).choices("abc", k=5)): 2 + 40 * (i % 2) for i in range(150)}
    assert grouped(rows, counts) == plain(counts)
    assert np.count_nonzero(S.sieve(S.reduced_vocabulary(rows(WORDS, ("abcdefg", 2, "x", 1))))) == 1
