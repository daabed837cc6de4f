"""Spelling variants by reduced-alphabet generation: letters are hashed to a few symbols, the full one-edit neighbourhoods
of the reduced words meet the reduced vocabulary, and what meets is verified on the words themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.llm.common import lower_ascii
from persona_spark.scale import lookup_join
from persona_spark.session import stage_table

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: Letters are reduced to so many symbols.
SYMBOLS = 16
#: One run in so many loses a letter, told by a hash of document and run.
MISSPELL = 31

#: Neighbours made at a time in a task.
TILE = 1 << 20
#: Bits of the sieve over reduced words for each of them, and at most. A full sieve lets all through and loses nothing.
SIEVE_BITS = 32
MAX_SIEVE = 1 << 28
BITMAP_BITS = 1 << 15

_BASE = 0x9E3779B97F4A7C15
_UNBASE = np.uint64(pow(_BASE, -1, 1 << 64))


def vocabulary(docs: DataFrame, text: str = "text", misspell: int | None = MISSPELL, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z lower-cased, of at least `least_length` code points and found
    at least `least_count` times. With `misspell` a run whose hash it divides has lost one code point first."""
    run = F.col("_run")
    plain = F.octet_length(run) == F.char_length(run)
    low = F.when(plain, F.lower(run)).otherwise(lower_ascii(run))
    # Outer, as Spark works the array out once more for the filter that it adds to the plain form.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"),
        F.explode_outer(F.regexp_extract_all(text, F.lit(RUN + "{%d,}" % least_length), F.lit(0))).alias("_run"),
    ).select("_doc", low.alias("word"))
    if misspell:
        h = F.crc32(F.concat("_doc", F.lit(":"), "word").cast("binary"))
        at = F.pmod(F.col("_h"), F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.withColumn("_h", h).select(F.when(F.col("_h") % misspell == 0, cut).otherwise(F.col("word")).alias("word"))
    words = runs.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= least_count)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread over all bits, as places in the sieve are the low ones."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Reduced:
    """Words of one length over the reduced alphabet, with the hashes of the words one edit away. A hash is a polynomial in
    64 bits, so that a neighbour's follows from sums over what stands before and behind the place of the edit."""

    def __init__(self, words: list[str], symbols: int):
        n, length = len(words), len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, length)
        self.symbols = np.arange(symbols)
        self.values = _mixed(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        self.word = (letters % symbols).astype(np.int64)
        self.length = length
        self.powers = np.ones(length + 1, np.uint64)
        self.powers[1:] = np.multiply.accumulate(np.full(length, _BASE, np.uint64))
        before = np.zeros((n, length + 1), np.uint64)
        np.cumsum(self.values[self.word] * self.powers[:length], axis=1, out=before[:, 1:])
        self.before, self.whole = before, before[:, length]

    def keys(self) -> np.ndarray:
        return _mixed(self.whole)

    def neighbours(self, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, key) of what arises at the places from `start` on: each neighbour once, as an edit inside a run of equal
        symbols is made at one end of it only."""
        word, before, whole = self.word, self.before, self.whole[:, None]
        at = np.arange(start, min(stop, self.length))
        if len(at):
            own = word[:, at]
            first = np.ones(own.shape, bool)
            first[:, at > 0] = own[:, at > 0] != word[:, at[at > 0] - 1]
            rows, cols = np.nonzero(first)
            shorter = before[:, at] + (whole - before[:, at + 1]) * _UNBASE
            yield rows, _mixed(shorter[rows, cols])
            for s in self.symbols:
                rows, cols = np.nonzero(own != s)
                other = whole + (self.values[s] - self.values[own]) * self.powers[at]
                yield rows, _mixed(other[rows, cols])
        at = np.arange(start, min(stop, self.length + 1))
        if len(at):
            behind = (whole - before[:, at]) * np.uint64(_BASE) + before[:, at]
            previous = np.where(at > 0, word[:, np.maximum(at - 1, 0)], -1)
            for s in self.symbols:
                rows, cols = np.nonzero(previous != s)
                longer = behind + self.values[s] * self.powers[at]
                yield rows, _mixed(longer[rows, cols])


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, Reduced, int]]:
    """(places in `words`, the reduced words, positions that make a tile)."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        each = max(1, TILE // (int(length + 1) * 2))
        for k in range(0, len(places), each):
            some = places[k : k + each]
            yield some, Reduced([words[i] for i in some], symbols), max(1, TILE // len(some))


def reduced_vocabulary(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, key): `key` is the hash of the reduced word."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.uint64)
            for places, reduced, _ in _by_length(batch.column(0).to_pylist(), symbols):
                keys[places] = reduced.keys()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.view(np.int64))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(reduce, "word string, n bigint, key bigint")


def sieve(reduced: DataFrame) -> np.ndarray:
    """Bits at the low ends of all keys, as bytes: of a size bounded by MAX_SIEVE, whatever the size of the vocabulary."""
    bits = BITMAP_BITS
    wanted = reduced.count() * SIEVE_BITS
    while bits < min(wanted, MAX_SIEVE):
        bits *= 2
    place = F.col("key").bitwiseAND(bits - 1)
    maps = (
        reduced.groupBy(F.shiftright(place, 15).alias("part"))
        .agg(F.bitmap_construct_agg(place.bitwiseAND(BITMAP_BITS - 1)).alias("bits"))
        .collect()  # at most MAX_SIEVE bits
    )
    out = np.zeros((bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for row in maps:
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def near_words(reduced: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one inserted, deleted or replaced code point apart.

    The neighbourhoods are made in full; a sieve drops those that meet no reduced word before they are shuffled. Words of
    any length are worked off tile by tile.
    """
    spark = reduced.sparkSession
    sent = spark.sparkContext.broadcast(sieve(reduced))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        mask = np.uint64(len(bits) * 8 - 1)

        def found(keys: np.ndarray) -> np.ndarray:
            place = keys & mask
            return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            words = batch.column(0).to_pylist()
            rows, keys, held = [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys).view(np.int64))], ["word", "key"])

            for places, reduced_words, step in _by_length(words, symbols):
                rows.append(places)
                keys.append(reduced_words.keys())
                for start in range(0, reduced_words.length + 1, step):
                    for own, key in reduced_words.neighbours(start, start + step):
                        hit = found(key)
                        rows.append(places[own[hit]])
                        keys.append(key[hit])
                        held += len(rows[-1]) * (1 + reduced_words.length // 16)
                        if held > TILE // 8:
                            yield out()
                            rows, keys, held = [], [], 0
            if rows:
                yield out()

    neighbours = reduced.select("word").mapInArrow(generate, "word string, key bigint")
    others = reduced.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = neighbours.join(others, "key")
    return met.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): where following forms ends. By pointer doubling, so that rounds grow with the
    logarithm of the longest chain. Chains have no loops, as counts grow along them."""
    reached = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = lookup_join(reached, onward, ["root"], "left", ["word"]).select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        )
        step = stage_table(step, "roots")
        moved = step.where("_moved").limit(1).count()
        reached = step.drop("_moved")
        if not moved:
            return reached


def spelling_variants(words: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of a vocabulary (word, n) of distinct words.

    Near words are one code point apart. The form of a word is its near word of largest n (ties: the smallest in code-point
    order) where that is at least `ratio` times its own; root follows forms to the last. Words without one are their own
    root. A null word is left out; an empty vocabulary gives no rows.
    """
    reduced = stage_table(reduced_vocabulary(words.where("word is not null"), symbols), "vocabulary")
    best = near_words(reduced, symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    )
    largest = -F.col("best.minus")
    has = largest >= ratio * F.col("n")
    chosen = stage_table(
        reduced.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(has, F.col("best.near")).alias("form"), F.when(has, largest).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(chosen.where("form is not null"))
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
