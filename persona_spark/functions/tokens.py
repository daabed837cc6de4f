"""Tokens with their places, and which of them a trainer learns from. Plain helpers that run inside tasks."""

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from persona_spark.functions import values as V

#: For each text its token ids and the places where they begin and end, both ascending.
Tokenizer = Callable[[Sequence[str]], Sequence[tuple[Sequence[int], Sequence[int], Sequence[int]]]]

#: Label of a token that is not learned; the value that training libraries leave out of the loss.
IGNORED = -100

#: Texts handed to a tokenizer at a time: so many, or so many bytes and the one that goes beyond.
PORTION_TEXTS = 256
PORTION_BYTES = 1 << 19

_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and number of the rows of each portion, in order and without gaps."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(ends):
        stop = min(start + PORTION_TEXTS, int(np.searchsorted(ends, done + PORTION_BYTES)) + 1, len(ends))
        yield start, stop - start
        start, done = stop, int(ends[stop - 1])


def word_tokens(texts: Sequence[str]) -> list[tuple[list[int], list[int], list[int]]]:
    """Words between ASCII white space, numbered by a checksum. For counting and tests; bring a real tokenizer for training."""
    out = []
    for text in texts:
        found = [(zlib.crc32(m[0].encode()) & 0x7FFFFFFF, *m.span()) for m in _WORD.finditer(text)]
        out.append(tuple(map(list, zip(*found))) if found else ([], [], []))
    return out


def library_tokens(path: str) -> Tokenizer:
    """A vocabulary file of the tokenizers library, loaded once per task."""
    loaded = []

    def tokens(texts: Sequence[str]) -> list[tuple[list[int], list[int], list[int]]]:
        if not loaded:
            from tokenizers import Tokenizer as Library

            loaded.append(Library.from_file(path))
        coded = loaded[0].encode_batch(list(texts), add_special_tokens=False)
        return [(e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]) for e in coded]

    return tokens


def answer_spans(text: str, instruction: str = V.TURN_USER, response: str = V.TURN_MODEL) -> tuple[list[int], list[int]]:
    """Where answers begin and end: after each response marker up to the next instruction or response marker. Linear."""
    starts, stops = [], []
    at = text.find(response)
    asked = text.find(instruction)
    while at >= 0:
        start = at + len(response)
        at = text.find(response, start)
        while 0 <= asked < start:
            asked = text.find(instruction, start)
        stop = min(x for x in (at, asked, len(text)) if x >= 0)
        starts.append(start)
        stops.append(stop)
    return starts, stops


def learned(starts: Sequence[int], span_starts: Sequence[int], span_stops: Sequence[int]) -> np.ndarray:
    """For each token, by where it begins, whether that lies in a span. Both lists ascend, spans do not overlap: a step up at
    the first token of a span and down at the first behind it, summed once over the tokens."""
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, np.searchsorted(starts, span_starts), 1)
    np.add.at(steps, np.searchsorted(starts, span_stops), -1)
    return np.cumsum(steps[:-1]) > 0
