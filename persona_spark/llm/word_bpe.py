"""The word BPE vocabulary: whole texts encoded as the tokenizers library does, words remembered per worker."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain, islice

import numpy as np
from public_tokenizers import path as vocabulary_path

DEFAULT_VOCABULARY = "word_bpe_49k.json"

#: Texts of these characters only need no Unicode composition, and lower-casing works character by character.
_LAST_PLAIN = 0x2FF
_PLAIN = re.compile("[\x00-įı-˿]*")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def _class(prefix: str) -> str:
    found = [chr(c) for c in range(_LAST_PLAIN + 1) if unicodedata.category(chr(c)).startswith(prefix)]
    return "".join(map(re.escape, found))


#: The vocabulary's rule for words, for plain texts. White space ends words and belongs to none.
_LETTER, _NUMBER = _class("L"), _class("N")
_WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{re.escape(_SPACES)}{_LETTER}{_NUMBER}]+"
)

#: Words remembered per worker; beyond it the later half, which holds the rarer words, is forgotten.
MAX_REMEMBERED = 300_000


class WordBpe:
    """Encoder and decoder for one vocabulary file. Words are encoded by the library, each once per worker; texts with
    characters beyond U+02FF, a dotted capital I or control strings go through the library as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._known: dict[str, tuple[int, ...]] = {}
        self._coded: dict[str, bytes] = {}
        size = self._library.get_vocab_size(with_added_tokens=True)
        self._tokens = [self._library.id_to_token(i) for i in range(size)]
        self._closes = [t.endswith("</w>") for t in self._tokens]
        self._same = list(range(size))  # one object per id, however many words hold it
        self._numbers = [str(i) for i in range(size)]
        self.id_type = "<u2" if size <= 1 << 16 else "<u4"

    @staticmethod
    def is_plain(text: str) -> bool:
        return "<|" not in text and _PLAIN.fullmatch(text) is not None

    def encode_whole(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if not self.is_plain(text):
            return self.encode_whole(text)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        return self.encode_lowered(text.lower())

    def encode_lowered(self, low: str) -> list[int]:
        words = _WORD.findall(low)
        known = self._known
        try:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        except KeyError:
            if len(known) > MAX_REMEMBERED:  # before it is seen which words are missing
                for word in list(islice(known, MAX_REMEMBERED // 2, None)):
                    del known[word]
            self._learn([w for w in set(words) if w not in known])
            return list(chain.from_iterable(map(known.__getitem__, words)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned numbers of four bytes: the words' bytes one after the other."""
        if not self.is_plain(text):
            return np.array(self.encode_whole(text), "<u4").tobytes()
        words = _WORD.findall(text.lower())
        coded = self._coded
        try:
            return b"".join(map(coded.__getitem__, words))
        except KeyError:
            if len(coded) > MAX_REMEMBERED:
                for word in list(islice(coded, MAX_REMEMBERED // 2, None)):
                    del coded[word]
            new = [w for w in set(words) if w not in coded]
            ids, ends = self._at_once(new)
            if ends is None:
                coded.update((w, np.array(self.encode_whole(w), "<u4").tobytes()) for w in new)
            else:
                data = np.array(ids, "<u4").tobytes()
                coded.update((w, data[4 * a : 4 * b]) for w, a, b in zip(new, [0, *ends], ends))
            return b"".join(map(coded.__getitem__, words))

    def _at_once(self, new: list[str]) -> tuple[list[int], list[int] | None]:
        """Encode words by one call: spaces keep them apart, and the last token of each carries the mark of a word's end. The
        ids and the words' ends among them, None for a vocabulary without such marks."""
        ids = self.encode_whole(" ".join(new))
        ends = [k for k, i in enumerate(ids, 1) if self._closes[i]]
        return ids, ends if len(ends) == len(new) else None

    def _learn(self, new: list[str]) -> None:
        known = self._known
        ids, ends = self._at_once(new)
        if ends is None:
            known.update((w, self.encode_whole(w)) for w in new)
            return
        same = self._same
        start = 0
        for word, end in zip(new, ends):
            known[word] = tuple([same[i] for i in ids[start:end]])
            start = end

    @staticmethod
    def words_from(low: str, start: int):
        """Matches of the words of a lower-cased plain text from a place on."""
        return _WORD.finditer(low, start)

    @staticmethod
    def word_starts(text: str):
        """Matches of the words of a plain text, in order."""
        return _WORD.finditer(text.lower())

    def decode(self, ids) -> str:
        """As the library without a decoder: token strings joined by spaces."""
        return " ".join(map(self._tokens.__getitem__, ids))


    def numbers(self, ids) -> str:
        """The ids in decimal, joined by spaces."""
        return " ".join(map(self._numbers.__getitem__, ids))


@lru_cache(maxsize=2)
def word_bpe(path: str | None = None) -> WordBpe:
    """One encoder per worker process and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordBpe(path or vocabulary_path(DEFAULT_VOCABULARY))
