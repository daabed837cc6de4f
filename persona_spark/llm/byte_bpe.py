"""The byte-level BPE vocabulary: whole texts encoded to the ids of the tokenizers library."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers

DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def _bytes_of_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Encoder for one vocabulary file of the tokenizers library.

    tiktoken encodes with the same pairs and the same rule for words, several times as fast; the tests hold both against each
    other on every code point. Texts with the string of an added token, and any that it gives up on, go through the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = _bytes_of_letters()
        added = [t["content"] for t in stored["added_tokens"]]
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in stored["model"]["vocab"].items() if token not in added}
        self._fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._added = added
        self.size = self._library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.size <= 1 << 16 else 4

    def encode_whole(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if any(token in text for token in self._added):
            return self.encode_whole(text)
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as error:  # a panic of the native code is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.encode_whole(text)

    def serialize(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str | None = None) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path or public_tokenizers.path(DEFAULT_VOCABULARY))
