"""Token ids of whole texts under a public word-level BPE vocabulary.

Words repeat far more often than texts do, so ids are kept per word: a text
is split as the vocabulary's own pre-tokenizer does and its ids are the
joined ids of its words. Texts with characters for which that split isn't
known to be the same go through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from functools import cache, cached_property

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from plexframe.llm.batches import KEPT

VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps at most; the table is then begun anew.
KEPT_WORDS = 300_000
#: Characters of the fast way: letters, digits and signs whose classes and lower case are beyond doubt.
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~¡-¬®-įı-ɏ‐-‧€]*")
_L, _N = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_END = b"\xff"  # not part of UTF-8, so it can stand for the end of a word


def _byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Words(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        char = _byte_characters()
        vocabulary = json.load(open(path))["model"]["vocab"]
        ranks = {}
        for token, rank in vocabulary.items():
            if token.startswith("<|"):
                continue
            end = token.endswith("</w>")
            ranks[bytes(char[c] for c in (token[:-4] if end else token)) + _END * end] = rank
        self._bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._path = path

    @cached_property
    def whole(self) -> Tokenizer:
        """The tokenizer itself, read only once a text needs it."""
        return Tokenizer.from_file(self._path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self._bpe.encode_single_piece(word.encode() + _END)
        self[word] = out = b"".join(i.to_bytes(4, "little") for i in ids)
        return out

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _WORD.findall(text.lower())))
        return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)


@cache
def words(name: str = VOCABULARY) -> Words:
    """One table per worker, until its task ends."""
    return Words(public_tokenizers.path(name))


KEPT["tokens"] = words.cache_clear
