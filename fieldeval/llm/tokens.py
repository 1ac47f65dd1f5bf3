"""Byte-level BPE ids of a public vocabulary, with a bounded memory of words seen."""

from __future__ import annotations

import base64
from functools import cache, cached_property

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: This string in a text is one token of its own.
SPECIAL = "<|endoftext|>"
#: Words remembered in each worker; beyond it the memory starts anew.
REMEMBERED = 60_000
#: Where a space stands before white space, words can't be cut at single spaces.
_SPACE_RUN = regex.compile(r" \s")


class ByteBpe:
    """Ids as the vocabulary file's own tokenizer gives them.

    A text is cut before each single space, where this vocabulary never joins, and each
    word's ids are looked up or encoded by the same ranks. Texts with runs of spaces are
    encoded whole, and those with the special string by the tokenizer itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> None:
        with open(ranks, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}
        )
        self._encode = encoding.encode_ordinary
        self._vocabulary = vocabulary
        self._seen: dict[str, list[int]] = {}

    @cached_property
    def _whole(self) -> Tokenizer:
        """The tokenizer itself, read where a text needs it."""
        return Tokenizer.from_file(self._vocabulary)

    def ids(self, text: str) -> list[int]:
        """All ids of a text."""
        if SPECIAL in text:
            return self._whole.encode(text, add_special_tokens=False).ids
        if _SPACE_RUN.search(text):
            return self._encode(text)
        if len(self._seen) > REMEMBERED:
            self._seen = {}
        seen, encode = self._seen, self._encode
        head, *rest = text.split(" ")
        out = list(encode(head))
        for word in rest:
            found = seen.get(word)
            if found is None:
                found = seen[word] = encode(" " + word)
            out += found
        return out


@cache
def byte_bpe(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> ByteBpe:
    """One encoder for each worker process."""
    return ByteBpe(vocabulary, ranks)
