"""Token ids of whole texts for byte-level BPE vocabularies of the tokenizers library.

The pre-tokenizer never joins what stands before and after a space that a non-space
follows, so the ids of a text are those of its space-led chunks in order.  Every distinct
chunk is encoded by the library once per worker and kept; the cache is emptied when it holds
its budget of bytes, and long chunks (texts without spaces) are not kept.

Texts of Latin letters only, on whose classes all Unicode versions agree, are cut into the
pre-tokens themselves: a word is then one entry, whatever marks or line breaks follow it.
"""

from __future__ import annotations

import os
import re
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE_BEFORE_WORD = re.compile(r" (?=\w)")
#: The pre-tokenizer's pattern up to U+024F, by lists of its letters, numbers, white space and the rest; what lies beyond comes last.
_LATIN = [chr(c) for c in range(0x250)]
_L = "".join(c for c in _LATIN if c.isalpha())
_N = "0123456789²³¹¼½¾"
_S = "\t\n\x0b\x0c\r \x85\xa0"
_REST = re.escape("".join(c for c in _LATIN if c not in _L + _N + _S))
PRE_TOKENS = re.compile(rf" ?[{_L}]+|'(?:[sdmt]|ll|ve|re)| ?[{_N}]+| ?[{_REST}]+|[{_S}]+(?![^{_S}])|[{_S}]+|[^{_L}{_N}{_S}{_REST}]+")
#: Bytes that a cache of chunks may hold, those of one entry besides its letters and ids, and the longest chunk kept.
KEPT_BYTES, ENTRY_BYTES, KEPT_LETTERS = 256 << 20, 170, 64


class _Irregular(Exception):
    """A chunk that is empty or starts with white space, or a letter beyond U+024F."""


class _Kept(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers, encoded at first use."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= KEPT_LETTERS:
            self.held += ENTRY_BYTES + 4 * len(chunk) + len(ids)
            if self.held > KEPT_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = ids
        return ids


class _Chunks(_Kept):
    """The same of chunks that follow ``lead``."""

    def __init__(self, encode, lead: str):
        super().__init__(lambda chunk: encode(lead, chunk))
        self.lead = lead

    def __missing__(self, chunk: str) -> bytes:
        if self.lead and (not chunk or chunk[0].isspace()):
            raise _Irregular
        return super().__missing__(chunk)


class ByteLevelEncoder:
    """``encode(text)`` equals the library's ids of the whole text without added tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1
        # bytes stand for themselves, the others follow from U+0100 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.four = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]
        pre = self.tokenizer.pre_tokenizer
        self.known_pattern = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.pre_tokens = _Kept(self._latin)
        self.after_space = _Chunks(self._chunk, " ")
        self.at_start = _Chunks(self._chunk, "")

    def library(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pre_token(self, text: str) -> bytes:
        """The ids of a text that is one pre-token."""
        mapped = text.encode().decode("latin-1").translate(self.stand_in)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(mapped)])

    def _latin(self, text: str) -> bytes:
        if text[-1] > "ɏ":
            raise _Irregular
        return self._pre_token(text)

    def _chunk(self, lead: str, chunk: str) -> bytes:
        cache = self.after_space if lead else self.at_start
        if len(chunk) < 200 and "\n" in chunk[1:-1]:
            # A single line break between other characters is a pre-token of its own.
            parts = chunk.split("\n")
            if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
                return self.at_start["\n"].join([cache[parts[0]], *map(self.at_start.__getitem__, parts[1:])])
        if chunk and max(chunk) < "ɐ":  # letters on which all Unicode versions agree
            if chunk.isalpha():
                return self._pre_token(lead + chunk)
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return cache[chunk[:-1]] + self.at_start[chunk[-1]]
        return self.library(lead + chunk)

    def encode(self, text: str) -> bytes:
        for special in self.added:
            if special in text:
                return self.library(text)
        if self.known_pattern:
            try:
                return b"".join(map(self.pre_tokens.__getitem__, PRE_TOKENS.findall(text)))
            except _Irregular:
                pass
        first, *chunks = text.split(" ")
        try:
            if not first and text:
                raise _Irregular
            return b"".join([self.at_start[first] if first else b"", *map(self.after_space.__getitem__, chunks)])
        except _Irregular:
            first, *chunks = SPACE_BEFORE_WORD.split(text)
            return b"".join([self.at_start[first] if first else b"", *map(self.after_space.__getitem__, chunks)])
