"""Token counts with the whole-token shortcut (operator 9).

For a sentencepiece BPE model the vocabulary itself proves what can be counted without
merging.  No piece has a word mark (the visible space) after another character, so a text
falls into chunks at every space that follows a non-space, and no merge crosses them; no
piece holds a line break, so chunks fall apart there too.  A piece that starts with the mark
and that the library encodes, alone, as itself is one token wherever it stands as a chunk:
those are found once per worker, by encoding the whole vocabulary.  Chunks in that table
count 1, all others are merged by the library, once per distinct chunk.  A model for which
one of the proofs fails is counted by the library text by text.

Vocabularies of the tokenizers library (``.json``, byte level) use the chunk cache of
``byte_level``.

Defined cases: null counts as empty text (0 tokens); other columns pass through.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.byte_level import ByteLevelEncoder
from pactlens.llm.common import fresh, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
SPACED = re.compile(r" +[^ ]*")
#: Bytes of the kept chunks, those of one entry besides its letters, and the longest chunk kept.
KEPT_BYTES, ENTRY_BYTES, KEPT_LETTERS = 128 << 20, 100, 64


class PieceCounter(dict):
    """Space-led chunk (without that one space) to its number of tokens."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.held = 0
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.proven = self._prove()

    def library(self, text: str) -> int:
        return len(self.model.encode(text))

    def _prove(self) -> dict[str, int] | None:
        """The pieces that stand alone as one token; None if chunks are not independent."""
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            return None
        # The text must reach the merges unchanged, with one mark in front.
        probe = "a  b \n c ﬁ é"
        seen = "".join(self.model.encode(probe, out_type=str)).replace("<0x0A>", "\n")
        if seen != MARK + probe.replace(" ", MARK):
            return None
        words = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
        encoded = self.model.encode(words, num_threads=1)
        return {w: 1 for w, ids in zip(words, encoded) if [self.model.id_to_piece(i) for i in ids] == [MARK + w]}

    def __missing__(self, chunk: str) -> int:
        n = self.proven.get(chunk) or self._merged(chunk)
        if len(chunk) <= KEPT_LETTERS:
            self.held += ENTRY_BYTES + sys.getsizeof(chunk)
            if self.held > KEPT_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = n
        return n

    def _merged(self, chunk: str) -> int:
        first, *lines = chunk.split("\n")
        n = 1 if not first else self.proven.get(first) or self.library(first)
        # A line break is one token of its own; in front of it the library puts the mark.
        for line in lines:
            n += 1 + (self.library("\n" + line) - 2 if line else 0)
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.proven is None:
            return self.library(text)
        if MARK in text:
            text = text.replace(MARK, " ")
        chunks = text.split(" ")
        if "" in chunks:
            chunks = [c[1:] for c in SPACED.findall(" " + text)]
        return sum(map(self.__getitem__, chunks))


def _counter(vocabulary: str):
    def make():
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        return PieceCounter(path) if path.endswith(".model") else ByteLevelEncoder(path)

    counter = worker_cache(f"counter:{vocabulary}", make)
    return counter.count if hasattr(counter, "count") else lambda text: len(counter.encode(text)) // 4


def token_count(text: Column, vocabulary: str) -> Column:
    """The number of tokens of a text, as the vocabulary's library gives it."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = _counter(vocabulary)
        for texts in batches:
            yield pd.Series([counted(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def with_token_counts(docs: DataFrame, vocabulary: str, limit: int, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (names that are taken get a longer one)."""
    n_bytes, n_tokens, over = (fresh(docs, c) for c in ("n_bytes", "n_tokens", "over_limit"))
    return docs.select(
        "*", F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias(n_bytes), token_count(F.col(text_col), vocabulary).alias(n_tokens)
    ).withColumn(over, F.col(n_tokens) > limit)
