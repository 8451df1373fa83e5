"""Text vectors and similarity.

Texts are lower-cased by the JVM; tokenising, filling a vector and multiplying blocks of
vectors are Arrow batches in Arrow and numpy, which is far cheaper than interpreting one lambda
call per word or dimension; no word becomes a Python string unless it is new.  The code of a word
is worked out once and kept, within a limit.  A table that already has vectors of a
sentence encoder uses them as they are: every operator takes a ``vec`` column.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.needles import batch_bytes

# Ship the numpy helpers with the task, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM = 64
DECIMALS = 9  # equal texts must tie exactly, whatever the shape of a block product
FILL_ROWS, FILL_BYTES = 4096, 1 << 22  # texts, and bytes of them, that are counted at once
KEPT_WORDS, KEPT_CHARS = 1 << 18, 32  # words of so many letters at most whose codes are kept
BLOCK = 256  # clauses of one document that are compared as one block


def _code(word: str, dim: int) -> int:
    """Signed-hash code of a word: ``2 * dimension + sign bit``."""
    return int(hashlib.md5(word.encode()).hexdigest()[:5], 16) % (2 * dim)


class _Codes:
    """Codes of the words of an Arrow array; short words are kept, up to a limit, and found again by Arrow."""

    def __init__(self, dim: int):
        self.dim = dim
        self.words, self.codes = pa.array([], pa.string()), np.empty(0, np.int64)

    def of(self, words: pa.Array) -> np.ndarray:
        """-1 for words of one letter, which do not count."""
        at = pc.index_in(words, value_set=self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        codes = np.full(len(words), -1, np.int64)
        codes[known] = self.codes[at.drop_null().to_numpy()]
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(~known & (lengths > 1))
        if len(new):
            found = words.take(pa.array(new))
            codes[new] = np.fromiter((_code(w, self.dim) for w in found.to_pylist()), np.int64, len(new))
            keep = lengths[new] <= KEPT_CHARS
            if len(self.words) + int(keep.sum()) > KEPT_WORDS:
                self.words, self.codes = self.words[:0], self.codes[:0]
            if int(keep.sum()) <= KEPT_WORDS:
                self.words = pa.concat_arrays([self.words, found.filter(pa.array(keep))])
                self.codes = np.concatenate([self.codes, codes[new[keep]]])
        return codes


# Every byte that is no letter a-z becomes a space, so no text grows or shrinks.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)


def _rows(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are counted at once: so many rows and bytes at most, or one text."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + FILL_BYTES, "right")) - 1
        to = min(max(to, at + 1), at + FILL_ROWS, len(offsets) - 1)
        yield at, to
        at = to


def _filled(texts: pa.Array, codes: _Codes) -> np.ndarray:
    """The unit vectors of lower-case texts, one row each: words of two letters a-z or more."""
    raw, offsets = batch_bytes(texts)
    parts = [np.empty((0, codes.dim), np.float32)]
    for at, to in _rows(raw, offsets):
        own = (offsets[at:to + 1] - offsets[at]).astype(np.int32)
        letters = _LETTERS[raw[offsets[at]:offsets[to]]]
        split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(to - at, pa.py_buffer(own), pa.py_buffer(letters)))
        words = split.values.dictionary_encode()
        code = codes.of(words.dictionary)[words.indices.to_numpy()]
        row = np.repeat(np.arange(to - at), np.diff(split.offsets.to_numpy()))
        counted = code >= 0
        parts.append(_counted(row[counted], code[counted], to - at, codes.dim))
    return np.concatenate(parts)


def _fill(codes: list[np.ndarray], dim: int) -> np.ndarray:
    """The unit vectors of many texts, one row each, from the codes of each."""
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    return _counted(row, np.concatenate([*codes, []]).astype(np.int64), len(codes), dim)


def _counted(row: np.ndarray, code: np.ndarray, rows: int, dim: int) -> np.ndarray:
    """The unit vectors of many texts, one row each, from one count over all their codes."""
    counts = np.bincount(row * (2 * dim) + code, minlength=2 * dim * rows).reshape(rows, dim, 2)
    vecs = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
    norms = np.sqrt((vecs * vecs).sum(axis=1))
    return (vecs / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)


def encode(text: Column, dim: int = DIM) -> Column:
    """K2: deterministic unit vector of a text (all zero for a text without words)."""

    codes = _Codes(dim)  # each task gets its own

    @F.arrow_udf("array<float>")
    def fill(lower: pa.Array) -> pa.Array:
        return _lists(_filled(lower, codes))

    return fill(F.lower(text))


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as one Arrow array of lists."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32), pa.array(rows.ravel()))


def encode_phrases(phrases: list[str], dim: int = DIM) -> np.ndarray:
    """K3: the same vectors for a handful of fixed phrases, at planning time."""
    return _filled(pa.array([p.lower() for p in phrases], pa.string()), _Codes(dim))


def normalize(vec: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(
        F.array(norm), lambda n: F.transform(vec, lambda x: F.when(n > 0, (x / n).cast("float")).otherwise(x))
    )[0]


def cosine(a: Column, b: Column) -> Column:
    """K4: dot product of two unit vectors."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v
    )


def max_similarity(vec: Column, seeds: np.ndarray, groups: list[int]) -> Column:
    """K5: per group, the largest dot product with a seed of the group, within [0, 1]."""
    matrix = np.asarray(seeds, dtype=np.float64).T
    starts = [groups.index(g) for g in sorted(set(groups))]

    @F.arrow_udf("array<double>")
    def score(vecs: pa.Array) -> pa.Array:
        rows = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), len(matrix))
        if len(vecs) == 0:
            return pa.array([], pa.list_(pa.float64()))
        best = np.clip(np.maximum.reduceat(rows @ matrix, starts, axis=1), 0.0, 1.0)
        return _lists(np.round(best, DECIMALS))

    return score(vec)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at unit length; rows that have it, and zero rows, stay bit for bit."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    other = (norms > 0) & (np.abs(norms - 1) > 1e-6)
    return rows / np.where(other, norms, 1.0)[:, None]


def ball(flat: Column, dim: Column) -> Column:
    """The mean of the unit vectors of a block and, last, the radius around it that holds them all."""

    @F.pandas_udf("array<double>")
    def around(flats: pd.Series, dims: pd.Series) -> pd.Series:
        out = []
        for v, d in zip(flats, dims):
            rows = _unit(np.asarray(v, dtype=np.float64).reshape(-1, int(d)))
            centre = rows.mean(axis=0)
            out.append(np.append(centre, np.sqrt(((rows - centre) ** 2).sum(axis=1).max())))
        return pd.Series(out, dtype=object)

    return around(flat, dim)


def index_blocks(clauses: DataFrame, *features: str, size: int = BLOCK) -> DataFrame:
    """The clauses of a document packed in order, at most ``size`` to a row.

    Blocks bound what one task holds at once, whatever the length of a document.
    """
    block = F.floor((F.col("clause_index") - 1) / size).cast("int")
    packed = clauses.groupBy("document_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("clause_index", *features, "vec"))).alias("rows")
    )
    return packed.select(
        "document_id", "block",
        F.transform("rows", lambda r: F.struct(r["clause_index"].alias("i"), *[r[f].alias(f) for f in features])).alias("rows"),
        F.flatten(F.transform("rows", lambda r: r["vec"])).alias("flat"),
        F.size(F.col("rows")[0]["vec"]).alias("dim"),
    )
