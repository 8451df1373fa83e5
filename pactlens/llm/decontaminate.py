"""Benchmark passages in documents by Wu-Manber search (operator 3).

Texts become word strings: A-Z in lower case, one space before each word and one at the end.
Patterns are the windows of the benchmark items in the same form.  Patterns are put in
classes of similar length; the search of a class looks only at the first ``m`` bytes of its
patterns (``m``: its shortest).  The shift table, over hashes of blocks of bytes, says how far
the search may move; shift 0 leads to the bucket of patterns whose prefix ends with such a
block, and those are compared byte by byte.  A batch of texts is one long string that is cut
into lanes, and all lanes move together in numpy.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text and ``BLOCK_WINDOWS``
windows (one block for usual sizes; a larger item is a block of its own); each block is one
more pass over the texts, so any number of items is searched whole and no task or driver holds
more than one block.  All passes but the last write only what they hit, one narrow row per
different text (its SHA-256, word ranges, items); the last one gets these rows by a join, a
broadcast while they are counted small, and adds its own.

Defined cases: a null or wordless document has no words and no hits; a null or wordless item
has no windows; an item with a null id hits words but is not listed; repeated rows count as
they stand; an empty benchmark leaves every document clean; other columns pass through.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import bound_batches, forget, fresh, give_back, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
BLOCK_BYTES, BLOCK_WINDOWS = 16 << 20, 1 << 18
BUCKETS_PER_BLOCK = 64
LANES, CHUNK_BYTES = 8192, 8 << 20
BROADCAST_BYTES, SALTS = 16 << 20, 16
HITS = "n_words bigint, hits array<bigint>, items array<string>"


def _letters() -> np.ndarray:
    """Byte to word byte (A-Z in lower case), all separators to the space."""
    to = np.full(256, 0x20, np.uint8)
    for a, b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        to[a:b + 1] = np.arange(a, b + 1)
    to[0x41:0x5B] = np.arange(0x61, 0x7B)
    return to


def word_string(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word string of all texts, the place of the space before each word, words by text."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    low = _letters()[raw]
    word = low != 0x20
    after = np.zeros_like(word)
    after[1:] = word[:-1]
    first = np.flatnonzero(word & ~after)
    string = np.concatenate([np.full(9, 0x20, np.uint8), low[word | after]])  # room for a whole block in front
    spaces = np.flatnonzero(string[8:] == 0x20)[:-1] + 8
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(first, ends), prepend=0)
    return string, spaces, words


class WuManber:
    """The patterns of one class: all at least ``m`` bytes long, compared whole."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.bits = min(22, max(12, int(len(patterns) * self.m).bit_length() + 2))
        widest = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, widest, np.int32)
        self.buckets: dict[int, list[int]] = {}
        self.patterns = patterns
        prefix = np.frombuffer(b"".join(b"\0" * 8 + p[:self.m] for p in patterns), np.uint8).reshape(len(patterns), 8 + self.m)
        for end in range(self.block, self.m + 1):
            codes = self.code(np.ascontiguousarray(prefix[:, end:end + 8]).view("<u8").reshape(-1))
            np.minimum.at(self.shift, codes, self.m - end)
            if end == self.m:
                for k, c in enumerate(codes.tolist()):
                    self.buckets.setdefault(c, []).append(k)

    def code(self, last: np.ndarray) -> np.ndarray:
        """The hash of the last ``block`` of eight bytes."""
        return (((last >> np.uint64(8 * (8 - self.block))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, string: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence."""
        n = len(string)
        if n < self.m + 8:
            return
        eight = np.ndarray((n - 7,), "<u8", string, strides=(1,))
        lane = max(self.m, -(-(n - self.m - 7) // LANES))
        at = np.arange(self.m + 8, n + 1, lane)  # just behind the prefix that is tried
        stop = np.minimum(at + lane, n + 1)
        found = []
        while len(at):
            codes = self.code(eight[at - 8])
            move = self.shift[codes]
            hit = move == 0
            if hit.any():
                found.append((at[hit] - self.m, codes[hit]))
            at = at + np.maximum(move, 1)
            more = at < stop
            if not more.all():
                at, stop = at[more], stop[more]
        data = string.tobytes()
        for starts, codes in found:
            for start, code in zip(starts.tolist(), codes.tolist()):
                for k in self.buckets.get(code, ()):
                    if data.startswith(self.patterns[k], start):
                        yield start, k


class Benchmark:
    """The windows of a block of items, in classes by powers of two of their length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        owners: dict[bytes, set] = {}
        self.words: dict[bytes, int] = {}
        for ident, text in items:
            words = word_string([(text or "").encode()])[0].tobytes().split()
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k:k + window]
                pattern = b" " + b" ".join(part) + b" "
                owners.setdefault(pattern, set()).add(ident)
                self.words[pattern] = len(part)
        self.owners = owners
        classes: dict[int, list[bytes]] = {}
        for p in sorted(owners):
            classes.setdefault(len(p).bit_length(), []).append(p)
        self.classes = [WuManber(c) for c in classes.values()]

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[int], set]]:
        """Per text: words, merged hit ranges (first word, behind the last, ...), item ids."""
        string, spaces, words = word_string(texts)
        behind = np.cumsum(words)
        out = [(int(n), [], set()) for n in words]
        ranges: dict[int, list] = {}
        for search in self.classes:
            for start, k in search.search(string):
                pattern = search.patterns[k]
                first = int(np.searchsorted(spaces, start))
                doc = int(np.searchsorted(behind, first, "right"))
                last = first + self.words[pattern]
                if last > behind[doc]:
                    continue  # runs on into the next text
                base = int(behind[doc] - words[doc])
                ranges.setdefault(doc, []).append((first - base, last - base))
                out[doc][2].update(self.owners[pattern])
        for doc, hits in ranges.items():
            out[doc][1].extend(merged(hits))
        return out


def merged(hits: list[tuple[int, int]]) -> list[int]:
    """The union of word ranges, flat and in order."""
    flat: list[int] = []
    for a, b in sorted(hits):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _pass(benchmark: Benchmark):
    """Adds the hits of one block of the benchmark to those of the blocks before."""

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, known, items in give_back(batches):
            rows = []
            held, size, start = [], 0, 0
            for k, text in enumerate(texts):
                held.append((text or "").encode())
                size += len(held[-1])
                if size >= CHUNK_BYTES or k == len(texts) - 1:
                    for j, (n, ranges, ids) in enumerate(benchmark.scan(held), start):
                        before = known.iloc[j]
                        if before is not None and len(before):
                            ranges = merged([*zip(ranges[::2], ranges[1::2]), *zip(before[::2], before[1::2])])
                        ids = {i for i in ids if i is not None}.union(() if items.iloc[j] is None else items.iloc[j])
                        rows.append((n, ranges, sorted(ids)))
                    held, size, start = [], 0, k + 1
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return hits


def _blocks(rows: DataFrame, window: int, block_bytes: int, block_windows: int) -> tuple[int, list[tuple[int, int]]]:
    """The number of hash buckets of items, and the ranges of buckets that make the blocks."""
    words = F.regexp_count("t", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    sized = rows.select("h", F.octet_length("t").cast("bigint").alias("b"), F.greatest(words - (window - 1), F.least(words, F.lit(1))).cast("bigint").alias("w"))
    whole = sized.agg(F.sum("b").alias("b"), F.sum("w").alias("w")).first()
    buckets = BUCKETS_PER_BLOCK * (1 + (whole["b"] or 0) // block_bytes + (whole["w"] or 0) // block_windows)
    sums = sized.groupBy(F.pmod("h", F.lit(buckets)).alias("k")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
    blocks: list[tuple[int, int]] = []
    held = (0, 0)
    for k, b, w in sorted(tuple(r) for r in sums.collect()):  # three numbers a bucket
        held = held[0] + b, held[1] + w
        if blocks and held[0] <= block_bytes and held[1] <= block_windows:
            blocks[-1] = blocks[-1][0], k
        else:
            blocks.append((k, k))
            held = b, w
    return buckets, blocks or [(0, 0)]


def with_hits(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with a last struct column: n_words, hits (flat word ranges), items (ids as text)."""
    bound_batches(docs.sparkSession)
    out = fresh(docs, "contamination")
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"), F.xxhash64(item_text_col, F.col(item_col).cast("string")).alias("h"))
    buckets, blocks = _blocks(rows, window, block_bytes, block_windows)
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<bigint>"), F.array().cast("array<string>")

    def scan(low: int, high: int):
        items = [(r["i"], r["t"]) for r in rows.where(F.pmod("h", F.lit(buckets)).between(low, high)).select("i", "t").collect()]
        return _pass(Benchmark(items, window))

    paths = []
    for block in blocks[:-1]:
        found = docs.select(F.sha2(text, 256).alias("k"), scan(*block)(text, *none).alias("c")).where(F.size("c.hits") > 0)
        paths.append(written(found.groupBy("k").agg(F.first("c").alias("c")))[1])
    if not paths:
        return docs.withColumn(out, scan(*blocks[-1])(F.col(text_col), *none))
    before, _ = written(spark.read.parquet(*paths).groupBy("k").agg(
        F.flatten(F.collect_list("c.hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("c.items"))).alias("items")
    ))
    forget(spark, *paths)
    known = _with_known(docs, F.sha2(text, 256), before, out)
    return known.withColumn(out, scan(*blocks[-1])(F.col(text_col), F.col(f"{out}.hits"), F.col(f"{out}.items")))


def _with_known(docs: DataFrame, digest: Column, before: DataFrame, out: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with a last column of the hits that earlier passes wrote for a text, null if none.

    Beyond ``most_bytes`` the rows of one text are dealt over ``SALTS`` keys, so its copies do not meet in one task.
    """
    size = before.agg(F.sum(96 + 16 * F.size("hits") + F.octet_length(F.array_join("items", "")) + 32 * F.size("items"))).first()[0] or 0
    held = before.select(F.struct("k", "hits", "items").alias(out))
    if size <= most_bytes:
        return docs.join(F.broadcast(held), digest == F.col(f"{out}.k"), "left")
    salted = before.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.struct("k", "hits", "items", "salt").alias(out))
    salt = F.pmod(F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]), F.lit(SALTS))
    return docs.join(salted, (digest == F.col(f"{out}.k")) & (salt == F.col(f"{out}.salt")), "left")


def n_hit(hits):
    """The number of words in flat ranges."""
    return F.aggregate(F.transform(hits, lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without a hit word, same columns."""
    found = with_hits(docs, benchmark, **how)
    return found.where(F.size(F.col(f"{found.columns[-1]}.hits")) == 0).select(*docs.columns)
