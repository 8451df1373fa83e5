"""Exact duplicates of normalised texts by Patricia tries (operator 8).

Every partition first merges its own copies in a trie (so a group that holds a third of all
rows travels once per partition), then length and SHA-256 deal the distinct strings out, and
one trie per partition inserts the full byte strings; a terminal node keeps the smallest id
and the number of rows.  A trie that outgrows its budget spills its heaviest subtree to a
file of the task and goes through that file on its own afterwards.

Defined cases: null counts as empty text; null ids never own a group that has another id; a
row is kept if its id is the owner's (rows that repeat the smallest id are all kept); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import SPACE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRIE_BYTES = 128 << 20
STRINGS_SCHEMA = "length bigint, sha string, string binary, keep_id bigint, group_size bigint"


def normalized(text: Column) -> Column:
    """White-space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of the label ``a`` stand in ``b`` from ``at`` on."""
    if b.startswith(a, at):
        return len(a)
    low, high = 0, min(len(a), len(b) - at)
    while low < high:  # the first ``low`` bytes agree, more than ``high`` do not
        middle = (low + high + 1) // 2
        low, high = (middle, high) if b.startswith(a[:middle], at) else (low, middle - 1)
    return low


class PatriciaTrie:
    """Byte strings in a compressed radix trie; terminals hold (smallest id, rows, payload).

    A node is ``[label, children by first byte, terminal or None, spill file or None]``.
    """

    def __init__(self, budget: int):
        self.root, self.budget, self.held, self.spills = [b"", {}, None, None], budget, 0, []

    def insert(self, string: bytes, ident: int | None, rows: int, payload) -> None:
        node, at = self.root, 0
        while True:
            if node[3] is not None:
                pickle.dump((string, ident, rows, payload), node[3])
                return
            if at == len(string):
                self._meet(node, ident, rows, payload)
                return
            child = node[1].get(string[at])
            if child is None:
                node[1][string[at]] = [string[at:], {}, (ident, rows, payload), None]
                self.held += len(string) - at + 300
                return
            same = _shared(child[0], string, at)
            if same < len(child[0]):
                middle = [child[0][:same], {child[0][same]: child}, None, None]
                child[0] = child[0][same:]
                node[1][string[at]] = middle
                self.held += 300
                child = middle
            node, at = child, at + same

    def _meet(self, node: list, ident: int | None, rows: int, payload) -> None:
        if node[2] is None:
            node[2] = (ident, rows, payload)
        else:
            known = node[2]
            ids = [i for i in (known[0], ident) if i is not None]
            node[2] = (min(ids, default=None), known[1] + rows, known[2])

    def full(self) -> bool:
        return self.held > self.budget

    @staticmethod
    def walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, int | None, int, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            string = prefix + node[0]
            if node[2] is not None:
                yield string, *node[2]
            stack += [(child, string) for child in node[1].values()]

    def spill(self) -> bool:
        """Move the heaviest subtree below the first fork to a file; False if there is none."""

        def weight(node: list) -> int:
            total, stack = 0, [node]
            while stack:
                node = stack.pop()
                total += len(node[0]) + 300
                stack += node[1].values()
            return total

        node, prefix = self.root, b""
        while True:
            prefix += node[0]
            inner = [c for c in node[1].values() if c[3] is None]
            if not inner:
                return False
            heaviest = max(inner, key=weight)
            # Descend while nearly all lies in one subtree that forks further down.
            if heaviest[1] and weight(heaviest) > 0.9 * self.held and any(c[3] is None for c in heaviest[1].values()):
                node = heaviest
                continue
            break
        heavy = weight(heaviest)
        file = tempfile.TemporaryFile()
        for entry in self.walk(heaviest, prefix):
            pickle.dump(entry, file)
        # Subtrees of it that were spilled before go along, so that a string has one file.
        stack = [heaviest]
        while stack:
            inner = stack.pop()
            stack += inner[1].values()
            if inner[3] is not None:
                self.spills.remove(inner[3])
                for entry in self.read(inner[3]):
                    pickle.dump(entry, file)
        heaviest[1], heaviest[2], heaviest[3] = {}, None, file
        self.held -= heavy
        self.spills.append(file)
        return True

    @staticmethod
    def read(file) -> Iterator[tuple]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                file.close()
                return

    def entries(self) -> Iterator[tuple[bytes, int | None, int, object]]:
        """All strings with their terminals: those in memory, then each spilled subtree."""
        yield from self.walk(self.root, b"")
        spills, self.root = self.spills, [b"", {}, None, None]
        for file in spills:
            trie = PatriciaTrie(self.budget)
            for entry in self.read(file):
                trie.insert(*entry)
                if trie.full() and not trie.spill():
                    trie.budget *= 2
            yield from trie.entries()


def _batches(entries: Iterator, rows: int = 2000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("length", pa.int64()), ("sha", pa.string()), ("string", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    held, total = [], 0
    for string, ident, n, sha in entries:
        held.append((len(string), sha, string, ident, n))
        total += len(string)
        if len(held) >= rows or total >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _merge(flush: bool, keep_strings: bool, budget: int):
    """The trie of a partition.  ``flush``: hand a full trie on and start anew (a partial merge)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator:
            trie = PatriciaTrie(budget)
            for batch in batches:
                shas, strings, ids, rows = (batch.column(c) for c in range(1, 5))
                for sha, string, ident, n in zip(shas, strings, ids.to_pylist(), rows.to_pylist()):
                    trie.insert(string.as_py(), ident, n, sha.as_py())
                    if trie.full():
                        if flush:
                            yield from trie.entries()
                            trie = PatriciaTrie(budget)
                        elif not trie.spill():
                            trie.budget *= 2
            yield from trie.entries()

        if keep_strings:
            yield from _batches(merged())
        else:
            for batch in _batches(merged()):
                yield batch.set_column(2, "string", pa.nulls(batch.num_rows, pa.binary()))

    return run


def owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: length, sha, keep_id, group_size."""
    string = normalized(F.col(text_col))
    rows = docs.select(string.alias("s"), F.col(id_col).cast("bigint").alias("i")).select(
        F.octet_length("s").cast("bigint").alias("length"), F.sha2(F.col("s").cast("binary"), 256).alias("sha"),
        F.col("s").cast("binary").alias("string"), F.col("i").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
    )
    partial = rows.mapInArrow(_merge(True, True, budget), STRINGS_SCHEMA)
    dealt = partial.repartition("length", "sha")
    return dealt.mapInArrow(_merge(False, False, budget), STRINGS_SCHEMA).drop("string")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """Per row of ``docs``: its id, keep_id, group_size, kept and text_sha256."""
    string = normalized(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), string.alias("s")).select(
        "doc_id", F.octet_length("s").cast("bigint").alias("length"), F.sha2(F.col("s").cast("binary"), 256).alias("sha")
    )
    return rows.join(owners(docs, id_col=id_col, text_col=text_col, budget=budget), ["length", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
