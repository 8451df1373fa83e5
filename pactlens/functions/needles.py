"""Which of many fixed strings occur in a text, from one pass over the bytes of an Arrow batch.

A substring test per string reads every text once for each string.  Here the four bytes at each
place are looked up in a small table that knows how the strings begin; only places that it lets
through are compared with the strings.  A text longer than a piece is read whole all the same.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T

# Ship the numpy helpers with the task, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 20  # places that are looked up at once
_FACTOR, _BITS = 0x9E3779B1, 16


def _windows(raw: np.ndarray) -> np.ndarray:
    """The four bytes from each place on as one number; ``raw`` has three bytes more than places."""
    n = len(raw) - 3
    out = raw[:n].astype(np.uint32)
    for k in range(1, 4):
        out |= raw[k:n + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _slots(windows: np.ndarray) -> np.ndarray:
    return (windows * np.uint32(_FACTOR)) >> np.uint32(32 - _BITS)


class Needles:
    """Strings with the bits that they set, 62 in a number; those of one or two bytes are looked for by themselves."""

    def __init__(self, groups: list[list[str]]):
        bits: dict[bytes, int] = {}
        for n, group in enumerate(groups):
            for needle in group:
                code = needle.encode()
                if not code:
                    raise ValueError("an empty string occurs everywhere")
                bits[code] = bits.get(code, 0) | 1 << n
        self.words = max(1, -(-len(groups) // 62))
        self.table = np.zeros(1 << _BITS, bool)
        self.needles = []
        mask = (1 << 62) - 1
        for code, bit in bits.items():
            start = int.from_bytes(code[:4], "little")
            if len(code) > 2:
                ends = [start] if len(code) > 3 else [start | k << 24 for k in range(256)]
                self.table[_slots(np.array(ends, np.uint32))] = True
            self.needles.append((code, [bit >> 62 * w & mask for w in range(self.words)]))

    def marks(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text (the bytes of ``raw`` between two offsets) the bits of the strings that occur in it."""
        found = np.zeros((len(offsets) - 1, self.words), np.int64)
        longest = max(len(code) for code, _ in self.needles)
        begin, end = int(offsets[0]), int(offsets[-1])
        for at in range(begin, end, PIECE):
            stop = min(at + PIECE, end)
            part = np.zeros(stop - at + longest + 3, np.uint8)
            held = raw[at:min(stop + longest, end)]
            part[:len(held)] = held
            windows = _windows(part[:stop - at + 3])
            places = np.flatnonzero(self.table[_slots(windows)])
            starts = windows[places]
            order = np.argsort(starts, kind="stable")
            places, starts = places[order], starts[order]
            for code, bits in self.needles:
                first = np.uint32(int.from_bytes(code[:4], "little"))
                if len(code) > 3:
                    here = places[np.searchsorted(starts, first, "left"):np.searchsorted(starts, first, "right")]
                elif len(code) == 3:
                    here = places[(starts & np.uint32(0xFFFFFF)) == first]
                else:
                    here = np.flatnonzero(part[:stop - at] == code[0])
                for k in range(1 if len(code) < 3 else 4, len(code)):
                    if not len(here):
                        break
                    here = here[part[here + k] == code[k]]
                if not len(here):
                    continue
                row = np.searchsorted(offsets, here + at, "right") - 1
                row = row[here + at + len(code) <= offsets[row + 1]]
                for w, bit in enumerate(bits):
                    if bit:
                        found[row, w] |= bit
        return found


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and the offsets of its texts in them; null is empty."""
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int32)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    return np.frombuffer(texts.buffers()[2], np.uint8), offsets


def occurring(lower: Column, groups: list[list[str]]) -> Column:
    """Bits of the groups of which a string occurs in the text: bit ``n % 62`` of number ``n // 62``."""
    needles = Needles(groups)

    @F.arrow_udf("array<bigint>")
    def marked(texts: pa.Array) -> pa.Array:
        found = needles.marks(*batch_bytes(texts))
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, needles.words, dtype=np.int32), pa.array(found.ravel()))

    return marked(lower)


def occurs(marks: Column, group: int) -> Column:
    """Whether a string of the group occurs, from the numbers of ``occurring``."""
    return F.get(marks, F.lit(group // 62)).bitwiseAND(F.lit(1 << group % 62).cast("long")) != 0


def anchors(text: Column, patterns: list[str]) -> Column:
    """For ``may_match``: the patterns of which an anchor occurs in the text, or a letter that only folding makes ASCII."""
    return occurring(F.lower(text), [[*rules.ANCHORS[p], *T.FOLDED] if p in rules.ANCHORS else [] for p in patterns])


def may_match(marks: Column, patterns: list[str], pattern: str) -> Column | None:
    """Whether a text may hold the pattern, None if the pattern has no anchors."""
    return occurs(marks, patterns.index(pattern)) if rules.ANCHORS.get(pattern) else None
