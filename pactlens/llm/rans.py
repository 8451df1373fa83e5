"""Static range asymmetric numeral system for token ids, in numpy.

A shard is one byte string: a header, one frequency table that all of its blocks share, and
independent blocks.  A block interleaves ``LANES`` coder states that share one stream of
32-bit words; at every checkpoint it keeps the states and the place in the stream, so that
each segment between checkpoints is decoded on its own.  All blocks (encoding) and all
segments (decoding) of a shard advance together, one numpy step per row of symbols.
Every block and the table carry a CRC-32.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"RAN1"
HEADER = "<4sQIIIIIII"  # magic, tokens, symbols, bits, lanes, steps, segments, blocks, bytes of table
LANES, STEPS, SEGMENTS = 32, 1024, 4
LOWEST = np.uint64(1 << 31)


def quantised(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that add up to ``2 ** bits``, in proportion to ``counts``."""
    total = 1 << bits
    freq = np.maximum(1, (counts.astype(np.float64) * (total / counts.sum())).astype(np.int64))
    over = int(freq.sum()) - total
    if over < 0:
        freq[np.argmax(freq)] -= over
    while over > 0:
        # Take from the largest, but never more than a share that leaves them positive.
        order = np.argsort(-freq, kind="stable")
        take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // total))
        take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[order] -= take
        over -= int(take.sum())
    return freq


def encode_shard(ids: np.ndarray) -> bytes:
    """The shard of ``ids`` (any number, also none, of unsigned 32-bit integers)."""
    n = len(ids)
    if n == 0:
        return struct.pack(HEADER, MAGIC, 0, 0, 0, LANES, 0, 0, 0, 0)
    counts = np.bincount(ids) if int(ids.max()) < 1 << 22 else None
    if counts is not None:
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        rank_of = np.zeros(int(ids.max()) + 1, np.uint32)
        rank_of[symbols] = np.arange(len(symbols), dtype=np.uint32)
        rank = rank_of[ids]
    else:
        symbols, rank, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = min(24, max(14, int(len(symbols) - 1).bit_length() + 2))
    freq = quantised(counts, bits)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes() + freq.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes())

    steps = min(STEPS, -(-n // (LANES * SEGMENTS)) * SEGMENTS)
    block = steps * LANES
    blocks = -(-n // block)
    padded = np.full(blocks * block, np.argmax(freq), np.uint32)
    padded[:n] = rank
    del rank
    rows = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    del padded
    f64, c64 = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    up, top, word = np.uint64(bits), np.uint64(63 - bits), np.uint64(32)
    x = np.full((blocks, LANES), LOWEST, np.uint64)
    words = np.empty((steps, blocks, LANES), np.uint32)
    given = np.empty((steps, blocks, LANES), bool)
    states = np.empty((SEGMENTS, blocks, LANES), np.uint64)
    apart = steps // SEGMENTS
    for t in range(steps - 1, -1, -1):
        f = f64[rows[t]]
        out = x >= (f << top)
        words[t], given[t] = x.astype(np.uint32), out
        x >>= out * word
        q = x // f
        x = (q << up) + (x - q * f) + c64[rows[t]]
        if t % apart == 0:
            states[t // apart] = x
    del rows
    by_block = np.ascontiguousarray(given.transpose(1, 0, 2))
    stream = words.transpose(1, 0, 2)[by_block]
    del words, given
    per_segment = by_block.reshape(blocks, SEGMENTS, -1).sum(axis=2)
    starts = (np.cumsum(per_segment, axis=1) - per_segment).astype("<u4")
    ends = np.cumsum(per_segment.sum(axis=1))
    parts = [struct.pack(HEADER, MAGIC, n, len(symbols), bits, LANES, steps, SEGMENTS, blocks, len(table)), struct.pack("<I", zlib.crc32(table)), table]
    for b in range(blocks):
        body = starts[b].tobytes() + states[:, b, :].astype("<u8").tobytes() + stream[(ends[b - 1] if b else 0):ends[b]].astype("<u4").tobytes()
        parts += [struct.pack("<II", len(body), zlib.crc32(body)), body]
    return b"".join(parts)


def decode_shard(data: bytes) -> np.ndarray:
    """The ids of a shard; ``ValueError`` if a checksum or the format is wrong."""
    if len(data) < struct.calcsize(HEADER):
        raise ValueError("not a shard")
    magic, n, symbols_n, bits, lanes, steps, segments, blocks, table_n = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    if n == 0:
        return np.empty(0, np.uint32)
    at = struct.calcsize(HEADER) + 4
    table = data[at:at + table_n]
    if zlib.crc32(table) != struct.unpack_from("<I", data, struct.calcsize(HEADER))[0]:
        raise ValueError("checksum of the frequency table")
    planes = np.frombuffer(zlib.decompress(table), np.uint8).reshape(2, 4, symbols_n)
    gaps, freq = (np.ascontiguousarray(p.T).view("<u4").reshape(-1).astype(np.int64) for p in planes)
    symbols = np.cumsum(gaps).astype(np.uint32)
    at += table_n
    streams, starts, states, before = [], [], [], 0
    for b in range(blocks):
        size, crc = struct.unpack_from("<II", data, at)
        body = data[at + 8:at + 8 + size]
        if len(body) != size or zlib.crc32(body) != crc:
            raise ValueError(f"checksum of block {b}")
        at += 8 + size
        head = 4 * segments + 8 * segments * lanes
        starts.append(np.frombuffer(body, "<u4", segments).astype(np.int64) + before)
        states.append(np.frombuffer(body, "<u8", segments * lanes, 4 * segments).reshape(segments, lanes))
        streams.append(np.frombuffer(body, "<u4", offset=head))
        before += len(streams[-1])
    stream = np.concatenate([*streams, np.zeros(lanes, "<u4")]).astype(np.uint64)
    place = np.concatenate(starts)  # by block, then segment
    x = np.concatenate(states).astype(np.uint64)
    slot_freq = np.repeat(freq, freq).astype(np.uint64)
    slot_bias = (np.arange(1 << bits) - np.repeat(np.cumsum(freq) - freq, freq)).astype(np.uint64)
    slot_symbol = np.repeat(symbols, freq)
    up, low, word = np.uint64(bits), np.uint64((1 << bits) - 1), np.uint64(32)
    slots = np.empty((steps // segments, blocks * segments, lanes), np.uint32)
    for t in range(steps // segments):
        slot = x & low
        slots[t] = slot
        x = slot_freq[slot] * (x >> up) + slot_bias[slot]
        need = x < LOWEST
        nth = np.cumsum(need, axis=1)
        read = stream[place[:, None] + nth - need]
        x = np.where(need, (x << word) | read, x)
        place += nth[:, -1]
    return slot_symbol[slots.transpose(1, 0, 2).reshape(-1)][:n]
