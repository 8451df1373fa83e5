"""Token ids in compressed binary shards (operator 1).

Method: static range asymmetric numeral system (``rans``).  Documents are dealt out by
ranges of their id and sorted, so one pass over a partition makes its shards: it tokenizes
text after text and closes a shard at the end of the document that fills it.  A shard holds
the tokens of whole documents and one shared frequency table, so a task holds one shard and
nothing else.  Shards are rows of a Parquet table (uncompressed: the payload is dense), which
Spark writes and commits on any file system.

Defined cases: a null or empty text has only the end id; a null id sorts first; rows that
repeat an id follow each other, ordered by a hash of their text; an empty table gives no
shards; other columns are not read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.llm.byte_level import ByteLevelEncoder
from pactlens.llm.common import bound_batches, give_back, worker_cache
from pactlens.llm.rans import decode_shard, encode_shard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_SCHEMA = "part int, shard int, part_start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary"
#: Tokens at which a shard is closed: about 5 MB of payload, 12 MB of ids, some 60 MB while it is encoded.
SHARD_TOKENS = 3_000_000
#: What the names of the cached encoders of a worker begin with.
ENCODERS = "byte_level:"


def encoder_for(vocabulary: str) -> ByteLevelEncoder:
    """The encoder of a vocabulary of ``public_tokenizers`` (or of a path), once per worker."""

    def make() -> ByteLevelEncoder:
        if "/" in vocabulary:
            return ByteLevelEncoder(vocabulary)
        import public_tokenizers

        return ByteLevelEncoder(public_tokenizers.path(vocabulary))

    return worker_cache(ENCODERS + vocabulary, make)


def write_token_shards(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every whole text, append ``end_id``, and write the shards in ascending id order."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_for(vocabulary), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        ids, lengths, texts, held, shard, before = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            raw = b"".join(texts)
            texts.clear()
            row = {
                "part": [part], "shard": [shard], "part_start": [before], "n_tokens": [held], "doc_ids": [ids],
                "doc_tokens": [lengths], "payload": [encode_shard(np.frombuffer(raw, "<u4"))],
            }
            kinds = {"part": pa.int32(), "shard": pa.int32(), "part_start": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "doc_tokens": pa.list_(pa.int64()), "payload": pa.binary()}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema(list(kinds.items())))

        for batch in give_back(batches, ENCODERS):
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.append(encoder.encode(text.as_py() or "") + end)
                ids.append(ident)
                lengths.append(len(texts[-1]) // 4)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield closed()
                    ids, lengths, texts, shard, before, held = [], [], [], shard + 1, before + held, 0
        if ids:
            yield closed()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    dealt = rows.repartitionByRange("i", "h").sortWithinPartitions("i", "h").select("i", "t")
    dealt.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_shards(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Decode the shards: doc_id, start, n_tokens, ids_crc32 of each document (and its ids).

    Only one row per written part meets in one task, to give each part its first position.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = shards.join(F.broadcast(firsts), "part").select(  # two numbers per written part
        (F.col("first") + F.col("part_start")).alias("start"), "doc_ids", "doc_tokens", "payload"
    )
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches, ENCODERS):
            for k in range(batch.num_rows):
                start, doc_ids, lengths, payload = (batch.column(c)[k].as_py() for c in range(4))
                ids = decode_shard(payload)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(np.asarray(lengths, np.int64))
                if int(ends[-1]) != len(ids):
                    raise ValueError("a shard's documents do not add up to its tokens")
                firsts = ends - np.asarray(lengths, np.int64)
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(firsts.tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + firsts), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(firsts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(documents, schema)
