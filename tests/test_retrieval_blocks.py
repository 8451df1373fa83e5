"""Retrieval over documents of many blocks: equal to all clauses, with blocks left out, and popular documents."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pactlens.functions import vectors as V
from pactlens.operators import retrieve


def topical(spark, n, dim=16):
    """A document whose clauses lie in a few directions, one after the other, and questions near them."""
    rng = np.random.default_rng(4)
    topics = np.eye(dim)[:8]
    clauses = [("d", k + 1, [float(x) for x in topics[k * 8 // n] + 0.02 * rng.normal(size=dim)]) for k in range(n)]
    asked = [(f"q{k}", "d", [float(x) for x in topics[k % 8] + 0.05 * rng.normal(size=dim)], 1 + k % 5) for k in range(40)]
    return (
        spark.createDataFrame(clauses, "document_id string, clause_index int, vec array<float>"),
        spark.createDataFrame(asked, "query_id string, document_id string, vec array<float>, top_k int"),
    )


def all_clauses(clauses, queries):
    unit = lambda v: np.asarray(v, dtype=np.float64) / (np.linalg.norm(np.asarray(v, dtype=np.float64)) or 1.0)
    rows = [(r["document_id"], r["clause_index"], unit(r["vec"])) for r in clauses.collect()]
    want = {}
    for q in queries.collect():
        scored = sorted((-round(float(unit(q["vec"]) @ v), 9), i) for d, i, v in rows if d == q["document_id"])
        want[q["query_id"]] = [i for _, i in scored[:max(4 * q["top_k"], 15)]]
    return want


def found(queries, blocks):
    got = {}
    for r in retrieve.vector_candidates(queries, blocks).orderBy("query_id", "candidate_rank").collect():
        got.setdefault(r["query_id"], []).append(r["clause_index"])
    return got


def test_blocks_are_left_out(spark):
    clauses, queries = topical(spark, 3000)
    blocks = V.index_blocks(clauses, size=64)
    assert found(queries, blocks) == all_clauses(clauses, queries)
    asked = queries.select("query_id", "document_id", F.col("vec").alias("q"), "top_k").withColumns({"chunk": F.lit(0).cast("long"), "chunks": F.lit(1).cast("long")})
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    bounds = retrieve.block_bounds(asked, blocks).withColumn("place", place).cache()
    first = retrieve._meet(asked, bounds.where(F.col("place") <= retrieve.FIRST_BLOCKS).select("query_id", "document_id", "block"), blocks)
    met = retrieve.FIRST_BLOCKS * queries.count() + retrieve.blocks_to_meet(asked, first, bounds).count()
    assert blocks.count() == 47 and bounds.count() == 47 * 40 and met < 0.3 * 47 * 40, met
    bounds.unpersist()


def test_many_questions_about_one_document(spark, monkeypatch):
    rng = random.Random(8)
    vec = lambda: [rng.random() for _ in range(8)]
    clauses = spark.createDataFrame([(d, k + 1, vec()) for d in ("a", "b") for k in range(60)], "document_id string, clause_index int, vec array<float>")
    queries = spark.createDataFrame([(f"q{k}", "a" if k % 9 else "b", vec(), 1 + k % 6) for k in range(300)], "query_id string, document_id string, vec array<float>, top_k int")
    monkeypatch.setattr(retrieve, "CHUNK", 10)
    monkeypatch.setattr(retrieve, "SHARED", 3)
    want = all_clauses(clauses, queries)
    assert found(queries, V.index_blocks(clauses)) == want and found(queries, V.index_blocks(clauses, size=7)) == want
    assert found(queries.limit(0), V.index_blocks(clauses)) == {} and found(queries, V.index_blocks(clauses.limit(0))) == {}
