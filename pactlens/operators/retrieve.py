"""Clause retrieval for a table of queries.

The index is the table of clause blocks (``vectors.index_blocks``).  A query meets blocks of
its own document only: first the two whose ball of vectors lets hope for most, then those
that could still hold a better clause than the last one wanted.  The queries that meet a
block are one matrix, so a block is multiplied once for up to some hundred of them, and only
the best few clauses of each leave it.  No row is made per (query, clause).
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.functions import vectors as V
from pactlens.functions.staging import stage

# Ship the numpy helpers with the task, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries of one document that meet a block as one matrix, about; chunks of them that share a copy of the block.
CHUNK, SHARED = 256, 16
#: Blocks that a query meets before any is left out.
FIRST_BLOCKS = 2


def query_tokens(query: Column) -> Column:
    """R2: the words of a query that are no stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(query), F.lit(T.java(r"\b[a-zA-Z]{2,}\b")), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(rules.STOP_WORDS))


def synonym_tokens(tokens: Column) -> Column:
    """Synonyms of the tokens, each once, without the tokens themselves."""
    pairs = [x for k, v in rules.SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
    table = F.create_map(*pairs)
    known = F.filter(tokens, lambda t: t.isin(list(rules.SYNONYMS)))
    return F.array_except(F.flatten(F.transform(known, lambda t: table[t])), tokens)


def lexical_boost(title: Column, text: Column, tokens: Column, synonyms: Column) -> Column:
    """Bonus for query words (or else synonyms) found in title and text."""
    def hits(where: Column, what: Column) -> Column:
        return F.size(F.filter(what, lambda t: where.contains(t)))

    def part(where: Column, direct: float, indirect: float) -> Column:
        d, s = hits(where, tokens), hits(where, synonyms)
        return F.when(d > 0, F.least(d, F.lit(2)) * direct).when(s > 0, F.least(s, F.lit(2)) * indirect).otherwise(0.0)

    lower_title, lower_text = F.lower(F.coalesce(title, F.lit(""))), F.lower(text)
    return F.least(part(lower_title, 0.08, 0.04) + part(lower_text, 0.04, 0.02), F.lit(0.15))


def check_queries(queries: DataFrame) -> DataFrame:
    """Adds ``reject_reason``, null for a valid search request."""
    return queries.withColumn(
        "reject_reason",
        F.when(F.length("query") < 2, "query too short")
        .when(~F.col("top_k").between(1, 50), "top_k out of range"),
    )


def missing_documents(queries: DataFrame, clauses: DataFrame) -> DataFrame:
    """The queries whose document has no indexed clause."""
    return queries.join(clauses.select("document_id").distinct(), "document_id", "left_anti")


def _candidate_count() -> Column:
    return F.greatest(F.col("top_k") * 4, F.lit(15))


def _best_of_block(queries: Column, wanted: Column, flat: Column, dim: Column) -> Column:
    """The best clauses of a block for each of the queries that meet it: (query, clause, score) by places, flattened."""

    @F.pandas_udf("array<double>")
    def best(vectors: pd.Series, counts: pd.Series, flats: pd.Series, dims: pd.Series) -> pd.Series:
        out = []
        for q, k, v, d in zip(vectors, counts, flats, dims):
            matrix = lambda x: V._unit(np.asarray(x, dtype=np.float64).reshape(-1, int(d)))
            scores = np.round(matrix(np.concatenate(list(q))) @ matrix(v).T, V.DECIMALS)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :int(max(k))]
            rows = np.repeat(np.arange(len(order)), order.shape[1])
            stay = np.tile(np.arange(order.shape[1]), len(order)) < np.repeat(np.asarray(k), order.shape[1])
            rows, columns = rows[stay], order.ravel()[stay]
            out.append(np.column_stack([rows, columns, scores[rows, columns]]).ravel())
        return pd.Series(out, dtype=object)

    return best.asNondeterministic()(queries, wanted, flat, dim)


def _meet(queries: DataFrame, meetings: DataFrame | None, blocks: DataFrame) -> DataFrame:
    """(query_id, document_id, top_k, base_score, clause_index): the best clauses of the blocks that each query meets.

    ``queries`` with ``chunk`` and ``chunks``; ``meetings(query_id, document_id, block)``, or ``None`` for
    all blocks of the document.
    """
    met = queries.withColumn("copy", F.floor(F.col("chunk") / SHARED).cast("int"))
    keys = ["document_id", "copy", "chunk"]
    if meetings is not None:
        met = met.join(meetings, ["query_id", "document_id"])
        keys.append("block")
    groups = met.groupBy(*keys).agg(F.collect_list(F.struct("query_id", "top_k", "q", _candidate_count().cast("int").alias("k"))).alias("asked"))
    copies = queries.groupBy("document_id").agg(F.max("chunks").alias("chunks"))
    stored = blocks.join(copies, "document_id").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("chunks") - 1) / SHARED).cast("int")))
    ).select("document_id", "copy", "block", "rows", "flat", "dim")
    on = ["document_id", "copy"] + (["block"] if meetings is not None else [])
    scored = groups.join(stored, on).select(
        "document_id", "asked", "rows", _best_of_block(F.col("asked.q"), F.col("asked.k"), F.col("flat"), F.col("dim")).alias("found")
    )
    hits = scored.select("document_id", F.explode(F.expr("""
        transform(if(size(found) > 0, sequence(0, size(found) div 3 - 1), array()), n -> struct(
            asked[int(found[3 * n])] AS asked, rows[int(found[3 * n + 1])].i AS clause_index, found[3 * n + 2] AS base_score))""")).alias("hit"))
    return hits.select("hit.asked.query_id", "document_id", "hit.asked.top_k", "hit.base_score", "hit.clause_index")


def block_bounds(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, document_id, block, bound): what no clause of a block can exceed, for every query and block of its document."""
    balls = blocks.select("document_id", "block", V.ball(F.col("flat"), F.col("dim")).alias("ball"))

    @F.pandas_udf("double")
    def bound(vectors: pd.Series, holding: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=float)
        q = [V._unit(np.asarray(v, dtype=np.float64)[None])[0] for v in vectors]
        return pd.Series([v @ b[:-1] + np.linalg.norm(v) * b[-1] + 1e-8 for v, b in zip(q, holding)])

    return queries.select("query_id", "document_id", "q").join(balls, "document_id").select(
        "query_id", "document_id", "block", bound("q", "ball").alias("bound")
    )


def blocks_to_meet(queries: DataFrame, first: DataFrame, bounds: DataFrame) -> DataFrame:
    """The blocks that, by their bounds, could hold a clause that belongs to the best ones and has not been met."""
    order = Window.partitionBy("query_id").orderBy(F.desc("base_score"), "clause_index")
    last = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == _candidate_count()).select("query_id", F.col("base_score").alias("last"))
    rest = bounds.where(F.col("place") > FIRST_BLOCKS).join(last, "query_id", "left")
    return rest.where(F.col("last").isNull() | (F.col("bound") >= F.col("last"))).select("query_id", "document_id", "block")


def vector_candidates(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The best ``max(4 k, 15)`` clauses of its document for every query.

    ``queries(query_id, document_id, vec, top_k)``; ``blocks`` from ``index_blocks``.
    """
    asked = queries.select("query_id", "document_id", F.col("vec").alias("q"), "top_k")
    counts = asked.groupBy("document_id").agg((F.floor((F.count("*") - 1) / CHUNK) + 1).alias("chunks"))
    asked = asked.join(counts, "document_id").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")))
    blocks = stage(blocks.select("document_id", "block", "rows", "flat", "dim").join(counts.select("document_id"), "document_id", "left_semi"))
    order = Window.partitionBy("query_id").orderBy(F.desc("base_score"), "clause_index")
    if blocks.where("block > 0").isEmpty():
        rows = _meet(asked, None, blocks)
    else:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
        bounds = stage(block_bounds(asked, blocks).withColumn("place", place))
        first = stage(_meet(asked, bounds.where(F.col("place") <= FIRST_BLOCKS).select("query_id", "document_id", "block"), blocks))
        rows = first.unionByName(_meet(asked, blocks_to_meet(asked, first, bounds), blocks))
    # Where all queries ask for the same number, it is a constant again here, so that Spark cuts ahead of the exchange.
    rows = rows.drop("top_k").join(queries.select("query_id", "document_id", "top_k"), ["query_id", "document_id"])
    return rows.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= _candidate_count())


def search(queries: DataFrame, clauses: DataFrame, threshold: float = rules.RETRIEVAL_THRESHOLD) -> DataFrame:
    """Ranked hits.

    ``queries(query_id, document_id, query, vec[, top_k][, categories][, threshold])``,
    ``clauses`` with the category columns and ``vec``.
    """
    defaults = {"top_k": F.lit(rules.RETRIEVAL_TOP_K), "categories": F.lit(None).cast("array<string>"), "threshold": F.lit(threshold)}
    queries = queries.withColumns({k: v for k, v in defaults.items() if k not in queries.columns})
    candidates = vector_candidates(queries, V.index_blocks(clauses))
    return rerank(candidates, queries, clauses)


def rerank(candidates: DataFrame, queries: DataFrame, clauses: DataFrame) -> DataFrame:
    """Category filter after the candidate cut, lexical bonus, final top k; a clause without title is ``General``."""
    tokens = query_tokens(F.col("query"))
    asked = queries.select("query_id", "query", "categories", "threshold", tokens.alias("tokens"))
    asked = asked.withColumn("synonyms", synonym_tokens(F.col("tokens")))
    rows = candidates.join(asked, "query_id").join(clauses.drop("vec"), ["document_id", "clause_index"])
    wanted = F.coalesce(F.size("categories"), F.lit(0)) <= 0
    rows = rows.where(
        wanted | F.array_contains("categories", F.col("primary_category"))
        | F.arrays_overlap("categories", "secondary_categories")
    )
    boost = lexical_boost(F.col("section_title"), F.col("text"), F.col("tokens"), F.col("synonyms"))
    rows = rows.withColumn("similarity_score", T.shown(F.least(F.lit(1.0), F.col("base_score") + boost), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity_score"), "candidate_rank")
    return (
        rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k"))
        .withColumn("meets_threshold", F.col("similarity_score") >= F.col("threshold"))
        .withColumn("section_title", F.coalesce("section_title", F.lit(rules.GENERAL)))
        .drop("tokens", "synonyms", "categories", "query")
    )


def query_results(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query, whether any hit meets the threshold and how many hits there are."""
    found = hits.groupBy("query_id").agg(
        F.bool_or("meets_threshold").alias("sufficient_evidence"), F.count("*").alias("total_matches")
    )
    return queries.join(found, "query_id", "left").withColumns({
        "sufficient_evidence": F.coalesce("sufficient_evidence", F.lit(False)),
        "total_matches": F.coalesce("total_matches", F.lit(0)),
    })
