"""Registered queries against their oracles at the smallest scale, and plan properties."""

import re

import pytest

import __spark_entry__ as entry
from check import compare, connect
from pactlens.operators import relate
from pactlens.plans import queries as Q

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["s2_paged_source", "s7_ingest", "s8_arrivals", "k9_classify", "r7_search", "x16_block_merge", "x27_rationale", "q17_verdict", "e7_threshold_sweep", "document_overview"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, con, name):
    verdict = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segmentation_shuffles_once(spark):
    from pactlens.operators import segment
    from pactlens.sources import documents as sources

    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("string(doc_id) document_id", "text raw_text")
    plan = plan_of(segment.segment(sources.from_texts(texts)))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_attention_and_classification_do_not_shuffle(spark):
    from pactlens.operators import attention, classify

    clauses = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("text")
    plan = plan_of(attention.assign_levels(classify.classify(clauses)))
    assert "Exchange" not in plan and "ReadSchema: struct<text:string>" in plan


def test_rankings_limit_groups_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan_of(Q._hits(spark, FOLDER))
    # Documents of one block are ranked where they are; those of several are cut ahead of the exchange.
    assert "Exchange" not in plan_of(Q._pairs(spark, FOLDER))
    assert "WindowGroupLimit" in plan_of(relate.candidate_pairs(Q._features(spark, FOLDER), block=6))


def test_result_does_not_depend_on_partitions(spark):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted(map(tuple, Q.QUERIES["x31_relationships"](spark, FOLDER).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert rows(1) == rows(13)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def odd_lines(tmp_path_factory):
    """The smallest tables, with blank lines, outer spaces, empty and null texts among the documents."""
    import duckdb

    folder = tmp_path_factory.mktemp("odd_lines")
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE WHEN doc_id = 5 THEN '' WHEN doc_id = 7 THEN NULL WHEN doc_id = 9 THEN chr(10)
        WHEN doc_id % 4 = 1 THEN replace(text, chr(10), chr(10) || chr(10)) WHEN doc_id % 4 = 2 THEN replace(text, chr(10), '  ' || chr(10) || ' ')
        ELSE text || chr(10) || '   ' END AS text) FROM '{FOLDER}/documents.parquet') TO '{folder}/documents.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["s2_paged_source", "s8_quarantine", "c4_clean_text", "g10_clause_ids", "g11_page_location", "t4_assign_levels"])
def test_queries_see_blank_lines_and_outer_spaces(spark, odd_lines, name):
    verdict = compare(spark, connect(odd_lines), odd_lines, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict
