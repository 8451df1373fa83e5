"""Joins within documents: their rows, and what travels for them."""

import re

import pytest
from pyspark.sql import functions as F

from pactlens.functions.joins import within_documents
from pactlens.operators import ground, relate
from pactlens.plans import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """Without broadcasts, as over tables of size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_rows_of_a_document_meet_by_key(shuffled):
    left = shuffled.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"), ("a", None, "m")], "document_id string, src int, v string")
    right = shuffled.createDataFrame([("a", 1, "A1"), ("a", 2, "A2"), ("a", 2, "A2+"), ("b", 2, "B2"), (None, 1, "N"), ("a", None, "M")], "document_id string, i int, w string")
    found = within_documents(left, right, "src", "i")
    assert found.columns == ["document_id", "src", "v", "w"]
    want = left.join(right, (left["document_id"] == right["document_id"]) & (left["src"] == right["i"])).select(left["document_id"], "src", "v", "w")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 5


def test_texts_travel_once_as_clauses(shuffled):
    clauses = shuffled.createDataFrame(
        [("d", 1, "c1", "1. A", "text one, except as noted", "Payment", "High Attention", "p 1"), ("d", 2, "c2", "2. B", "text two", "Account", None, "p 2")],
        "document_id string, clause_index int, clause_id string, section_title string, text string, primary_category string, attention_level string, location string",
    ).withColumn("source_location", F.struct(F.lit(1).alias("page_number")))
    edges = shuffled.createDataFrame(
        [("d", 1, 2, 0, "EXCEPTS", 0.9, -1, 1)], "document_id string, src int, tgt int, ord int, type string, confidence double, tension int, rank int")
    found = relate.describe_edges(edges, clauses)
    assert set(dealt(found)) and all("," not in keys for keys in dealt(found))
    payload = ground.relationship_payloads(found, clauses)
    # Of each table one exchange by document, or one and its like for the other end; never one by the clause.
    assert all("," not in keys and "document" in keys for keys in dealt(payload))
    got = payload.select(F.from_json("payload", "trigger string, source_clause struct<clause_id:string,text:string>, target_clause struct<clause_id:string,attention_level:string>").alias("p")).select("p.*").collect()
    assert [(r["trigger"], r["source_clause"]["text"], r["target_clause"]["clause_id"], r["target_clause"]["attention_level"]) for r in got] == [
        ("except as", "text one, except as noted", "c2", "Informational")]


@pytest.mark.parametrize("name", ["d11_graph_edges", "d11_graph_nodes"])
def test_graphs_keep_no_texts(spark, monkeypatch, name):
    kept, stage = [], Q.stage
    monkeypatch.setattr(Q, "stage", lambda df: kept.append(df) or stage(df))
    assert Q.QUERIES[name](spark, FOLDER).count() > 0
    assert [df.columns for df in kept] == [["document_id", "relationship_id", "source_clause_id", "target_clause_id", "rank"]]
    assert "source_text" not in kept[0]._jdf.queryExecution().optimizedPlan().toString()
