"""The document store and the arrival stream: repeated ids, repeated batches, rejects, layout."""

import re

import pytest
from pyspark.sql import functions as F

from pactlens.operators import segment
from pactlens.sources import documents as sources
from pactlens.sources.store import DocumentStore
from pactlens.streaming import arrivals

TEXT = "1. Scope\nThis text number {} is long enough to become a clause.\n2. Fees\nFee number {} is due each month."


def test_store_merges_batches(spark, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        store.list()
    batch = lambda *rows: spark.createDataFrame(rows, "document_id string, raw_text string")
    store.save(batch(("a", "a1"), ("b", "b1")), 1)
    store.save(batch(("b", "b2"), ("c", "c2"), ("c", "c2")), 2)
    store.save(batch(("b", "b2"), ("c", "c2")), 2)  # repeated
    state = lambda: {r["document_id"]: (r["raw_text"], r["version"]) for r in store.list().collect()}
    assert state() == {"a": ("a1", 1), "b": ("b2", 2), "c": ("c2", 2)}
    store.compact()
    store.save(batch(("a", "a3"), ("d", "d3")), 3)
    want = {"a": ("a3", 3), "b": ("b2", 2), "c": ("c2", 2), "d": ("d3", 3)}
    assert state() == want
    store.forget_before()
    assert state() == want and store._folders() and ("batch", 1) not in store._folders()
    assert [tuple(r) for r in store.get("b").collect()] == [("b", "b2", 2)] and store.get("none").count() == 0


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/store")
    store.save(spark.createDataFrame([("a", "a1")], "document_id string, raw_text string"), 1)
    store.save(spark.createDataFrame([("a", "a2")], "document_id string, raw_text string"), 2)
    (tmp_path / "store" / "batch=2" / "_SUCCESS").unlink()
    assert store.list().first()["raw_text"] == "a1"


def test_arrivals(spark, tmp_path):
    def land(n, *rows):
        spark.createDataFrame(rows, arrivals.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        arrivals.ingest_stream(arrivals.arriving_texts(spark, f"{tmp_path}/in/*", 100), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
        got = {}
        for r in arrivals.read_clauses(spark, f"{tmp_path}/out").orderBy("clause_index").collect():
            got.setdefault(r["document_id"], []).append((r["batch"], re.findall(r"umber (\d+)", r["text"])))
        return got

    text = lambda k: TEXT.format(k, k)
    # One id twice in one batch: the later row, whole; rejects aside.
    land(1, ("a", "t", text(1)), ("b", "t", text(2)), ("a", "t", text(3)), ("c", "t", "   "), ("d", "t", None), ("e", "t", "short"), (None, "t", text(4)))
    first = run()
    assert len(first) == 3 and first["a"] == [(0, ["3"]), (0, ["3"])] and first["b"][0] == (0, ["2"])
    # Across batches: a changed text is a new version, one that is known is not worked on again.
    land(2, ("a", "t", text(5)), ("b", "t", text(2)), ("c", "t", text(6)))
    second = run()
    assert second["a"] == [(1, ["5"]), (1, ["5"])] and second["b"][0][0] == 0 and second["c"][0] == (1, ["6"])
    rejects = {r["document_id"]: r["reject_reason"] for r in arrivals.read_rejects(spark, f"{tmp_path}/out").collect()}
    assert rejects == {"c": sources.NO_TEXT, "d": sources.NO_TEXT, "e": sources.TOO_SHORT}


def test_bucketed_texts_need_no_exchange(spark, tmp_path):
    texts = spark.createDataFrame([(f"d{k}", TEXT.format(k, k)) for k in range(40)], "document_id string, raw_text string")
    spark.sql("DROP TABLE IF EXISTS bucketed_texts")
    sources.write_bucketed(texts, "bucketed_texts", 4, path=f"{tmp_path}/table")
    try:
        found = segment.segment(sources.from_texts(spark.table("bucketed_texts")))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 80 and found.where(F.col("clause_index") == 2).count() == 40
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_texts")


def test_arriving_texts_do_not_pass_through_python(spark, tmp_path):
    rows = [("a", "t", TEXT.format(1, 1)), ("a", None, TEXT.format(2, 2)), ("b", "t", " "), ("c", "t", TEXT.format(3, 3))]
    batch = arrivals.checked(spark.createDataFrame(rows, arrivals.SCHEMA).withColumn("arrived_row", F.monotonically_increasing_id()))
    first = arrivals.versions(batch, None)
    known = first.select("document_id", "sha", "version").localCheckpoint()
    assert {(r["document_id"], r["title"], r["version"]) for r in first.collect()} == {("a", None, 1), ("c", "t", 1)}
    assert arrivals.versions(batch, known).count() == 0
    again = arrivals.versions(batch.where("title is not null"), known)
    assert [(r["document_id"], r["raw_text"], r["version"]) for r in again.collect()] == [("a", TEXT.format(1, 1), 2)]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_what_is_known_outlasts_many_batches_and_a_batch_that_is_run_again(spark, tmp_path):
    path = f"{tmp_path}/out"
    write = arrivals._write_batch(path)
    batch = lambda k: arrivals.checked(spark.createDataFrame([(f"d{k}", "t", TEXT.format(k, k)), ("a", "t", TEXT.format(0, 0))], arrivals.SCHEMA))
    whole, arrivals.WHOLE = arrivals.WHOLE, 2
    try:
        for k in (0, 1, 2, 2, 3, 4):
            write(batch(k), k)
        known = {r["document_id"]: r["version"] for r in arrivals._known(spark, path, 5).collect()}
        assert known == {"a": 1, **{f"d{k}": 1 for k in range(5)}}
        found = {(r["document_id"], r["batch"]) for r in arrivals.read_clauses(spark, path).collect()}
        assert found == {("a", 0), *[(f"d{k}", k) for k in range(5)]}
    finally:
        arrivals.WHOLE = whole


def test_a_batch_keeps_no_texts_besides_its_clauses(spark, tmp_path):
    rows = [(f"d{k}", "t", TEXT.format(k, k)) for k in range(20)]
    write = arrivals._write_batch(f"{tmp_path}/out")
    write(arrivals.checked(spark.createDataFrame(rows, arrivals.SCHEMA)), 0)
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/kept")
    write(arrivals.checked(spark.createDataFrame([("d3", "t", TEXT.format(70, 70)), *rows[4:]], arrivals.SCHEMA)), 1)
    assert not [p for p in (tmp_path / "kept").rglob("*") if p.is_file()]
    known = {r["document_id"]: (r["version"], r["batch"]) for r in spark.read.parquet(f"{tmp_path}/out/known").where("batch = 1").collect()}
    assert known == {"d3": (2, 1)}
    shown = lambda rows: rows.select("document_id", "batch", F.md5("text").alias("digest"))
    found = arrivals.read_clauses(spark, f"{tmp_path}/out", shown)
    all_rows = arrivals.read_clauses(spark, f"{tmp_path}/out").select("document_id", "batch", F.md5("text").alias("digest"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, all_rows.collect())) and found.count() == 40
    # The digest is taken ahead of the join, so no text travels.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("md5")
