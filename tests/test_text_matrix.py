"""The sink for matrices: whole lines, several tasks, nothing left of a failed job."""

import os

import pytest
from pyspark.sql import functions as F

from pactlens.sources import text_matrix
from pactlens.sources.text_matrix import TextMatrix, matrix_line, write_matrix


def lines(path):
    return [line for f in sorted(os.listdir(path)) if f.startswith("part-") for line in open(f"{path}/{f}").read().splitlines()]


def test_cells_are_never_cut():
    assert matrix_line(["a", 5, None]) == "a".ljust(24) + "       5" + "        "
    assert matrix_line(["x" * 30, 123456789]) == "x" * 30 + " 123456789"


def test_matrix_is_written_whole_and_replaced(spark, tmp_path):
    path = str(tmp_path / "matrix")
    rows = spark.createDataFrame([("b", 1), ("a", 10**9), (None, None)], "truth string, n long")
    for df in (rows.limit(1), rows):
        write_matrix(df, path)
    assert lines(path) == [matrix_line(c) for c in (["truth", "n"], [None, None], ["a", 10**9], ["b", 1])]
    assert not [f for f in os.listdir(path) if "staged" in f] and "_SUCCESS" in os.listdir(path)
    write_matrix(rows.limit(0), path)
    assert lines(path) == [matrix_line(["truth", "n"])]


def test_tasks_keep_their_order_and_append_adds(spark, tmp_path):
    spark.dataSource.register(TextMatrix)
    path = str(tmp_path / "many")
    df = spark.range(0, 100, 1, 5).select(F.format_string("r%03d", "id").alias("name"), "id")
    df.write.format("text_matrix").mode("append").save(path)
    assert lines(path) == [matrix_line(["name", "id"]), *(matrix_line([f"r{k:03d}", k]) for k in range(100))]
    df.write.format("text_matrix").mode("append").save(path)
    assert len(lines(path)) == 202


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "failed")
    write_matrix(spark.createDataFrame([("kept", 1)], "truth string, n long"), path)
    before = sorted(os.listdir(path)), lines(path)
    bad = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("truth"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("text_matrix").mode("overwrite").save(path)
    assert (sorted(os.listdir(path)), lines(path)) == before


def test_a_task_after_the_abort_leaves_nothing(monkeypatch, tmp_path):
    from types import SimpleNamespace

    from pyspark.sql.types import StructType

    path = str(tmp_path / "late")
    monkeypatch.setattr(text_matrix.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 7))
    writer = TextMatrix({"path": path}).writer(StructType().add("truth", "string"), True)
    writer.write(iter([("a",)]))
    writer.abort([None])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([("b",)]))
    assert os.listdir(path) == []
