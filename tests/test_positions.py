"""Places of clauses in a text, pages in one exchange, vectors of whole batches."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactlens.functions import positions, vectors
from pactlens.operators import pages
from pactlens.sources import documents as sources


def plain(text, probes, lengths):
    out, hint = [], 0
    for probe, length in zip(probes, lengths):
        at = text.find(probe, hint)
        at = at if at >= 0 else text.find(probe)
        start = at if at >= 0 else hint
        hint = start + length
        out.append((start, hint, at >= 0))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab日", max_size=60), st.lists(st.tuples(st.text("ab日\U0001F600", min_size=1, max_size=5), st.integers(0, 9)), max_size=12), st.integers(0, 2))
def test_spots_equal_single_searches(text, wanted, scans):
    probes, lengths = [p for p, _ in wanted], [n for _, n in wanted]
    assert positions.spots(text, probes, lengths, scans) == plain(text, probes, lengths)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=40), st.sets(st.text("ab", min_size=1, max_size=6), max_size=8))
def test_places_do_not_depend_on_pieces(text, probes):
    right = {p: [i for i in range(len(text)) if text.startswith(p, i)] for p in probes}
    assert positions.all_places(text, probes, piece=7) == positions.all_places(text, probes) == right


def test_ten_thousand_probes_that_are_nowhere_cost_one_pass():
    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(97, 123, 4_000_000)))
    probes = [text[k:k + 39] + "!" for k in range(0, 3_000_000, 300)] + [text[-50:-10]]
    start = time.perf_counter()
    found = positions.spots(text, probes, [10] * len(probes))
    assert time.perf_counter() - start < 30  # single searches would read 80 GB
    assert found[-1] == (len(text) - 50, len(text) - 40, True) and not any(f for _, _, f in found[:-1])


def test_paged_documents_take_one_scan_and_one_exchange(spark, tmp_path):
    rows = [("d", n, f"TOP\nline {n}\nEND") for n in range(1, 8)] + [("e", 1, "TOP\nx"), ("f", 1, None), ("f", 2, "y\nTOP"), ("f", 3, "")]
    given = spark.createDataFrame(rows, "document_id string, page_number int, text string").repartition(3)
    given.write.parquet(str(tmp_path / "pages"))
    docs = sources.from_pages(spark.read.parquet(str(tmp_path / "pages")))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1
    got = {r["document_id"]: (r["raw_text"], r["cleaned_text"]) for r in docs.collect()}
    assert got["d"] == ("\n".join(f"TOP\nline {n}\nEND" for n in range(1, 8)), "\n\n".join(f"line {n}" for n in range(1, 8)))
    assert got["e"][1] == "TOP\nx" and got["f"] == ("y\nTOP\n", "y\nTOP")


def test_running_lines_need_more_than_half_of_all_pages(spark):
    texts = [["A\nx", "A\ny"], ["A\nx", "B\ny"], ["A\nx", "A\nx", "B\nq", ""], ["A\n1\nZ", "A\n2\nZ", "B\n3\nZ"], ["A"], []]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, texts array<string>")
    got = [sorted(r[1]) for r in df.select("k", pages.running_lines(df["texts"])).orderBy("k").collect()]
    assert got == [["A"], [], [], ["A", "Z"], [], []]


def test_cut_pages_keep_their_other_columns(spark):
    df = spark.createDataFrame([("d", 2, "T\nb", 5.0), ("d", 1, "T\na", None)], "document_id string, page_number int, text string, extra double")
    out = pages.remove_running_lines(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [("d", 1, "a", None), ("d", 2, "b", 5.0)]


@pytest.mark.parametrize("sizes", [[], [0], [3, 0, 5], [1] * 3000])
def test_vectors_of_a_batch_equal_those_of_single_texts(sizes):
    rng = np.random.default_rng(7)
    codes = [rng.integers(0, 128, n) for n in sizes]
    batch = vectors._fill(codes, 64)
    assert batch.shape == (len(sizes), 64)
    for row, c in zip(batch, codes):
        counts = np.bincount(c, minlength=128)
        vec = (counts[0::2] - counts[1::2]).astype(float)
        norm = np.sqrt((vec * vec).sum())
        assert (row == (vec / norm if norm else vec).astype(np.float32)).all()
