"""Fixed strings, words and pairs of a whole batch at once give what they give one by one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import needles, text, vectors
from pactlens.operators import pair_blocks, relate

TEXTS = ["Fees are final", "fee", "fe", None, "", "cancel cancellation", "ends in not", "ice then", "dıspute i̇ upon", "a fee", "é 你 fees", "x" * 3000 + "upon"]


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_strings_that_occur_are_found_in_one_pass(monkeypatch, piece):
    monkeypatch.setattr(needles, "PIECE", piece)
    groups = [["fee"], ["cancel", "fees"], ["cancellation"], ["notice"], ["ı"], ["i̇"], ["upon"], ["a"], [], *[["x"]] * 60]
    for texts in (pa.array(TEXTS, pa.string()), pa.array(TEXTS, pa.string())[2:9], pa.array([], pa.string())):
        got = needles.Needles(groups).marks(*needles.batch_bytes(texts))
        want = [[sum(1 << n % 62 for n, g in enumerate(groups) if n // 62 == w and any(s in (t or "") for s in g)) for w in range(2)] for t in texts.to_pylist()]
        assert got.tolist() == want


def test_features_look_for_all_strings_in_one_call(spark):
    odd = "We may cancel at any time. Keep it lımited to what Sectıon 3 says, wıthout notice or liability"
    rows = spark.createDataFrame([("d", k, t, "1. A", None) for k, t in enumerate([odd, None, "", "As described in Section 2 and Section 2."])],
                                 "document_id string, clause_index int, text string, section_title string, primary_category string")
    found = relate.clause_features(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan  # no substring test per string
    for r in found.withColumn("plain", F.array(*[F.col("text").rlike("(?iUd)" + p) for p in relate._FLAG_PATTERNS.values()])).collect():
        assert r["flags"] == sum(1 << n for n, hit in enumerate(r["plain"]) if hit)
        assert r["kw"] == sum(1 << n for n, w in enumerate(rules.DOMAIN_KEYWORDS) if w in (r["text"] or "").lower())
    assert [r["refs"] for r in found.orderBy("clause_index").collect()][1:] == [[], [], ["2", "2"]]


def test_anchors_found_in_one_pass_hide_no_match(spark):
    patterns = list(rules.ANCHORS)
    words = sorted({a for anchors in rules.ANCHORS.values() for a in anchors}) + ["these terms", "your", "to", "the", "Section 3", "a"]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, 12)) for _ in range(200)]
    texts += [t.translate(str.maketrans({"s": "ſ", "k": "K", "i": "İ"})) for t in texts[:60]] + [t.upper() for t in texts[:60]] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("marks", needles.anchors(F.col("text"), patterns))
    hit = lambda p, may: F.coalesce(text.matches(F.col("text"), p, may=may), F.lit(False)).cast("int")
    lost = [F.sum(hit(p, None) - hit(p, needles.may_match(F.col("marks"), patterns, p))).alias(f"p{n}") for n, p in enumerate(patterns)]
    assert set(rows.agg(*lost).first()) == {0}


def test_words_of_a_batch_are_counted_as_those_of_single_texts(monkeypatch):
    texts = ["Aa bb-bb c", None, "", "éaa straße", "x" * 50 + " yy", "zz\x0bzz"] * 5
    texts = [t and t.lower() for t in texts]
    one = vectors._Codes(16)
    want = np.concatenate([vectors._filled(pa.array([t], pa.string()), one) for t in texts])
    monkeypatch.setattr(vectors, "KEPT_WORDS", 3)
    monkeypatch.setattr(vectors, "FILL_BYTES", 9)
    assert (vectors._filled(pa.array(texts, pa.string()), vectors._Codes(16)) == want).all()
    row = np.zeros(16)
    for w in ("aa", "bb", "bb"):
        code = vectors._code(w, 16)
        row[code // 2] += 1 - 2 * (code % 2)
    assert np.allclose(want[0], row / np.linalg.norm(row)) and not want[1].any()


def blocks(sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for n in sizes:
        pick = lambda high: rng.integers(0, high, n).tolist()
        refs = [(int(a), str(rng.integers(1, 6))) for a in rng.integers(0, max(n, 1), n // 2)] if n else []
        secs = [(k, str(rng.integers(1, 6))) for k in range(n) if rng.random() < 0.6]
        rows.append({
            "cat": pick(4), "friends": pick(16), "kw": pick(8), "flags": [int(f) & int(g) for f, g in zip(pick(1 << 13), pick(1 << 13))],
            "ref_no": [r for _, r in refs], "ref_at": [a for a, _ in refs], "sec_no": [s for _, s in secs], "sec_at": [a for a, _ in secs],
            "flat": rng.integers(-2, 3, 4 * n).astype(np.float32).tolist(), "dim": 4, "small": n <= 5,
        })
    kinds = {"cat": pa.int32(), "friends": pa.int32(), "kw": pa.int64(), "flags": pa.int32(), "ref_no": pa.string(), "ref_at": pa.int32(), "sec_no": pa.string(), "sec_at": pa.int32(), "flat": pa.float32()}
    return pa.array(rows, pa.struct([*[(f, pa.list_(t)) for f, t in kinds.items()], ("dim", pa.int32()), ("small", pa.bool_())]))


@pytest.mark.parametrize("per_document", [None, 7])
@pytest.mark.parametrize("pairs", [1, 40, 1 << 18])
def test_pairs_of_a_batch_equal_those_of_single_blocks(monkeypatch, pairs, per_document):
    monkeypatch.setattr(pair_blocks, "PAIRS", pairs)
    batch = blocks([3, 0, 12, 1, 5, 30, 2, 9])
    got = pair_blocks._found([pair_blocks._meet_within(p, 0.55, 4, relate._BIT, per_document) for p in pair_blocks._parts(batch)])
    for b, numbers in zip(pair_blocks._records(batch), got.to_pylist()):
        met = pair_blocks._meet(b, b, 0.55, 1 << 30, relate._BIT) if len(b["cat"]) else np.empty((0, 5))
        met = met[met[:, 1] < met[:, 2]]
        want = [r for n in range(len(b["cat"])) for r in met[met[:, 1] == n][:4].tolist()]
        if per_document:
            want = sorted(want)[:per_document]
        assert np.array(numbers).reshape(-1, 5).tolist() == want


def test_edges_are_not_drawn_by_interpreted_lambdas(spark):
    clauses = spark.createDataFrame([("d", 1, [1.0, 0.0], 1, 0, 3, 5, ["2"], "1", "1. A"), ("d", 2, [1.0, 0.0], 1, 0, 3, 6, [], "2", "2. B")],
                                    "document_id string, clause_index int, vec array<float>, cat int, friends int, kw long, flags int, refs array<string>, sec string, section_title string")
    edges = relate.pair_edges(relate.candidate_pairs(clauses))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(") <= 2 and "transform(array(" not in plan and "filter(" not in plan
    assert {(r["src"], r["tgt"], r["type"]) for r in edges.collect()} >= {(1, 2, "SUPPORTS")}
