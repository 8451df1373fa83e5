"""Pairs of long documents: equal to all pairs, with few blocks met; clauses with gaps."""

import random

import numpy as np
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import vectors as V
from pactlens.operators import pair_blocks, relate


def best_pairs(rows, per_clause, per_document, threshold=0.55):
    """All pairs, one clause against all later ones at a time."""
    bit, n = relate._BIT, len(rows)
    column = lambda f: np.array([r[f] for r in rows], dtype=np.int64)
    index, kw, flags = column("clause_index"), column("kw"), column("flags")
    vec = np.array([r["vec"] for r in rows], dtype=np.float64)
    names = [rules.GENERAL] + rules.CATEGORIES
    cat = np.array([names.index(r["primary_category"]) for r in rows])
    affine = np.array([[relate._affine(a, b) for b in names] for a in names])
    owner = {r["sec"]: k for k, r in enumerate(rows) if r["sec"]}
    crossed = np.zeros((n, n), dtype=np.int8)
    for k, r in enumerate(rows):
        for ref in r["refs"]:
            if ref in owner:
                crossed[min(k, owner[ref]), max(k, owner[ref])] += 1
    ranked = []
    for k in range(n):
        later = slice(k + 1, n)
        have = lambda name: flags[later] & bit[name] != 0
        own = lambda name: bool(flags[k] & bit[name])
        s = 0.40 * crossed[k, later]
        same = (cat[later] == cat[k]) & (cat[k] != 0)
        s = s + np.where(same, 0.35, np.where(affine[cat[k], cat[later]], 0.30, 0.0))
        shared = np.bitwise_count(kw[later] & kw[k])
        s = s + np.where(shared >= 2, 0.25, np.where(shared == 1, 0.15, 0.0))
        s = s + np.where(np.round(vec[later] @ vec[k], 9) >= threshold, 0.25, 0.0)
        for x, y in (("cancel", "renewal"), ("modify", "notify")):
            s = s + np.where((own(x) & have(y)) | (own(y) & have(x)), 0.40, 0.0)
        s = s + np.where(own("TEMPORAL") & have("TEMPORAL"), 0.35, 0.0)
        weight = np.where(s > 0, 0.30, 0.15)
        for name in ("EXCEPTS", "QUALIFIES"):
            s = s + np.where(own(name) | have(name), weight, 0.0)
        order = np.argsort(-s, kind="stable")[:per_clause]
        ranked += [(-s[m], int(index[k]), int(index[k + 1 + m])) for m in order if s[m] >= 0.25]
    return [(i, j, round(float(-s), 9)) for s, i, j in sorted(ranked)[:per_document]]


def long_document(spark, n):
    rng = random.Random(9)
    topics = [["refund", "billing", "payment"], ["data", "privacy", "retention"], ["notice", "changes", "terms"], ["court", "arbitration", "claims"]]
    triggers = ["except for", "solely", "will notify you", "cancel at any time", "Section 7", "Section 400", "within 30 days", "subject to"]
    rows = []
    for k in range(1, n + 1):
        topic = topics[k * 4 // (n + 1)] if rng.random() < 0.9 else rng.choice(topics)
        words = rng.choices(topic, k=2) + rng.choices(["plain", "words", "without", "signal", "at", "all"], k=4) + ([rng.choice(triggers)] if rng.random() < 0.15 else [])
        category = (rules.CATEGORIES + [rules.GENERAL])[topics.index(topic) * 2 + (rng.random() < 0.3)]
        rows.append(("d", k, f"{k}. T" if rng.random() < 0.2 else "T", " ".join(words), category))
    return spark.createDataFrame(rows, "document_id string, clause_index int, section_title string, text string, primary_category string")


def test_long_document_equals_all_pairs(spark):
    features = relate.clause_features(long_document(spark, 5000).withColumn("vec", V.encode(F.col("text")))).cache()
    rows = features.orderBy("clause_index").collect()
    for per_document in (500, None):
        got = relate.candidate_pairs(features, per_document=per_document).orderBy("candidate_rank").select("i", "j", F.round("score", 9)).collect()
        assert [tuple(r) for r in got] == best_pairs(rows, 10, per_document)
    few = features.where("clause_index % 7 = 1")
    got = relate.candidate_pairs(few, block=16).orderBy("candidate_rank").select("i", "j", F.round("score", 9)).collect()
    assert [tuple(r) for r in got] == best_pairs(rows[::7], 10, 500)
    features.unpersist()


def test_few_blocks_are_met(spark):
    features = relate.clause_features(long_document(spark, 5000).withColumn("vec", V.encode(F.col("text"))))
    _, blocks = pair_blocks.packed_blocks(features, 128)
    blocks = pair_blocks.with_owners(blocks)
    n = blocks.count()
    first = pair_blocks.first_pairs(blocks, relate._BIT, 0.55, 10)
    met = pair_blocks.blocks_to_meet(blocks, first, relate._BIT, 0.55, 10, 500).count()
    assert n == 40 and 2 * n - 1 + met < 0.5 * n * (n + 1) / 2, met


def test_blocks_of_clauses_with_gaps(spark):
    rows = [("a", k * 100, [1.0]) for k in range(1, 41)] + [("b", k, [1.0]) for k in range(1, 9)] + [("c", 5, [1.0]), ("c", 900, [1.0])]
    df = spark.createDataFrame(rows, "document_id string, clause_index int, vec array<float>")
    null = {f: F.lit(None).cast(t) for f, t in (("sec", "string"), ("section_title", "string"), ("refs", "array<string>"))}
    short, long = pair_blocks.packed_blocks(df.withColumns({**{f: F.lit(0) for f in ("cat", "friends", "kw", "flags")}, **null}), 8)
    assert sorted((r["document_id"], [x["i"] for x in r["rows"]], r["clauses"]) for r in short.collect()) == [("b", list(range(1, 9)), 8), ("c", [5, 900], 2)]
    got = {r["block"]: [x["i"] for x in r["rows"]] for r in long.collect()}
    assert got == {b: [k * 100 for k in range(8 * b + 1, 8 * b + 9)] for b in range(5)}


def test_neighbours_are_neighbours_in_the_document(spark):
    # Three unrelated clauses far apart: nothing overrides anything.
    texts = ["In the event of any conflict this shall prevail.", "Birds sing.", "Trees grow."]
    rows = [("d", f"c{k}", k, "T", t, "General", {"page_number": 1}) for k, t in zip((1, 300, 700), texts)]
    df = spark.createDataFrame(rows, "document_id string, clause_id string, clause_index int, section_title string, text string, primary_category string, source_location map<string,int>")
    assert relate.detect_relationships(df).count() == 0
    near = df.withColumn("clause_index", F.when(F.col("clause_index") == 300, 2).otherwise(F.col("clause_index")))
    assert [(r["source_clause_id"], r["target_clause_id"], r["relationship_type"]) for r in relate.detect_relationships(near).collect()] == [("c1", "c300", "OVERRIDES")]
