import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.functions import vectors as V
from pactlens.operators import attention, classify, ground, metrics, relate, retrieve, summary


def frame(spark, texts, titles=None, categories=None, document="d"):
    rows = [
        (document, f"{document}_clause_{n:03d}", n, (titles or {}).get(n, "General"), t, (categories or {}).get(n, "General"))
        for n, t in enumerate(texts, 1)
    ]
    df = spark.createDataFrame(rows, "document_id string, clause_id string, clause_index int, section_title string, text string, primary_category string")
    return df.withColumn("source_location", F.lit("Pasted Text"))


def test_levels(spark):
    texts = [
        "Plans automatically renew and are non-refundable.", "All quarrels go to binding arbitration.",
        "The site comes as-is.", "Welcome to the site.", "Nous établissons l'as isé."]
    rows = attention.assign_levels(frame(spark, texts)).orderBy("clause_index").collect()
    assert [r["attention_level"] for r in rows] == [rules.HIGH, rules.MEDIUM, rules.LOW, rules.INFORMATIONAL, rules.INFORMATIONAL]
    assert rows[3]["attention_reasons"] == [rules.NO_INDICATOR_REASON] and len(rows[0]["attention_reasons"]) == 2


def test_anchors_never_hide_a_match(spark):
    """Every pattern finds the same with and without its anchors, odd letters included."""
    words = sorted({a for anchors in rules.ANCHORS.values() for a in anchors}) + [
        "these terms", "at any time", "without", "notice", "your", "account", "to", "the", "of", "shall", "Section 3", "a", "non-refundable"]
    random.seed(7)
    texts = [" ".join(random.choices(words, k=12)) for _ in range(400)]
    odd = str.maketrans({"s": "ſ", "k": "K", "i": "İ"})
    texts += [t.translate(odd) for t in texts[:100]] + [t.upper() for t in texts[:100]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("lower", T.folded(F.col("text")))
    checks = [
        F.sum((T.matches(F.col("text"), p) != T.matches(F.col("text"), p, F.col("lower"))).cast("int")).alias(f"p{n}")
        for n, p in enumerate(rules.ANCHORS)]
    assert set(df.agg(*checks).first()) == {0}


def test_every_alternative_has_an_anchor():
    """Short sentences that hit one alternative each are not lost."""
    samples = {
        rules.TEMPORAL: ["at least 5 days prior", "after account closure", "for a period of up to 9", "terminate account", "billing cycle"],
        rules.QUALIFIES: ["to the extent permitted by law", "provided, however, that", "subject to applicable law", "limited to"],
        rules.DEPENDS_ON: ["subject to section", "as set forth in", "pursuant to", "conditional upon", "only if"],
        rules.OVERRIDES: ["in case of conflict", "supersedes prior", "prevails over", "shall control over"],
    }
    for pattern, texts in samples.items():
        for t in texts:
            assert any(a in t for a in rules.ANCHORS[pattern]), t


def test_hybrid_classification(spark):
    texts = ["Refunds of the payment for a subscription fee", "the governing law and the courts decide each dispute", "blue sky"]
    rows = classify.classify(frame(spark, texts).drop("primary_category")).orderBy("clause_index").collect()
    assert [r["primary_category"] for r in rows] == ["Payment", "Dispute", "General"]


def test_hybrid_score(spark):
    df = spark.createDataFrame([(0.4, 0), (0.4, 1), (0.4, 2), (1.0, 3)], "s double, h int")
    got = [r[0] for r in df.select(classify.hybrid_score(F.col("s"), F.col("h"))).collect()]
    assert np.allclose(got, [0.4, 0.55 * 0.4 + 0.45 * 0.35, 0.55 * 0.4 + 0.45 * 0.7 + 0.08, 1.0])


def test_vectors(spark):
    df = spark.createDataFrame([("alpha beta alpha",), ("",)], "t string").select(V.encode(F.col("t")).alias("v"))
    a, b = [np.array(r["v"]) for r in df.collect()]
    assert abs(np.linalg.norm(a) - 1) < 1e-6 and not b.any() and np.allclose(a, V.encode_phrases(["Alpha beta ALPHA"])[0])
    scaled = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(V.normalize(F.col("v")))
    assert [list(np.round(r[0], 6)) for r in scaled.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_search_ranks_isolates_and_filters(spark):
    a = frame(spark, ["refund of the fee", "the law of courts", "shipping news"], {1: "1. Refunds"}, {1: "Payment", 2: "Dispute"}, "a")
    b = frame(spark, ["refund of the fee"], document="b")
    clauses = a.unionByName(b).withColumn("secondary_categories", F.array().cast("array<string>")).withColumn("vec", V.encode(F.col("text")))
    queries = spark.createDataFrame([("q", "a", "refund of the fee", 2)], "query_id string, document_id string, query string, top_k int").withColumn("vec", V.encode(F.col("query")))
    hits = retrieve.search(queries, clauses).orderBy("rank").collect()
    assert [h["document_id"] for h in hits] == ["a", "a"] and hits[0]["clause_id"] == "a_clause_001"
    assert hits[0]["similarity_score"] == 1.0 and hits[0]["meets_threshold"]
    only = retrieve.search(queries.withColumn("categories", F.array(F.lit("Dispute"))), clauses).collect()
    assert [h["clause_id"] for h in only] == ["a_clause_002"]
    lost = spark.createDataFrame([("z", "nowhere")], "query_id string, document_id string")
    assert retrieve.missing_documents(lost, clauses).count() == 1


def test_query_words(spark):
    df = spark.createDataFrame([("Can I get my money, money back for data?",)], "q string")
    tokens = df.select(retrieve.query_tokens(F.col("q")).alias("t")).withColumn("s", retrieve.synonym_tokens(F.col("t"))).first()
    assert tokens["t"] == ["get", "money", "money", "back", "data"]
    assert len(tokens["s"]) == len(set(tokens["s"])) and "refund" in tokens["s"] and "money" not in tokens["s"]


def test_relationship_rules(spark):
    """Every rule on a document of its own; all documents in one run."""
    cases = {}
    for text, name, confidence in [
        ("This section shall prevail.", "OVERRIDES", 0.85), ("All but gifts, except for plants.", "EXCEPTS", 0.80),
        ("It holds only if signed.", "DEPENDS_ON", 0.78), ("Solely for the purpose of tests.", "QUALIFIES", 0.72)]:
        cases[name] = ([text, "Plain words."], [(name, 1, 2, confidence)])
    cases["temporal keeps one direction"] = (["We retain data.", "The notice period is long."], [("TEMPORAL", 1, 2, 0.75)])
    cases["supports"] = (["See Section 2 please.", "Plain words."], [("SUPPORTS", 1, 2, 0.68)])
    cases["nothing"] = (["Plain words.", "More words."], [])
    for n, (first, second, confidence) in enumerate([
        ("You may cancel at any time.", "Plans automatically renew.", 0.76),
        ("We modify things without notice.", "We will notify users.", 0.82),
        ("We suspend or terminate all immediately, without notice", "There is an opportunity to cure.", 0.78),
        ("There are no refunds.", "You get a prorated refund.", 0.79)]):
        cases[f"tension {n}"] = ([first, second], [("POTENTIAL_TENSION", 1, 2, confidence)])
        cases[f"turned tension {n}"] = ([second, first], [("POTENTIAL_TENSION", 2, 1, confidence)])
    clauses = None
    for name, (texts, _) in cases.items():
        part = frame(spark, texts, {1: "1. One", 2: "2. Two"}, {1: "Payment", 2: "Payment"}, name)
        clauses = part if clauses is None else clauses.unionByName(part)
    got = {name: [] for name in cases}
    for r in relate.detect_relationships(clauses).orderBy("rank").collect():
        assert r["source_clause_id"].startswith(r["document_id"]) and r["target_clause_id"].startswith(r["document_id"])
        got[r["document_id"]].append((r["relationship_type"], int(r["source_clause_id"][-3:]), int(r["target_clause_id"][-3:]), r["confidence"]))
    for name, (_, expected) in cases.items():
        assert got[name] == expected, name


def test_pairs_equal_brute_force_for_any_block_size(spark):
    """The blocked ranking equals a plain loop over all pairs of a long document."""
    random.seed(3)
    parts = ["refund", "renew", "notice", "data", "privacy", "except for", "limited to", "will notify you", "cancel", "Section 3", "billing cycle", "words", "more", "of", "these"]
    texts = [" ".join(random.choices(parts, k=6)) for _ in range(60)]
    categories = {n: random.choice(rules.CATEGORIES + ["General"]) for n in range(1, 61)}
    titles = {n: f"{n}. T" for n in range(1, 61)}
    df = relate.clause_features(frame(spark, texts, titles, categories).withColumn("vec", V.encode(F.col("text"))))
    rows = df.orderBy("clause_index").collect()
    bit, owner = relate._BIT, {r["sec"]: r["clause_index"] for r in rows}
    ranked = []
    for a, b in itertools.combinations(rows, 2):
        either = lambda x, y: (a["flags"] & bit[x] and b["flags"] & bit[y]) or (b["flags"] & bit[x] and a["flags"] & bit[y])
        s = 0.0
        for r in a["refs"]:
            s += 0.40 if owner.get(r) == b["clause_index"] else 0
        for r in b["refs"]:
            s += 0.40 if owner.get(r) == a["clause_index"] else 0
        ca, cb = a["primary_category"], b["primary_category"]
        s += 0.35 if ca == cb != "General" else 0.30 if relate._affine(ca, cb) else 0
        shared = bin(a["kw"] & b["kw"]).count("1")
        s += 0.25 if shared >= 2 else 0.15 if shared else 0
        s += 0.25 if round(float(np.dot(np.float64(a["vec"]), np.float64(b["vec"]))), 9) >= 0.55 else 0
        s += 0.40 if either("cancel", "renewal") else 0
        s += 0.40 if either("modify", "notify") else 0
        s += 0.35 if a["flags"] & b["flags"] & bit["TEMPORAL"] else 0
        w = 0.30 if s > 0 else 0.15
        s += w if (a["flags"] | b["flags"]) & bit["EXCEPTS"] else 0
        s += w if (a["flags"] | b["flags"]) & bit["QUALIFIES"] else 0
        if s >= 0.25:
            ranked.append((a["clause_index"], b["clause_index"], s))
    kept = []
    for i in range(1, 61):
        kept += sorted((p for p in ranked if p[0] == i), key=lambda p: (-p[2], p[1]))[:10]
    kept.sort(key=lambda p: (-p[2], p[0], p[1]))
    for block in (256, 7):
        pairs = relate.candidate_pairs(df, block=block, per_document=100).orderBy("candidate_rank").collect()
        assert [(p["i"], p["j"], round(p["score"], 9)) for p in pairs] == [(i, j, round(s, 9)) for i, j, s in kept[:100]]
        # Numbers with gaps change nothing but the numbers.
        gapped = df.withColumn("clause_index", df["clause_index"] * 300)
        pairs = relate.candidate_pairs(gapped, block=block, per_document=100).orderBy("candidate_rank").collect()
        assert [(p["i"], p["j"], round(p["score"], 9)) for p in pairs] == [(i * 300, j * 300, round(s, 9)) for i, j, s in kept[:100]]


def test_candidates_of_vectors_of_any_length(spark):
    clauses = spark.createDataFrame([("d", 1, [3.0, 0.0]), ("d", 2, [0.0, 1.0])], "document_id string, clause_index int, vec array<float>")
    queries = spark.createDataFrame([("q", "d", [0.1, 0.2], 2)], "query_id string, document_id string, vec array<float>, top_k int")
    got = retrieve.vector_candidates(queries, V.index_blocks(clauses)).orderBy("candidate_rank").collect()
    assert [(r["clause_index"], round(r["base_score"], 4)) for r in got] == [(2, 0.8944), (1, 0.4472)]


def test_confusion_matrix_has_all_labels(spark):
    pairs = spark.createDataFrame([("A", "A"), ("A", "B")], "truth string, pred string")
    assert sorted(map(tuple, metrics.confusion_matrix(pairs, ["A", "B", "C"]).collect())) == [("A", 1, 1, 0), ("B", 0, 0, 0), ("C", 0, 0, 0)]


def test_grounding(spark):
    right = dict(clause="c1", title="1. Fees", place="offset 0-9", quote="\u201cA fee of ten dollars...\u201d", answer="You pay.")
    cases = [
        ({}, None), (dict(title="", place=""), None), (dict(quote="a fee, of ten dollars"), None),
        (dict(clause="c9"), "Unsupported clause ID"), (dict(title="2. Other"), "Section title mismatch"), (dict(place="Page 3"), "Location mismatch"),
        (dict(quote="a fee of two dollars"), "Fabricated or modified"), (dict(quote=" . "), "Empty quotation"),
        (dict(answer="It is clearly illegal."), "Forbidden legal conclusion")]
    rows = []
    for n, (change, _) in enumerate(cases):
        c = {**right, **change}
        rows.append((str(n), c["answer"], True, 0.9, [(c["clause"], c["title"], c["place"], c["quote"])], ""))
    src = "array<struct<clause_id:string,section_title:string,source_location:string,quoted_text:string>>"
    answers = spark.createDataFrame(rows, f"answer_id string, answer string, evidence_sufficient boolean, confidence double, sources {src}, uncertainty string")
    supplied = spark.createDataFrame(
        [(str(n), "c1", "1. Fees", "Offset 0-9", "You pay a fee of ten dollars each month.") for n in range(len(cases))],
        "answer_id string, clause_id string, section_title string, location string, text string")
    for got in ground.validate_answers(answers, supplied).collect():
        words = cases[int(got["answer_id"])][1]
        if words is None:
            assert got["is_valid"] and got["validation_errors"] == [] and got["confidence"] == 0.9
            assert got["sources"][0]["section_title"] == "1. Fees" and got["sources"][0]["source_location"].lower() == "offset 0-9"
        else:
            assert not got["is_valid"] and words in got["validation_errors"][0] and got["sources"] == [] and got["confidence"] == 0.0
            assert got["answer"] == rules.REJECTED_ANSWER and got["uncertainty"].startswith("Evidence validation failed with 1 error(s): ")
    quoted = spark.createDataFrame([("That is void. Next.",), ("Short. Then a longer sentence follows here for the quote to be cut.",)], "t string")
    assert [r[0] for r in quoted.select(ground.extractive_quote(F.col("t"))).collect()][0] == "That is void"


def test_classification_metrics(spark):
    pairs = spark.createDataFrame([("P", "P"), ("P", "A"), ("A", "A"), ("L", "L"), ("C", "C")], "truth string, pred string")
    assert metrics.classification_summary(pairs).first()["accuracy"] == 0.8
    p = {r["label"]: r for r in metrics.per_class(pairs).collect()}["P"]
    assert (p["precision"], p["recall"], round(p["f1"], 4)) == (1.0, 0.5, 0.6667)
    cm = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "C")], "truth string, pred string")
    assert [list(r)[1:] for r in metrics.confusion_matrix(cm, ["A", "B", "C"]).orderBy("truth").collect()] == [[1, 1, 0], [0, 1, 0], [0, 0, 1]]


def test_given_labels(spark):
    pairs = spark.createDataFrame([("P", "P"), ("P", "A"), ("A", "P"), ("L", "A"), (None, "P")], "truth string, pred string")
    rows = {r["label"]: r for r in metrics.per_class(pairs, ["A", "P", "Z", "P"]).collect()}
    counts = {k: (r["tp"], r["fp"], r["fn"], r["support"]) for k, r in rows.items()}
    assert counts == {"P": (1, 2, 1, 2), "A": (0, 2, 1, 1), "Z": (0, 0, 0, 0)}
    assert (rows["Z"]["precision"], rows["Z"]["f1"]) == (0.0, 0.0)
    got = metrics.classification_summary(pairs, ["P", "Z"]).first()
    assert (got["sample_size"], got["correct_predictions"], got["macro_recall"]) == (5, 1, 0.5)
    assert metrics.per_class(pairs.limit(0), ["A"]).first()["support"] == 0


def test_references_of_explanations_are_filled(spark):
    supplied = spark.createDataFrame(
        [("e1", "c1", None, "Offset 0-9", "Pay it now."), ("e2", "c1", "1. Fees", "Offset 0-9", "Pay it now.")],
        "answer_id string, clause_id string, section_title string, location string, text string",
    )
    ref = "struct<clause_id:string,source_location:string,quoted_text:string>"
    explained = spark.createDataFrame(
        [("e1", "s", "", "", ["k"], True, "", [("c1", None, "pay it"), ("c1", "", ""), ("c1", "offset 0-9", "now"), ("c1", "  ", "it")]),
         ("e2", "s", "", "", ["k"], True, "", [("c1", "", "pay it"), ("c9", "", "x")]), ("e3", "s", "", "", None, True, "", [])],
        f"answer_id string, summary string, attention_explanation string, relationship_explanation string, key_points array<string>, evidence_sufficient boolean, uncertainty string, evidence_references array<{ref}>",
    )
    rows = {r["answer_id"]: r for r in ground.validate_explanations(explained, supplied).collect()}
    assert [r["source_location"] for r in rows["e1"]["evidence_references"]] == ["Offset 0-9", "Offset 0-9", "offset 0-9", "  "]
    assert rows["e1"]["is_valid"] and [r["quoted_text"] for r in rows["e1"]["evidence_references"]] == ["pay it", "", "now", "it"]
    assert not rows["e2"]["is_valid"] and rows["e2"]["evidence_references"] == [] and "1 error(s)" in rows["e2"]["uncertainty"]
    assert rows["e3"]["is_valid"] and rows["e3"]["evidence_references"] == []


def test_retrieval_metrics(spark):
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "query_id string")
    relevant = spark.createDataFrame([("q1", "c1"), ("q2", "c2"), ("q3", "c3")], "query_id string, clause_id string")
    hits = spark.createDataFrame(
        [(q, c, n, 0.5) for q, ids in [("q1", "c1 c2 c3"), ("q2", "c1 c2 c3"), ("q3", "c4 c5 c6")] for n, c in enumerate(ids.split(), 1)],
        "query_id string, clause_id string, rank int, similarity_score double")
    r = metrics.retrieval_summary(queries, relevant, hits).first()
    assert (r["query_count"], r["mrr"], round(r["recall_1"], 4), round(r["recall_3"], 4)) == (4, 0.5, 0.3333, 0.6667)
    sweep = {x["threshold"]: x for x in metrics.threshold_sweep(queries, relevant, hits).collect()}
    assert sweep[0.5]["mrr"] == 0.5 and sweep[0.55]["mrr"] == 0.0 and sweep[0.55]["abstention_rate"] == 1.0 and sweep[0.3]["sufficient_rate"] == 0.75


def test_pair_and_latency_metrics(spark):
    key = "document_id string, source_clause_id string, target_clause_id string, relationship_type string, ord int"
    truth = spark.createDataFrame([("d", "c1", "c2", "SUPPORTS", 1), ("d", "c3", "c4", "TEMPORAL", 1)], key)
    found = spark.createDataFrame([("d", "c1", "c2", "EXCEPTS", 1), ("d", "c1", "c2", "SUPPORTS", 2), ("d", "c5", "c6", "EXCEPTS", 3)], key)
    r = metrics.pair_detection(metrics.match_pairs(truth, found)).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"], r["type_matches"]) == (1, 1, 1, 0.5, 0.5, 0.5, 1)
    ms = spark.createDataFrame([("s", float(x)) for x in (10, 20, 30, 40, 50)], "stage string, ms double")
    x = metrics.latency_summary(ms, "stage").first()
    assert (x["mean_ms"], x["median_ms"], x["min_ms"], x["max_ms"], round(x["p95_ms"], 6)) == (30.0, 30.0, 10.0, 50.0, 48.0)


def test_exposure_scores(spark):
    rows = [("none", 10, 0, 0, 2, 8, 0), ("high", 20, 1, 0, 0, 19, 0), ("medium", 10, 0, 9, 0, 1, 40)]
    counts = spark.createDataFrame(rows, "document_id string, n_clauses int, n_high int, n_medium int, n_low int, n_info int, n_relationships int")
    got = {r["document_id"]: (r["score"], r["verdict"]) for r in summary.exposure(counts).collect()}
    assert got == {"none": (8, "Standard Agreement"), "high": (65, "Critical Traps Detected"), "medium": (60, "Moderate Caution")}


def test_category_scores_are_worked_out_once(spark):
    """A filter that Spark infers from unnesting the scores must not repeat the work that made them."""
    clauses = spark.createDataFrame([("c1", "We may share your personal data."), ("c2", None)], "clause_id string, text string")
    scored = classify.category_scores(clauses.withColumn("vec", V.encode(F.col("text"))))
    rows = scored.select("clause_id", F.inline("scores"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.lower().count("zip_with(") <= 2
    assert rows.where("clause_id = 'c1'").count() == len(rules.CATEGORIES)


def test_words_of_texts_are_coded_in_python(spark):
    """Null, empty and repeated texts, words beyond the limits of what is kept; no hashing per word in the plan."""
    texts = ["Pay the fee, pay the FEE", "", None, "x" * 80 + " word", "Pay the fee, pay the FEE"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1).withColumn("vec", V.encode(F.col("text")))
    assert "md5" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["vec"] for r in rows.collect()}
    assert [got[k] for k in range(5)] == [[float(x) for x in v] for v in V.encode_phrases([t or "" for t in texts])]


def test_reasons_name_the_first_three_shared_words(spark):
    """Two shared words make a reason, one makes none; the plan looks the words up once."""
    feature = "struct<cat:int,friends:int,kw:long,flags:int,i:int,refs:array<string>,sec:string,section_title:string>"
    side = lambda kw, i: (0, 0, kw, 0, i, [], None, "t")
    pairs = spark.createDataFrame(
        [("d", 1, 2, [], 0.0, side(0b11111, 1), side(0b11110, 2)), ("d", 1, 3, [], 0.0, side(0b11, 1), side(0b110, 3))],
        f"document_id string, i int, j int, cross_refs array<string>, cos double, a {feature}, b {feature}",
    )
    rows = relate.candidate_reasons(pairs)
    got = {r["j"]: r["reasons"] for r in rows.collect()}
    assert got[2] == ["Shared domain concepts: " + ", ".join(rules.DOMAIN_KEYWORDS[1:4])]
    assert got[3] == ["Document-level candidate pairing"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(rules.DOMAIN_KEYWORDS[-1]) <= 1
