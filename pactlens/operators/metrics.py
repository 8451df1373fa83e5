"""Evaluation metrics (E1-E22) as aggregations over label and prediction tables.

A mean that a reader would round is left unrounded; presentation rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.operators.quantiles import with_quantiles


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """Counts of ``pairs(truth, pred)``; labels outside the list do not count."""
    counts = pairs.where(F.col("truth").isin(labels)).groupBy("truth").agg(*[
        F.count_if(F.col("pred") == x).alias(x) for x in labels
    ])
    # Labels that the truth lacks have a row of zeros.
    rows = pairs.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    return rows.join(counts, "truth", "left").fillna(0, labels)


def confusion_totals(pairs: DataFrame) -> DataFrame:
    """Counts per (truth, pred) with both margins; null stands for all."""
    return pairs.cube("truth", "pred").agg(F.count("*").alias("n"))


def per_class(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1 per class, of the classes that occur or of ``labels``.

    A given label that does not occur has zeros.  Pairs with other labels still count as
    errors of the given label on their other side.
    """
    hit = (F.col("truth") == F.col("pred")).cast("int")
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")),
    )).alias("s")).select("s.*")
    if labels is not None:
        sides = sides.where(F.col("label").isin(labels))
    counts = sides.groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted")
    )
    if labels is not None:
        given = pairs.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(labels)], "label string")
        counts = given.join(counts, "label", "left").fillna(0, ["tp", "support", "predicted"])
    rows = counts.withColumns({
        "fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp"),
        "precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support")),
    })
    return rows.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).drop("predicted")


def classification_summary(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Accuracy over all pairs and the macro means over the classes (of ``labels``) that the truth has."""
    classes = per_class(pairs)
    present = F.col("support") > 0
    if labels is not None:
        present = present & F.col("label").isin(labels)
    mean = lambda c: F.coalesce(F.avg(F.when(present, F.col(c))), F.lit(0.0))
    return classes.agg(
        F.sum("support").alias("sample_size"), F.sum("tp").alias("correct_predictions"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"), mean("precision").alias("macro_precision"),
        mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"),
    )


def mismatches(pairs: DataFrame) -> DataFrame:
    """E5: wrong predictions with the beginning of their text."""
    short = F.when(F.length("text") > 120, F.concat(F.left("text", F.lit(120)), F.lit("..."))).otherwise(F.col("text"))
    return pairs.where(~F.col("truth").eqNullSafe(F.col("pred"))).withColumn("snippet", short).drop("text")


def query_scores(relevant: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Reciprocal rank and hits within k per query that has relevant clauses.

    ``relevant(query_id, clause_id)``, ``hits(query_id, clause_id, rank)``.
    """
    wanted = relevant.distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    found = hits.join(wanted, ["query_id", "clause_id"]).groupBy("query_id").agg(
        F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks]
    )
    rows = total.join(found, "query_id", "left")
    return rows.select(
        "query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        *[F.coalesce(F.col(f"hits_{k}") / F.col("n_relevant"), F.lit(0.0)).alias(f"recall_{k}") for k in ks],
        *[F.coalesce(F.col(f"hits_{k}") / k, F.lit(0.0)).alias(f"precision_{k}") for k in ks],
    )


def _means(ks) -> list[Column]:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return [mean("rr").alias("mrr")] + [mean(f"{m}_{k}").alias(f"{m}_{k}") for m in ("recall", "precision") for k in ks]


def retrieval_summary(queries: DataFrame, relevant: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Means over the queries with relevant clauses; all queries are counted."""
    scored = queries.select("query_id").join(query_scores(relevant, hits, ks), "query_id", "left")
    return scored.agg(F.count("*").alias("query_count"), *_means(ks))


def threshold_sweep(
    queries: DataFrame, relevant: DataFrame, hits: DataFrame,
    thresholds: list[float] = rules.SWEEP_THRESHOLDS, ks: tuple[int, ...] = (1, 3, 5),
) -> DataFrame:
    """E6 for the hits above each threshold, with sufficiency and abstention rates.

    The ranks of the hits above a threshold are their ranks among all hits, because the
    hits are ranked by the score that is compared.  So one aggregation per query yields
    all thresholds.
    """
    wanted = relevant.distinct().withColumn("relevant", F.lit(1))
    rows = hits.join(wanted, ["query_id", "clause_id"], "left")
    good = F.col("relevant").isNotNull()
    aggs = []
    for n, t in enumerate(thresholds):
        above = F.col("similarity_score") >= t
        aggs.append(F.struct(
            F.lit(t).alias("threshold"), F.bool_or(above).alias("sufficient"),
            F.min(F.when(good & above, F.col("rank"))).alias("first"),
            *[F.count_if(good & above & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks],
        ))
    found = rows.groupBy("query_id").agg(F.array(*aggs).alias("found"))
    none = F.array(*[F.struct(
        F.lit(t).alias("threshold"), F.lit(False).alias("sufficient"), F.lit(None).cast("int").alias("first"),
        *[F.lit(0).cast("long").alias(f"hits_{k}") for k in ks],
    ) for t in thresholds])
    total = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    per_query = queries.select("query_id").join(found, "query_id", "left").join(total, "query_id", "left").select(
        "n_relevant", F.inline(F.coalesce("found", none))
    )
    judged = F.col("n_relevant").isNotNull()
    when = lambda v: F.when(judged, v)
    scored = per_query.select(
        "threshold", "sufficient", when(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
        *[when(F.col(f"hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}") for k in ks],
        *[when(F.col(f"hits_{k}") / k).alias(f"precision_{k}") for k in ks],
    )
    return scored.groupBy("threshold").agg(
        F.count("*").alias("query_count"), *_means(ks),
        F.avg(F.col("sufficient").cast("int")).alias("sufficient_rate"),
        F.avg((~F.col("sufficient")).cast("int")).alias("abstention_rate"),
    )


def retrieval_misses(relevant: DataFrame, hits: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Queries none of whose relevant clauses is found above the threshold."""
    kept = hits.where(F.col("similarity_score") >= threshold).select("query_id", "clause_id")
    reached = kept.join(relevant, ["query_id", "clause_id"], "left_semi").select("query_id").distinct()
    return relevant.select("query_id").distinct().join(reached, "query_id", "left_anti")


_KEY = ["document_id", "source_clause_id", "target_clause_id"]


def match_pairs(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every true or predicted pair once, with ``true_type`` and ``pred_type``.

    ``ord`` tells which type a repeated pair has last.
    """
    last = lambda df, name: df.groupBy(*_KEY).agg(F.max_by("relationship_type", "ord").alias(name))
    return last(truth, "true_type").join(last(predicted, "pred_type"), _KEY, "full_outer")


def pair_detection(matched: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the pairs, type accuracy of those detected."""
    true, pred = F.col("true_type").isNotNull(), F.col("pred_type").isNotNull()
    counts = matched.agg(
        F.count_if(true).alias("ground_truth_count"), F.count_if(pred).alias("predicted_count"),
        F.count_if(true & pred).alias("tp"), F.count_if(~true & pred).alias("fp"), F.count_if(true & ~pred).alias("fn"),
        F.count_if(F.col("true_type") == F.col("pred_type")).alias("type_matches"),
    ).withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted_count")), "recall": _ratio(F.col("tp"), F.col("ground_truth_count")),
        "type_accuracy": _ratio(F.col("type_matches"), F.col("tp")),
    })
    return counts.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def per_type(matched: DataFrame) -> DataFrame:
    """Precision, recall and F1 per relationship type."""
    pairs = matched.select(F.col("true_type").alias("truth"), F.col("pred_type").alias("pred"))
    return per_class(pairs).where("label is not null")


def pair_examples(matched: DataFrame, limit: int = 5) -> DataFrame:
    """The first false positives and false negatives in key order (a report of that many)."""
    wrong = matched.where("true_type is null or pred_type is null").withColumn(
        "error", F.when(F.col("true_type").isNull(), "false_positive").otherwise("false_negative")
    )
    order = Window.partitionBy("error").orderBy(*_KEY)
    return wrong.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select(
        "error", "n", *_KEY, F.coalesce("pred_type", "true_type").alias("relationship_type")
    )


def _abstained() -> Column:
    return (F.col("system_status") == "insufficient_evidence") | F.col("answer").isNull()


def abstention(results: DataFrame) -> DataFrame:
    """How well unanswerable questions are recognised."""
    gone, can = _abstained(), F.col("expected_answerable")
    counts = results.agg(
        F.count_if(~can).alias("unsupported_total"), F.count_if(~can & gone).alias("correctly_abstained"),
        F.count_if(can & gone).alias("false_abstentions"), F.count_if(gone).alias("abstained"),
    ).withColumns({
        "incorrectly_answered": F.col("unsupported_total") - F.col("correctly_abstained"),
        "abstention_precision": _ratio(F.col("correctly_abstained"), F.col("abstained")),
        "abstention_recall": _ratio(F.col("correctly_abstained"), F.col("unsupported_total")),
    })
    return counts.withColumn("abstention_f1", _f1(F.col("abstention_precision"), F.col("abstention_recall")))


def citation_scores(results: DataFrame) -> DataFrame:
    """Citation precision, recall and accuracy over the answered answerable questions."""
    answered = results.where(F.col("expected_answerable") & F.col("answer").isNotNull())
    expected, cited = F.array_distinct("expected_source_clause_ids"), F.array_distinct("cited_clause_ids")
    tp = F.size(F.array_intersect(expected, cited))
    any_ = (F.size(expected) > 0) | (F.size(cited) > 0)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return answered.agg(
        F.count("*").alias("answered_questions"),
        mean(F.when(any_, _ratio(tp, F.size(cited)))).alias("citation_precision"),
        mean(F.when(any_, _ratio(tp, F.size(expected)))).alias("citation_recall"),
        mean((any_ & (F.size(F.array_except(expected, cited)) == 0)).cast("int")).alias("citation_accuracy"),
    )


def hallucination_rates(results: DataFrame) -> DataFrame:
    """Shares of answers with an unsupported claim or a made-up citation."""
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return results.agg(
        F.count("*").alias("total_questions"), F.count_if("has_unsupported_claim").alias("unsupported_claim_count"),
        share("has_unsupported_claim").alias("unsupported_claim_rate"),
        F.count_if("has_fabricated_citation").alias("fabricated_citation_count"),
        share("has_fabricated_citation").alias("fabricated_citation_rate"),
    )


def has_forbidden_claim(answer: Column, claims: Column) -> Column:
    """Whether an answer holds one of the claims that it must not make."""
    lower = F.lower(answer)
    return F.coalesce(F.exists(claims, lambda c: lower.contains(F.lower(c))), F.lit(False))


def fabricated_citations(results: DataFrame, clauses: DataFrame) -> DataFrame:
    """Citations of clauses that the document does not have."""
    cited = results.select("question_id", "document_id", F.explode("cited_clause_ids").alias("clause_id"))
    return cited.join(clauses.select("document_id", "clause_id"), ["document_id", "clause_id"], "left_anti")


def validator_acceptance(verdicts: DataFrame) -> DataFrame:
    """Rejection and false acceptance of adversarial cases ``(should_pass, is_valid)``."""
    bad, ok = ~F.col("should_pass"), F.col("is_valid")
    counts = verdicts.agg(
        F.count_if(bad).alias("adversarial_cases"), F.count_if(bad & ~ok).alias("correctly_rejected"),
        F.count_if(bad & ok).alias("false_acceptances"), F.count_if(~bad & ok).alias("valid_accepted"),
        F.count_if(~bad & ~ok).alias("valid_rejected"),
    )
    return counts.withColumns({
        "rejection_rate": _ratio(F.col("correctly_rejected"), F.col("adversarial_cases")),
        "false_acceptance_rate": _ratio(F.col("false_acceptances"), F.col("adversarial_cases")),
    })


def latency_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """Mean, median, least, greatest and 95th percentile (interpolated, exact) of ``ms``."""
    groups = samples.groupBy(*keys).agg(F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.count("ms").alias("n"))
    return with_quantiles(groups, samples, list(keys), "ms", {"median_ms": 0.5, "p95_ms": 0.95}).select(
        *keys, "mean_ms", "median_ms", "min_ms", "max_ms", "p95_ms"
    )


def assemble_labels(specification: DataFrame, clauses: DataFrame) -> DataFrame:
    """Label rows ``(document_id, clause_index, ...)`` with the clause they speak of."""
    facts = clauses.select("document_id", "clause_index", "clause_id", "section_title", "text")
    return specification.join(facts, ["document_id", "clause_index"])


def label_distribution(labels: DataFrame, column: str) -> DataFrame:
    """Rows per label value and their percentage."""
    counts = labels.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def label_violations(labels: DataFrame) -> DataFrame:
    """Rule violations of clause labels, one row per (clause, rule)."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = F.array(
        F.when(empty("text") | empty("clause_id") | empty("document_id"), "missing_field"),
        F.when(~F.coalesce(F.col("expected_primary_category").isin(rules.CATEGORIES + [rules.GENERAL]), F.lit(False)), "unknown_category"),
        F.when(~F.coalesce(F.col("expected_attention_level").isin(rules.LEVELS), F.lit(False)), "unknown_level"),
        F.when(F.coalesce(F.length("rationale"), F.lit(0)) <= 10, "short_rationale"),
    )
    return labels.select(
        "document_id", "clause_id", F.explode(F.filter(found, lambda v: v.isNotNull())).alias("violation")
    )


def label_coverage(labels: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses that no label speaks of."""
    return clauses.select("document_id", "clause_index", "clause_id").join(
        labels.select("document_id", "clause_index"), ["document_id", "clause_index"], "left_anti"
    )
