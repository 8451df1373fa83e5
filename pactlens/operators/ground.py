"""Evidence for questions and checks of generated text (Q1-Q19).

Citations are joined to the supplied clauses one by one; what is gathered per answer is
only the short list of its errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.functions.joins import within_documents


def check_questions(questions: DataFrame) -> DataFrame:
    """Q1: trims the question and adds ``reject_reason``, null for a valid request."""
    q = T.strip(F.col("question"))
    return questions.withColumns({
        "question": q,
        "reject_reason": F.when(q == "", "Question cannot be empty or contain only whitespace.")
        .when(F.length("question") > 1000, "Question exceeds maximum length of 1000 characters.")
        .when(~F.col("top_k").between(1, 10), "top_k out of range")
        .when(~F.col("threshold").between(0.0, 1.0), "threshold out of range"),
    })


def abstention_gate(results: DataFrame) -> DataFrame:
    """Q2: the fixed answer of the queries without sufficient evidence."""
    return results.where(~F.col("sufficient_evidence")).select(
        "query_id", F.lit("insufficient_evidence").alias("status"), F.lit(None).cast("string").alias("answer"),
        F.lit(0.0).alias("confidence"), F.lit(rules.INSUFFICIENT).alias("uncertainty"),
    )


def evidence_rows(hits: DataFrame) -> DataFrame:
    """Q3: the hits that meet the threshold, which are the evidence of their query."""
    return hits.where("meets_threshold")


def _ordered(order: str, *fields) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("row"))))
    return F.transform(rows, lambda r: r["row"])


def question_payloads(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q4: the JSON payload of every question that has evidence (at most top k clauses)."""
    listed = evidence.groupBy("query_id").agg(_ordered(
        "rank", "clause_id", F.coalesce("section_title", F.lit(rules.GENERAL)).alias("section_title"), "text",
        F.coalesce("primary_category", F.lit(rules.GENERAL)).alias("category"),
        F.coalesce("attention_level", F.lit(rules.INFORMATIONAL)).alias("attention_level"),
        F.col("location").alias("source_location"), T.shown(F.col("similarity_score"), 3).alias("similarity_score"),
    ).alias("evidence"))
    return questions.join(listed, "query_id").select(
        "query_id", F.to_json(F.struct(F.col("query").alias("question"), "evidence")).alias("payload")
    )


def _clause_struct(prefix: str = "") -> list:
    c = lambda name: F.col(prefix + name)
    return [
        c("clause_id").alias("clause_id"), F.coalesce(c("section_title"), F.lit(rules.GENERAL)).alias("section_title"),
        F.coalesce(c("primary_category"), F.lit(rules.GENERAL)).alias("category"),
        F.coalesce(c("attention_level"), F.lit(rules.INFORMATIONAL)).alias("attention_level"),
        c("location").alias("source_location"), c("text").alias("text"),
    ]


def clause_payloads(clauses: DataFrame) -> DataFrame:
    """Q5: the JSON payload that explains one clause."""
    f = _clause_struct()
    reasons = F.when(F.size("attention_reasons") > 0, F.array_join("attention_reasons", ", ")).otherwise("None noted")
    body = F.struct(f[0], f[1], f[2], f[3], reasons.alias("attention_indicators"), f[4], f[5])
    return clauses.select(
        "clause_id", F.to_json(F.struct(F.lit("EXPLAIN_CLAUSE").alias("task"), body.alias("clause"))).alias("payload")
    )


def relationship_payloads(relationships: DataFrame, clauses: DataFrame) -> DataFrame:
    """Q6: the JSON payload that explains one relationship and its two clauses, which are clauses of its document.

    Both joins are made where a document is: a text travels once, as a clause, and not with each relationship.
    """
    def end(name: str) -> DataFrame:
        return clauses.select("document_id", "clause_id", F.struct(*_clause_struct()).alias(f"{name}_clause"))

    rows = relationships
    for name in ("source", "target"):
        rows = within_documents(rows, end(name), f"{name}_clause_id", "clause_id")
    return rows.select("document_id", "relationship_id", F.to_json(F.struct(
        F.lit("EXPLAIN_RELATIONSHIP").alias("task"), "relationship_type", "rationale",
        F.col("evidence.trigger").alias("trigger"), "source_clause", "target_clause",
    )).alias("payload"))


def prioritized_clauses(clauses: DataFrame, limit: int = 20) -> DataFrame:
    """Q8: the clauses worth a synthesis, with ``priority``.

    A document with more than ``limit`` clauses gives its strongest ones, the others all
    of theirs in order.  One row beyond the limit tells the two cases apart, so a
    document never has to be counted or gathered whole.
    """
    level = F.coalesce(F.array_position(
        F.array(*[F.lit(x) for x in rules.LEVELS[:3]]), F.col("attention_level")
    ), F.lit(0)).cast("int")
    rows = clauses.withColumn("_level", F.when(level == 0, 4).otherwise(level))
    by_level = Window.partitionBy("document_id").orderBy("_level", "clause_index")
    rows = rows.withColumn("_n", F.row_number().over(by_level)).where(F.col("_n") <= limit + 1)
    rows = rows.withColumn("_many", F.max("_n").over(Window.partitionBy("document_id")) > limit)
    rows = rows.where(F.col("_n") <= limit)
    final = Window.partitionBy("document_id").orderBy(
        F.when(F.col("_many"), F.col("_n")).otherwise(F.col("clause_index"))
    )
    return rows.withColumn("priority", F.row_number().over(final)).drop("_level", "_n", "_many")


def top_relationships(relationships: DataFrame, limit: int = 15) -> DataFrame:
    """Q9: the strongest relationships of a document; ``rank`` is by confidence."""
    order = Window.partitionBy("document_id").orderBy("rank")
    return relationships.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def synthesis_payloads(clauses: DataFrame, relationships: DataFrame, concerns: list[str] = ()) -> DataFrame:
    """Q7: the JSON payload for a whole document, of at most 20 clauses and 15 edges."""
    listed = prioritized_clauses(clauses).groupBy("document_id").agg(
        _ordered("priority", *_clause_struct()).alias("clauses")
    )
    edges = top_relationships(relationships).groupBy("document_id").agg(_ordered(
        "rank", "relationship_id", "source_clause_id", "target_clause_id", "relationship_type", "rationale",
        F.col("evidence.trigger").alias("trigger"),
    ).alias("relationships"))
    rows = listed.join(edges, "document_id", "left")
    none = rows.schema["relationships"].dataType
    return rows.select("document_id", F.to_json(F.struct(
        F.lit("MULTI_CLAUSE_SYNTHESIS").alias("task"),
        F.array(*[F.lit(c) for c in concerns]).cast("array<string>").alias("user_concerns"), "clauses",
        F.coalesce("relationships", F.array().cast(none)).alias("relationships"),
    )).alias("payload"))


def clause_subset(clauses: DataFrame, requested: DataFrame) -> DataFrame:
    """Q10: the requested clauses of every document, ``requested(document_id, clause_id)``."""
    return clauses.join(requested, ["document_id", "clause_id"], "left_semi")


def empty_requests(clauses: DataFrame, requested: DataFrame) -> DataFrame:
    """Q10: documents none of whose requested clauses exist."""
    found = clause_subset(clauses, requested).select("document_id").distinct()
    return requested.select("document_id").distinct().join(found, "document_id", "left_anti")


def extractive_quote(text: Column, fallback: int = 50) -> Column:
    """Q11: the first sentence if it says anything, else the first characters."""
    first = F.substring_index(text, ".", 1)
    return F.when(F.length(first) > 10, first).otherwise(F.left(text, F.lit(fallback)))


# -- validation -----------------------------------------------------------------------

_QUOTE_EDGE = " .\u2026'\""


def quote_state(quote: Column, source: Column) -> Column:
    """Q15: ``empty``, ``found`` or ``missing``, by matching form, then without punctuation."""
    def judge(p: Column) -> Column:
        bare = T.without_punctuation(p["q"])
        loose = (bare != "") & T.without_punctuation(p["s"]).contains(bare)
        return F.when(p["q"] == "", "empty").when(p["s"].contains(p["q"]) | loose, "found").otherwise("missing")

    return T.let(F.struct(
        F.btrim(T.matching_form(quote), F.lit(_QUOTE_EDGE)).alias("q"), T.matching_form(source).alias("s")
    ), judge)


def forbidden_phrases(text: Column) -> Column:
    """Q16: (pattern number, phrase) of every forbidden conclusion in a generated text."""
    found = F.array(*[
        F.struct(F.lit(n).alias("n"), T.first_match(text, p).alias("phrase"))
        for n, p in enumerate(rules.FORBIDDEN_CONCLUSIONS)
    ])
    return F.filter(found, lambda f: f["phrase"].isNotNull())


def _quoted(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def citations(answers: DataFrame, supplied: DataFrame, sources: str) -> DataFrame:
    """Q12: one row per citation with the supplied clause it names (null if none).

    ``answers(answer_id, <sources>)``; ``supplied(answer_id, clause_id, section_title,
    location, text)``.
    """
    cited = answers.select("answer_id", F.posexplode(sources).alias("pos", "c")).select(
        "answer_id", "pos", "c", F.col("c.clause_id").alias("clause_id")
    )
    known = supplied.select("answer_id", "clause_id", F.struct("section_title", "location", "text").alias("clause"))
    return cited.join(known, ["answer_id", "clause_id"], "left")


def citation_errors(answers: DataFrame, supplied: DataFrame, sources: str, qa: bool) -> DataFrame:
    """Q12-Q15: ``(answer_id, phase, pos, ord, message)``."""
    rows = citations(answers, supplied, sources)
    unknown = rows.where("clause is null")
    valid = supplied.join(unknown.select("answer_id").distinct(), "answer_id", "left_semi").groupBy("answer_id").agg(
        F.array_sort(F.collect_set("clause_id")).alias("ids")
    )
    ids = F.concat(F.lit("["), F.array_join(F.transform(
        F.coalesce("ids", F.array().cast("array<string>")), lambda i: F.concat(F.lit("'"), i, F.lit("'"))
    ), ", "), F.lit("]"))
    lead = ("source citation", "Retrieved candidate IDs") if qa else ("evidence reference", "Valid IDs")
    missing = unknown.join(valid, "answer_id", "left").select(
        "answer_id", F.lit(1).alias("phase"), "pos", F.lit(0).alias("ord"),
        F.concat(F.lit(f"Unsupported clause ID in {lead[0]}: '"), "clause_id", F.lit(f"'. {lead[1]} were: "), ids, F.lit(".")).alias("message"),
    )
    title, place, quote = F.col("c.section_title") if qa else F.lit(None), F.col("c.source_location"), F.col("c.quoted_text")
    expected = F.coalesce("clause.section_title", F.lit(rules.GENERAL))
    mismatch = lambda what, cited, right: F.concat(
        F.lit(f"{what} mismatch for clause '"), "clause_id", F.lit("': cited '"), cited, F.lit("', expected '"), right, F.lit("'.")
    )
    what = "excerpt" if qa else "snippet"
    state = quote_state(quote, F.col("clause.text"))
    place_differs = T.matching_form(place) != T.matching_form(F.col("clause.location"))
    if not qa:
        place_differs = place_differs & (T.matching_form(place) != "")
    checks = [
        F.when((_quoted(place) != "") & place_differs, mismatch("Location", place, F.col("clause.location"))),
        F.when(state == "missing", F.concat(
            F.lit("Fabricated or modified quotation in clause '"), "clause_id", F.lit(f"': quoted {what} \""),
            F.left(quote, F.lit(80)), F.lit("...\" was not found in source clause text."),
        )),
    ]
    if qa:
        checks = [
            F.when(
                (_quoted(title) != "") & (T.matching_form(title) != T.matching_form(expected)),
                mismatch("Section title", title, expected),
            ),
            checks[0],
            F.when(state == "empty", F.concat(F.lit("Empty quotation cited for clause '"), "clause_id", F.lit("'."))).otherwise(checks[1]),
        ]
    wrong = rows.where("clause is not null").select(
        "answer_id", F.lit(2).alias("phase"), "pos", F.posexplode(F.array(*checks)).alias("ord", "message")
    ).where("message is not null")
    return missing.unionByName(wrong)


def guard_errors(answers: DataFrame, texts: Column, where: str) -> DataFrame:
    """Q16: errors of forbidden conclusions in the generated ``texts`` of an answer."""
    rows = answers.select("answer_id", F.posexplode(texts).alias("pos", "t")).where("t is not null")
    return rows.select("answer_id", "pos", F.inline(forbidden_phrases(F.col("t")))).select(
        "answer_id", F.lit(3).alias("phase"), "pos", F.col("n").alias("ord"),
        F.concat(
            F.lit(f"Forbidden legal conclusion detected in {where}: '"), "phrase",
            F.lit("'. The system must remain informational and neutral without asserting legal determinations."),
        ).alias("message"),
    )


def _verdicts(answers: DataFrame, errors: DataFrame) -> DataFrame:
    listed = errors.groupBy("answer_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("phase", "pos", "ord", "message"))), lambda e: e["message"]
    ).alias("validation_errors"))
    rows = answers.join(listed, "answer_id", "left")
    rows = rows.withColumn("validation_errors", F.coalesce("validation_errors", F.array().cast("array<string>")))
    return rows.withColumn("is_valid", F.size("validation_errors") == 0)


def _failure() -> Column:
    return F.concat(
        F.lit("Evidence validation failed with "), F.size("validation_errors").cast("string"),
        F.lit(" error(s): "), F.array_join("validation_errors", "; "),
    )


def _filled(rows: DataFrame, citations: DataFrame) -> DataFrame:
    """Q13, Q14: ``rows`` with the filled citations of their answers as ``sources``."""
    fields = ("clause_id", "section_title", "source_location", "quoted_text")
    packed = citations.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("filled"))
    plain = F.transform("filled", lambda c: F.struct(*[c[f].alias(f) for f in fields]))
    return rows.join(packed, "answer_id", "left").withColumn("sources", F.coalesce(plain, F.col("sources"))).drop("filled")


def fill_references(explanations: DataFrame, supplied: DataFrame) -> DataFrame:
    """Q13: references of explanations; an empty location is filled in from the clause, other fields stay."""
    rows = citations(explanations, supplied, "evidence_references")
    place = F.when(_quoted(F.col("c.source_location")) == "", F.coalesce("clause.location", "c.source_location"))
    filled = F.col("c").withField("source_location", place.otherwise(F.col("c.source_location")))
    return rows.select("answer_id", "pos", filled.alias("reference"))


def validate_answers(answers: DataFrame, supplied: DataFrame) -> DataFrame:
    """Q12-Q17 for answers ``(answer_id, answer, evidence_sufficient, confidence, sources, uncertainty)``."""
    said = F.array(F.concat(_quoted(F.col("answer")), F.lit(" "), _quoted(F.col("uncertainty"))))
    errors = citation_errors(answers, supplied, "sources", True).unionByName(guard_errors(answers, said, "answer"))
    rows = _filled(_verdicts(answers, errors), fill_citations(answers, supplied))
    ok = F.col("is_valid")
    return rows.withColumns({
        "uncertainty": F.when(ok, F.col("uncertainty")).otherwise(_failure()),
        "answer": F.when(ok, F.col("answer")).otherwise(rules.REJECTED_ANSWER),
        "evidence_sufficient": ok & F.col("evidence_sufficient"),
        "confidence": F.when(ok, F.col("confidence")).otherwise(0.0),
        "sources": F.when(ok, F.col("sources")).otherwise(F.slice("sources", 1, 0)),
    })


def validate_explanations(explanations: DataFrame, supplied: DataFrame) -> DataFrame:
    """Q12-Q17 for explanations of clauses, relationships and documents."""
    said = F.concat(
        F.array("summary", "attention_explanation", "relationship_explanation", "uncertainty"), F.col("key_points")
    )
    errors = citation_errors(explanations, supplied, "evidence_references", False).unionByName(
        guard_errors(explanations, said, "explanation")
    )
    packed = fill_references(explanations, supplied).groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "reference"))).alias("filled")
    )
    filled = F.coalesce(F.transform("filled", lambda r: r["reference"]), F.col("evidence_references"))
    rows = _verdicts(explanations, errors).join(packed, "answer_id", "left")
    rows = rows.withColumn("evidence_references", filled).drop("filled")
    ok = F.col("is_valid")
    return rows.withColumns({
        "uncertainty": F.when(ok, F.col("uncertainty")).otherwise(_failure()),
        "summary": F.when(ok, F.col("summary")).otherwise(rules.REJECTED_EXPLANATION),
        "attention_explanation": F.when(ok, F.col("attention_explanation")).otherwise(""),
        "relationship_explanation": F.when(ok, F.col("relationship_explanation")).otherwise(""),
        "key_points": F.when(ok, F.col("key_points")).otherwise(F.slice("key_points", 1, 0)),
        "evidence_sufficient": ok & F.col("evidence_sufficient"),
        "evidence_references": F.when(ok, F.col("evidence_references")).otherwise(F.slice("evidence_references", 1, 0)),
    })


def fill_citations(answers: DataFrame, supplied: DataFrame) -> DataFrame:
    """Q13, Q14: citations with an empty title or location filled in from the clause."""
    rows = citations(answers, supplied, "sources")
    fill = lambda cited, right: F.when(_quoted(cited) == "", F.coalesce(right, cited)).otherwise(cited)
    return rows.select(
        "answer_id", "pos", "clause_id",
        fill(F.col("c.section_title"), F.when(F.col("clause").isNotNull(), F.coalesce("clause.section_title", F.lit(rules.GENERAL)))).alias("section_title"),
        fill(F.col("c.source_location"), F.col("clause.location")).alias("source_location"),
        F.col("c.quoted_text").alias("quoted_text"),
    )


def answer_status(evidence_sufficient: Column, uncertainty: Column) -> Column:
    """Q18: what became of an answer."""
    failed = F.lower(_quoted(uncertainty)).contains("validation failed")
    return (
        F.when(~evidence_sufficient & failed, "validation_failed")
        .when(~evidence_sufficient, "insufficient_evidence").otherwise("success")
    )


def explanation_status(evidence_sufficient: Column, uncertainty: Column) -> Column:
    """Q18: what became of an explanation."""
    failed = F.lower(_quoted(uncertainty)).contains("validation failed")
    return F.when(~evidence_sufficient & failed, "validation_failed").otherwise("success")


def degraded_sources(evidence: DataFrame) -> DataFrame:
    """Q19: the evidence shown in place of an answer that could not be generated."""
    short = F.when(F.length("text") > 120, F.concat(F.left("text", F.lit(120)), F.lit("..."))).otherwise(F.col("text"))
    return evidence.select(
        "query_id", "rank", "clause_id", "section_title", F.col("location").alias("source_location"),
        short.alias("quoted_text"), F.lit("llm_unavailable").alias("status"),
    )
