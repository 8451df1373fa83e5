"""Contract tables derived from the ``documents`` and ``conversations`` tables.

The driver's texts hold no contract vocabulary, so every line of every document, blank
ones too, is led by one of the contract sentences below and becomes one clause.  The
whole text of the whole table flows through, outer spaces of lines too, and all of it
grows with the table.  A null or empty text has one blank line.
The derivation is one narrow projection per document row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions import text as T

# (title, expected category, expected level, sentence)
TEMPLATES = [
    ("Acceptance of Terms", "General", "Informational", "By opening the service you confirm that you have read the whole agreement."),
    ("Renewal", "Payment", "High Attention", "Plans automatically renew each month and all fees are non-refundable."),
    ("Cancelling a Plan", "Payment", "Medium Attention", "Tell us at least 30 days prior to the renewal date if you want to stop."),
    ("Cancel Anytime", "Account", "Informational", "You may cancel at any time through your account settings."),
    ("Price Updates", "Payment", "Medium Attention", "We may modify pricing of a subscription, as described in Section 2 of this agreement."),
    ("Suspension", "Account", "High Attention", "We may suspend or terminate your account immediately, without notice or liability, for any reason whatsoever."),
    ("Cure Period", "Account", "Informational", "A breach may be repaired: there is an opportunity to cure, and we act upon 10 days written notice."),
    ("Deletion of Data", "Account", "Medium Attention", "On termination we permanently delete the profile, except as required for audits."),
    ("Arbitration", "Dispute", "Medium Attention", "Every dispute goes to binding individual arbitration before one arbitrator."),
    ("Group Claims", "Dispute", "Medium Attention", "You accept a class action waiver for each claim."),
    ("Courts", "Dispute", "Medium Attention", "The governing law is local law and the courts of Springfield have jurisdiction."),
    ("Liability Cap", "Liability", "High Attention", "Our aggregate liability is limited to the amount paid, to the maximum extent permitted by law."),
    ("Damages", "Liability", "Medium Attention", "In no event shall we be liable for any indirect damages or lost data."),
    ("Indemnity", "Liability", "Medium Attention", "You agree to indemnify us against claims that follow from your content."),
    ("License", "User Content", "Medium Attention", "You grant us a license to use user content, perpetual for the life of the service."),
    ("Sublicense", "User Content", "Medium Attention", "The rights in posted content are sublicensable, provided that credit is given."),
    ("Sharing", "Privacy & Data", "Medium Attention", "We share your personal data with third parties who run analytics."),
    ("Retention", "Privacy & Data", "Medium Attention", "We retain data after account closure for a period of 90 days."),
    ("Advertising", "Privacy & Data", "Medium Attention", "Partners use cookies for behavioral advertising and tracking."),
    ("Revised Terms", "Changes", "High Attention", "We may modify or replace these terms at any moment, without prior notice, at our sole discretion."),
    ("Acceptance by Use", "Changes", "Medium Attention", "Your continued use of the site constitutes acceptance of each change to these terms."),
    ("Warranty", "Liability", "Low Attention", "The service is offered as is and as available."),
    ("Reading the Terms", "Changes", "Low Attention", "These terms may be updated, so a periodic review is wise."),
    ("Cookie Notice", "Privacy & Data", "Low Attention", "We place standard cookies only, see Section 3 for the list."),
    ("Notice of Changes", "Changes", "Informational", "We will notify you and give 14 days notice of changes that are material."),
    ("Refunds", "Payment", "Informational", "A yearly plan is eligible for a refund in the first week and a prorated refund later."),
    ("Precedence", "General", "Informational", "In the event of any conflict this section shall prevail over Section 1 and Section 4."),
    ("Dependencies", "General", "Informational", "This permission is subject to the terms of Section 5 and contingent on payment."),
    ("Limits of Use", "General", "Informational", "Without limiting the generality of Clause 2, access is granted solely for the purpose of evaluation."),
    ("Billing Cycle", "Payment", "Informational", "Invoices are billed in advance at the start of the billing cycle by credit card."),
    ("Passwords", "Account", "Informational", "Keep your password and login secret, and report unauthorized access to your account."),
    ("Usage Logs", "Privacy & Data", "Informational", "Telemetry and usage logs help us find faults."),
    ("Copyright", "User Content", "Informational", "Report copyright infringement and other intellectual property matters to our agent."),
    ("Service Hours", "General", "Informational", "Support is reachable on working days - see Paragraph 7 for details."),
    ("Amendments", "Changes", "Informational", "An amendment needs the written form, unless otherwise expressly stated."),
    ("Venue", "Dispute", "Medium Attention", "Claims that are not settled are heard with venue in Oakland, save for small claims."),
    ("Exceptions", "General", "Informational", "All plans include support, with the exception of trial plans; Section 6 lists them."),
    ("Contact", "General", "Informational", "Write to the address on the website. It's read every day."),
    ("Billing Data", "Payment", "Informational", "We keep payment and billing records in accordance with Section 8, for the duration of termination proceedings."),
    ("Children", "General", "Informational", "The service isn't meant for children under the age of thirteen."),
]

# (question category, question)
QUESTIONS = [
    ("Payment", "Can I get my money back or a refund of the payment?"),
    ("Account", "When can they cancel or delete my account?"),
    ("Privacy & Data", "Is my private data safe with third parties?"),
    ("Dispute", "Can I sue the company in court?"),
    ("Liability", "How large is the liability for damages?"),
    ("User Content", "Who owns the license to posted content?"),
    ("Changes", "Will they notify users of changes to the terms?"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores if it has fewer splits than there are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _templates() -> Column:
    return F.array(*[
        F.struct(F.lit(t).alias("title"), F.lit(c).alias("category"), F.lit(l).alias("level"), F.lit(s).alias("sentence"), F.lit(t.upper()).alias("upper"))
        for t, c, l, s in TEMPLATES
    ])


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def _template_index(k: Column) -> Column:
    return ((F.col("doc_id") * 7 + k * 11) % len(TEMPLATES)).cast("int")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clause per document line, with the labels that its template carries."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", "source", F.posexplode(_lines()).alias("k", "line")
    ).withColumn("tmpl", _template_index(F.col("k")))
    picked = rows.withColumn("t", F.get(_templates(), F.col("tmpl")))
    text = F.concat(F.col("t.sentence"), F.lit(" "), "line")
    paged = F.col("doc_id") % 3 == 0
    page = F.floor(F.col("k") / 3).cast("int") + 1
    start = F.col("k") * 1000
    return picked.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"),
        F.format_string("doc_%d_clause_%03d", F.col("doc_id"), F.col("k") + 1).alias("clause_id"),
        (F.col("k") + 1).alias("clause_index"),
        F.when(F.col("tmpl") % 8 == 7, "General")
        .otherwise(F.concat((F.col("k") + 1).cast("string"), F.lit(". "), F.col("t.title"))).alias("section_title"),
        text.alias("text"),
        F.struct(
            F.when(paged, page).alias("page_number"),
            F.when(paged, page + (F.col("k") % 2).cast("int")).alias("end_page_number"),
            start.alias("start_char"), (start + F.length(text)).alias("end_char"),
            F.when(paged, "pdf").otherwise("text").alias("source_type"),
        ).alias("source_location"),
        F.col("t.category").alias("expected_category"),
        F.col("t.level").alias("expected_level"),
        F.col("tmpl").alias("template"),
    )


def _piece(line: Column, k: Column) -> Column:
    """Line ``k`` of a document as contract text, in the layout of the document."""
    return T.let(F.get(_templates(), _template_index(k)), lambda t: _layout(t, line, k))


def _layout(t: Column, line: Column, k: Column) -> Column:
    body = F.concat(t["sentence"], F.lit(" "), line)
    n = (k + 1).cast("string")
    style = F.col("doc_id") % 6
    letter = lambda base: F.char(k % 26 + base)
    return (
        F.when((style == 0), F.concat(n, F.lit(". "), t["title"], F.lit("\n"), body))
        .when((style == 1) & (k % 3 == 0), F.concat(F.lit("SECTION "), n, F.lit(": "), t["title"], F.lit("\n\n"), n, F.lit(".1 Scope\n"), body))
        .when((style == 1) & (k % 3 == 1), F.concat(n, F.lit(".2 "), body))
        .when((style == 1), F.concat(F.lit("(b)\n\n"), body, F.lit("\n\nClosing remark.")))
        .when((style == 2) & (k % 2 == 0), F.concat(letter(65), F.lit(". "), t["title"], F.lit("\n"), body))
        .when((style == 2), F.concat(F.lit("("), letter(97), F.lit(") "), body))
        .when((style == 3), F.concat(t["upper"], F.lit("\n\n"), body))
        .when((style == 4) & (k == 0), F.concat(F.lit("1. "), body))
        .when((style == 4), F.concat(t["title"], F.lit(": "), body))
        .otherwise(line)
    )


def _noisy(text: Column) -> Column:
    """Typographic noise that cleaning has to undo, by document."""
    noise = F.col("doc_id") % 4
    typographic = F.replace(F.replace(F.replace(
        text, F.lit("'"), F.lit("\u2019")), F.lit(" - "), F.lit(" \u2014 ")),
        F.lit("termination"), F.lit("termi-\nnation"))
    spaced = F.replace(F.replace(text, F.lit(" the "), F.lit("  the\t")), F.lit(" your "), F.lit("\u00a0your \u200b"))
    return (
        F.when(noise == 1, spaced).when(noise == 2, typographic)
        .when(noise == 3, F.replace(text, F.lit("\n"), F.lit(" \r\n"))).otherwise(text)
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(document_id, title, raw_text)``: one contract text per document."""
    docs = table(spark, sf_dir, "documents")
    head = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("Master "), F.col("source"), F.lit(" - Terms of Service\n\n"))
    ).otherwise("")
    text = F.concat(head, F.array_join(F.transform(_lines(), _piece), "\n\n"))
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"),
        F.concat(F.col("source"), F.lit(".txt")).alias("title"),
        T.let(text, _noisy).alias("raw_text"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(document_id, page_number, text)``: three lines per page, with running lines."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("pieces", F.transform(_lines(), _piece)).withColumn(
        "n_pages", F.ceil(F.size("pieces") / 3).cast("int")
    )
    pages = rows.select(
        "doc_id", "n_pages", "pieces", F.explode(F.sequence(F.lit(1), F.greatest("n_pages", F.lit(1)))).alias("page_number")
    )
    body = F.array_join(F.slice("pieces", F.col("page_number") * 3 - 2, F.lit(3)), "\n")
    foot = F.concat(F.lit("\nPage "), F.col("page_number").cast("string"), F.lit(" of "), F.col("n_pages").cast("string"))
    doc = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return pages.select(
        doc.alias("document_id"), "page_number",
        F.concat(F.lit("Agreement "), doc, F.lit("\n"), body, foot, F.when(F.col("doc_id") % 5 == 0, "\nConfidential").otherwise("")).alias("text"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per user turn, about the document with the number of the talk."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    q = F.get(F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(t).alias("text")) for c, t in QUESTIONS
    ]), ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS)).cast("int"))
    return turns.withColumn("q", q).select(
        F.concat_ws("_", F.lit("q"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.concat(F.lit("doc_"), F.col("conv_id").cast("string")).alias("document_id"),
        F.concat(F.col("q.text"), F.lit(" "), F.trim("text")).alias("query"),
        F.col("q.category").alias("category"),
        "conv_id", "turn",
    )
