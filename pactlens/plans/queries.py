"""Every operator as a registered query over the driver tables, with its SQL oracle.

A query and the SQL that must give the same rows stand next to each other.  All of them
read whole tables; the contract tables are derived from ``documents`` (``plans.corpus``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.functions import vectors as V
from pactlens.functions.staging import scratch_folder, stage
from pactlens.operators import attention, classify, ground, metrics, pages, relate, retrieve, segment, summary
from pactlens.plans import corpus, oracles
from pactlens.plans.ingest import ingest
from pactlens.plans.oracles import lit, match, strip, words
from pactlens.sources import documents as sources
from pactlens.sources.store import DocumentStore
from pactlens.sources.text_matrix import write_matrix
from pactlens.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracles.sql(sql)
        return function

    return add


# -- shared inputs --------------------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    return sources.from_texts(corpus.raw_documents(spark, d))


def _clauses(spark, d) -> DataFrame:
    """Clauses with the category of their template, for the operators after classification."""
    return corpus.clauses(spark, d).withColumns({
        "primary_category": F.col("expected_category"),
        "secondary_categories": F.when(
            F.col("template") % 3 == 0, F.array(F.lit("Account"), F.lit("Changes"))
        ).otherwise(F.array().cast("array<string>")),
        "location": segment.location_display(F.col("source_location")),
    })


def _levelled(spark, d) -> DataFrame:
    return attention.assign_levels(_clauses(spark, d))


def _encoded(spark, d) -> DataFrame:
    return _clauses(spark, d).withColumn("vec", V.encode(F.col("text")))


def _features(spark, d) -> DataFrame:
    return relate.clause_features(_encoded(spark, d))


def _pairs(spark, d) -> DataFrame:
    return relate.candidate_pairs(_features(spark, d))


def _relationships(spark, d) -> DataFrame:
    edges = relate.strongest_edges(relate.pair_edges(_pairs(spark, d)))
    return relate.describe_edges(edges, _clauses(spark, d))


def _questions(spark, d) -> DataFrame:
    return corpus.questions(spark, d).withColumn("vec", V.encode(F.col("query")))


def _hits(spark, d) -> DataFrame:
    # A question meets clauses of its document only; Spark does not move this join below the encoding by itself.
    asked = _questions(spark, d)
    clauses = _clauses(spark, d).join(asked.select("document_id").distinct(), "document_id", "left_semi")
    return retrieve.search(asked, attention.assign_levels(clauses.withColumn("vec", V.encode(F.col("text")))))


def _relevant(spark, d) -> DataFrame:
    asked = corpus.questions(spark, d).select("query_id", "document_id", F.col("category").alias("expected_category"))
    return asked.join(_clauses(spark, d), ["document_id", "expected_category"]).select("query_id", "clause_id")


# -- sources, sinks, validity ---------------------------------------------------------


@register("s1_text_source", """
    SELECT document_id, title AS filename, 1 AS page_number, 0 AS char_start, length(raw_text)::INT AS char_end, md5(raw_text) AS raw_md5 FROM raw_docs""")
def _(spark, d):
    docs = _documents(spark, d)
    one = sources.single_pages(docs)
    return docs.select("document_id", "filename").join(one, "document_id").select(
        "document_id", "filename", "page_number", "char_start", "char_end", F.md5("text").alias("raw_md5"))


@register("s2_page_ranges", """
    SELECT document_id, page_number, (coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS char_start,
           (coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text))::INT AS char_end FROM raw_pages""")
def _(spark, d):
    return sources.page_ranges(corpus.raw_pages(spark, d)).drop("text")


@register("s2_paged_source", f"""
    SELECT document_id, md5(raw) AS raw_md5, md5({oracles.clean_space(oracles.clean_hyphens(oracles.clean_encoding('cleaned')))}) AS cleaned_md5, n::INT AS page_count
    FROM (SELECT document_id, string_agg(text, chr(10) ORDER BY page_number) AS raw, count(*) AS n FROM raw_pages GROUP BY 1)
    JOIN (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS cleaned FROM cut_pages GROUP BY 1) USING (document_id)""")
def _(spark, d):
    docs = sources.from_pages(corpus.raw_pages(spark, d))
    return docs.select("document_id", F.md5("raw_text").alias("raw_md5"), F.md5("cleaned_text").alias("cleaned_md5"), "metadata.page_count")


@register("s3_text_validity", f"""
    SELECT document_id, CASE WHEN trim(t) = '' THEN {lit(sources.NO_TEXT)} WHEN length(t) < 10 THEN {lit(sources.TOO_SHORT)} END AS reject_reason
    FROM (SELECT document_id, CASE doc_id % 10 WHEN 0 THEN '   ' WHEN 1 THEN left(raw_text, 7) ELSE raw_text END AS t FROM raw_docs)""")
def _(spark, d):
    number = F.regexp_extract("document_id", r"(\d+)", 1).cast("long") % 10
    shown = F.when(number == 0, "   ").when(number == 1, F.left("raw_text", F.lit(7))).otherwise(F.col("raw_text"))
    return sources.check_texts(corpus.raw_documents(spark, d).withColumn("raw_text", shown)).select("document_id", "reject_reason")


@register("s3_paged_validity", f"""
    SELECT 'doc_' || doc_id AS document_id, CASE WHEN doc_id % 11 = 3 THEN {lit(sources.WRONG_TYPE)} WHEN p.n IS NULL THEN {lit(sources.NO_PAGES)} WHEN p.chars = 0 THEN {lit(sources.NO_PAGE_TEXT)} END AS reject_reason
    FROM documents LEFT JOIN (SELECT document_id, count(*) AS n, sum(length({strip('text')})) AS chars FROM raw_pages GROUP BY 1) p ON p.document_id = 'doc_' || doc_id""")
def _(spark, d):
    names = corpus.table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"),
        F.when(F.col("doc_id") % 11 == 3, "terms.docx").otherwise("terms.PDF").alias("filename"))
    return sources.check_paged(corpus.raw_pages(spark, d), names).select("document_id", "reject_reason")


@register("s4_metadata", """
    SELECT document_id, 1 AS page_count, length(raw_text)::INT AS total_raw_chars, length(cleaned_text)::INT AS total_cleaned_chars FROM clean_docs""")
def _(spark, d):
    return _documents(spark, d).select("document_id", "metadata.*")


@register("s5_label_source", """
    SELECT document_id, clause_id, clause_index, expected_category AS expected_primary_category, expected_level AS expected_attention_level FROM clauses""")
def _(spark, d):
    folder = scratch_folder(spark)
    label = F.struct("document_id", "clause_id", "clause_index", F.col("expected_category").alias("expected_primary_category"), F.col("expected_level").alias("expected_attention_level"))
    # One nested record per document, as label files nest their rows.
    corpus.clauses(spark, d).groupBy("document_id").agg(F.collect_list(label).alias("clauses")).select("clauses").write.json(folder)
    return spark.read.json(folder, schema="clauses array<struct<document_id:string,clause_id:string,clause_index:int,expected_primary_category:string,expected_attention_level:string>>").select(F.inline("clauses"))


@register("s6_document_store", """
    SELECT document_id, CASE WHEN doc_id % 3 = 0 THEN md5(raw_text || ' v2') ELSE md5(raw_text) END AS raw_md5, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM raw_docs""")
def _(spark, d):
    # Three overlapping batches, one of them sent twice, and a new base in between.
    store = DocumentStore(spark, scratch_folder(spark))
    docs = corpus.raw_documents(spark, d).select("document_id", "raw_text")
    number = F.regexp_extract("document_id", r"(\d+)", 1).cast("long")
    marked = lambda mark: F.concat("raw_text", F.lit(mark))
    store.save(docs.where(number % 3 != 1).withColumn("raw_text", F.when(number % 2 == 0, marked(" v0")).otherwise(F.col("raw_text"))), 0)
    store.save(docs, 1)
    store.compact()
    for _again in range(2):
        store.save(docs.where(number % 3 == 0).withColumn("raw_text", marked(" v2")), 2)
    return store.list().select("document_id", F.md5("raw_text").alias("raw_md5"), "version")


_INGESTED = """
    SELECT l.clause_id, l.clause_index, l.section_title, md5(l.text) AS text_md5, v.attention_level, p.primary_category, p.secondary_categories, p.category_confidence,
           'Offset ' || l.start_char || '-' || l.end_char AS location
    FROM located l JOIN located_levels v USING (clause_id) JOIN located_picked p USING (clause_id)"""


def _ingested(clauses: DataFrame, *also: str) -> DataFrame:
    return clauses.select(
        *also, "clause_id", "clause_index", "section_title", F.md5("text").alias("text_md5"), "attention_level", "primary_category",
        F.array_join("secondary_categories", ", ").alias("secondary_categories"), "category_confidence", "location")


@register("s7_ingest", _INGESTED)
def ingest_documents(spark, d):
    return _ingested(ingest(_documents(spark, d)))


@register("s8_arrivals", _INGESTED)
def _(spark, d):
    shown = lambda rows: _ingested(rows, "document_id", "batch")
    return arrivals.read_clauses(spark, _arrived(spark, d), shown).drop("document_id", "batch")


def _arrived(spark, d) -> str:
    """All documents arrive, some with an older text; then those again, twice in one batch, with rejects between them."""
    folder = scratch_folder(spark)
    docs = corpus.raw_documents(spark, d).withColumn("number", F.regexp_extract("document_id", r"(\d+)", 1).cast("long"))
    old, late, text = F.concat("raw_text", F.lit(" Old words.")), F.col("number") % 3 == 0, F.col("raw_text")
    docs.withColumn("raw_text", F.when(late, old).otherwise(text)).drop("number").write.parquet(f"{folder}/in/1")
    sent = F.filter(F.array(
        F.when(late, old), F.when(F.col("number") % 10 == 0, "   "), F.when(late, text), F.when(F.col("number") % 10 == 1, F.left("raw_text", F.lit(7)))
    ), lambda t: t.isNotNull())
    docs.select("document_id", "title", F.explode(sent).alias("raw_text")).write.parquet(f"{folder}/in/2")
    # The first sending is the first batch, in as many files as the table has splits.
    sending = max(1, len(spark.read.parquet(f"{folder}/in/1").inputFiles()))
    query = arrivals.ingest_stream(arrivals.arriving_texts(spark, f"{folder}/in/*", sending), f"{folder}/out", f"{folder}/log")
    query.awaitTermination()
    return f"{folder}/out"


@register("s8_quarantine", f"""
    SELECT document_id, CASE doc_id % 10 WHEN 0 THEN {lit(sources.NO_TEXT)} ELSE {lit(sources.TOO_SHORT)} END AS reject_reason
    FROM raw_docs WHERE doc_id % 10 < 2 AND (doc_id % 10 = 0 OR trim(left(raw_text, 7)) <> '') UNION ALL
    SELECT document_id, {lit(sources.NO_TEXT)} FROM raw_docs WHERE doc_id % 10 = 1 AND trim(left(raw_text, 7)) = '' UNION ALL
    SELECT document_id, CASE WHEN trim(raw_text) = '' THEN {lit(sources.NO_TEXT)} ELSE {lit(sources.TOO_SHORT)} END
    FROM raw_docs WHERE trim(raw_text) = '' OR length(raw_text) < 10""")
def _(spark, d):
    return arrivals.read_rejects(spark, _arrived(spark, d)).select("document_id", "reject_reason")


@register("s9_result_sink", """
    SELECT expected_category AS label, count(*) AS n FROM clauses GROUP BY 1""")
def _(spark, d):
    folder = scratch_folder(spark)
    sources.write_metrics(metrics.label_distribution(_clauses(spark, d), "expected_category").select("label", "n"), folder)
    return spark.read.json(folder, schema="label string, n long")


# -- cleaning -------------------------------------------------------------------------


def _cleaning(name: str, source: str, sql: str, column):
    @register(name, f"SELECT document_id, md5(t) AS text_md5, length(t)::INT AS n_chars FROM (SELECT document_id, {sql} AS t FROM {source})")
    def _(spark, d):
        rows = corpus.raw_documents(spark, d).select("document_id", column(F.col("raw_text")).alias("t"))
        return rows.select("document_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


_cleaning("c1_encoding", "raw_docs", oracles.clean_encoding("raw_text"), T.normalize_encoding)
_cleaning("c2_hyphens", "raw_docs", oracles.clean_hyphens("raw_text"), T.reconnect_hyphenated)
_cleaning("c3_whitespace", "raw_docs", oracles.clean_space("raw_text"), T.normalize_whitespace)
_cleaning("c4_clean_text", "clean_docs", "cleaned_text", T.clean_text)
_cleaning("c6_matching_form", "raw_docs", oracles.matching("raw_text"), T.matching_form)


@register("c5_running_lines", "SELECT document_id, page_number, md5(text) AS text_md5 FROM cut_pages")
def _(spark, d):
    return pages.remove_running_lines(corpus.raw_pages(spark, d)).select("document_id", "page_number", F.md5("text").alias("text_md5"))


# -- segmentation ---------------------------------------------------------------------


def _lines(spark, d) -> DataFrame:
    return segment.document_lines(_documents(spark, d).select("document_id", "cleaned_text"))


def _resolved(spark, d) -> DataFrame:
    return segment.resolve_long_headings(segment.mark_title_prefix(segment.line_kinds(_lines(spark, d))))


@register("g1_lines", "SELECT document_id, pos::INT AS pos, md5(line) AS line_md5 FROM doc_lines")
def _(spark, d):
    return _lines(spark, d).select("document_id", "pos", F.md5("line").alias("line_md5"))


@register("g2_line_kinds", "SELECT document_id, pos::INT AS pos, kind FROM kinds")
def _(spark, d):
    return segment.line_kinds(_lines(spark, d)).select("document_id", "pos", "kind")


@register("g3_document_title", "SELECT document_id, max_by(line, pos) AS document_title FROM prefixed WHERE in_prefix AND is_title GROUP BY 1")
def _(spark, d):
    return segment.document_titles(_documents(spark, d).select("document_id", "cleaned_text"))


@register("g4_headings", "SELECT document_id, pos::INT AS pos, block, major, sub FROM carried WHERE body IS NOT NULL")
def _(spark, d):
    return segment.carry_headings(_resolved(spark, d)).where("body is not null").select("document_id", "pos", "block", "major", "sub")


@register("g5_long_headings", "SELECT document_id, pos::INT AS pos, kind FROM resolved")
def _(spark, d):
    return _resolved(spark, d).select("document_id", "pos", "kind")


@register("g6_blocks", "SELECT document_id, block, md5(body) AS body_md5 FROM blocks")
def _(spark, d):
    return segment.blocks_of(_documents(spark, d)).select("document_id", "block", F.md5("body").alias("body_md5"))


@register("g7_section_titles", "SELECT document_id, block, section_title FROM blocks")
def _(spark, d):
    return segment.blocks_of(_documents(spark, d)).select("document_id", "block", "section_title")


@register("g8_long_paragraphs", f"SELECT document_id, block, (chunk - 1)::INT AS chunk, md5({strip('text')}) AS text_md5, {words('text')}::INT AS n_words FROM chunks")
def _(spark, d):
    blocks = segment.blocks_of(_documents(spark, d))
    rows = blocks.select("document_id", "block", F.posexplode(segment.split_long(F.col("body"))).alias("chunk", "text"))
    return rows.select("document_id", "block", "chunk", F.md5("text").alias("text_md5"), T.words(F.col("text")).alias("n_words"))


@register("g9_paragraphs", "SELECT document_id, section_title, md5(text) AS text_md5 FROM paragraphs")
def _(spark, d):
    rows = _documents(spark, d).select("document_id", F.inline(segment.paragraphs(F.col("cleaned_text"))))
    return rows.select("document_id", "section_title", F.md5("text").alias("text_md5"))


@register("g10_clause_ids", "SELECT document_id, clause_index, clause_id, section_title, md5(text) AS text_md5 FROM segments")
def _(spark, d):
    return segment.segment(_documents(spark, d)).select("document_id", "clause_index", "clause_id", "section_title", F.md5("text").alias("text_md5"))


@register("g11_source_location", "SELECT clause_id, start_char, end_char FROM located")
def _(spark, d):
    return segment.segment(_documents(spark, d)).select("clause_id", "source_location.start_char", "source_location.end_char")


@register("g11_page_location", """
    SELECT clause_id, CASE WHEN found AND last_page <> first_page THEN printf('Pages %d-%d', first_page, last_page) ELSE printf('Page %d', first_page) END
           || printf(' (chars %d-%d)', start_char, end_char) AS location FROM on_pages""")
def _(spark, d):
    paged = corpus.raw_pages(spark, d)
    found = segment.segment(sources.from_pages(paged), sources.page_ranges(paged))
    return found.select("clause_id", segment.location_display(F.col("source_location")).alias("location"))


@register("g12_location_display", "SELECT clause_id, location FROM clauses")
def _(spark, d):
    return _clauses(spark, d).select("clause_id", "location")


# -- classification -------------------------------------------------------------------

_CATEGORY_HITS = "[" + ", ".join(oracles.keyword_hits("text", c) for c in rules.CATEGORIES) + "]"


@register("k1_keyword_hits", f"SELECT clause_id, array_to_string({_CATEGORY_HITS}, ',') AS hits FROM clauses")
def _(spark, d):
    hits = classify.keyword_hits(F.col("text"))
    return _clauses(spark, d).select("clause_id", F.array_join(hits.cast("array<string>"), ",").alias("hits"))


_PRINT = "round(list_sum(list_transform(vec, lambda x, i: x::DOUBLE * i)), 5)"


def _print(vec):
    """A number that depends on every dimension of a vector."""
    return F.round(F.aggregate(F.transform(vec, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5)


@register("k2_text_vectors", f"SELECT clause_id, {_PRINT} AS fingerprint FROM clause_vec")
def _(spark, d):
    return _encoded(spark, d).select("clause_id", _print(F.col("vec")).alias("fingerprint"))


@register("k4_cosine", f"SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = corpus.table(spark, d, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(following, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@register("k5_semantic_scores", "SELECT clause_id, pos::INT AS pos, round(semantic, 6) AS semantic FROM scores")
def _(spark, d):
    matrix, groups = classify.seed_vectors()
    rows = _encoded(spark, d).withColumn("s", V.max_similarity(F.col("vec"), matrix, groups))
    return rows.select("clause_id", F.posexplode("s").alias("pos", "semantic")).withColumn("semantic", F.round("semantic", 6))


@register("k6_hybrid_scores", "SELECT clause_id, pos::INT AS pos, round(score, 6) AS score FROM scores")
def _(spark, d):
    rows = classify.category_scores(_encoded(spark, d)).select("clause_id", F.inline("scores"))
    return rows.select("clause_id", "pos", F.round(-F.col("minus"), 6).alias("score"))


@register("k7_primary_category", "SELECT clause_id, primary_category, category_confidence FROM picked")
def _(spark, d):
    return classify.classify(_encoded(spark, d)).select("clause_id", "primary_category", "category_confidence")


@register("k8_secondary_categories", "SELECT clause_id, secondary_categories FROM picked")
def _(spark, d):
    return classify.classify(_encoded(spark, d)).select("clause_id", F.array_join("secondary_categories", ", ").alias("secondary_categories"))


@register("k9_classify", "SELECT * FROM picked")
def _(spark, d):
    return classify.classify(_encoded(spark, d)).select(
        "clause_id", "primary_category", F.array_join("secondary_categories", ", ").alias("secondary_categories"), "category_confidence")


# -- attention ------------------------------------------------------------------------


@register("t1_strong_indicators", f"SELECT clause_id, array_to_string({oracles.reasons('text', rules.STRONG_INDICATORS)}, '; ') AS reasons FROM clauses")
def _(spark, d):
    return _clauses(spark, d).select("clause_id", F.array_join(attention.strong_reasons(F.col("text")), "; ").alias("reasons"))


@register("t2_weak_indicators", f"SELECT clause_id, array_to_string({oracles.reasons('text', rules.WEAK_INDICATORS)}, '; ') AS reasons FROM clauses")
def _(spark, d):
    return _clauses(spark, d).select("clause_id", F.array_join(attention.weak_reasons(F.col("text")), "; ").alias("reasons"))


@register("t3_attention_level", "SELECT clause_id, attention_level FROM levelled")
def _(spark, d):
    return _levelled(spark, d).select("clause_id", "attention_level")


@register("t4_assign_levels", "SELECT clause_id, attention_level, array_to_string(attention_reasons, '; ') AS attention_reasons FROM levelled")
def _(spark, d):
    return _levelled(spark, d).select("clause_id", "attention_level", F.array_join("attention_reasons", "; ").alias("attention_reasons"))


# -- retrieval ------------------------------------------------------------------------


@register("r1_index", """
    SELECT vec_id, round(sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x))), 5) AS norm, round(list_sum(list_transform(vec, lambda x, i: x::DOUBLE * i)), 4) AS fingerprint
    FROM (SELECT vec_id, list_transform(embedding, lambda x: (x / n)::FLOAT) AS vec FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n
          FROM (SELECT vec_id, list_transform(embedding, lambda x: (x * (vec_id % 5 + 1))::FLOAT) AS embedding FROM embeddings)))""")
def _(spark, d):
    rows = corpus.table(spark, d, "embeddings").select(
        "vec_id", V.normalize(F.transform("embedding", lambda x: (x * (F.col("vec_id") % 5 + 1)).cast("float"))).alias("vec"))
    return rows.select(
        "vec_id", F.round(F.sqrt(V.cosine(F.col("vec"), F.col("vec"))), 5).alias("norm"),
        F.round(F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("fingerprint"))


@register("r2_query_tokens", "SELECT query_id, array_to_string(tokens, ' ') AS tokens FROM query_words")
def _(spark, d):
    return corpus.questions(spark, d).select("query_id", F.array_join(retrieve.query_tokens(F.col("query")), " ").alias("tokens"))


@register("r3_synonyms", "SELECT query_id, array_to_string(list_sort(synonyms), ', ') AS synonyms FROM query_synonyms")
def _(spark, d):
    found = retrieve.synonym_tokens(retrieve.query_tokens(F.col("query")))
    return corpus.questions(spark, d).select("query_id", F.array_join(F.array_sort(found), ", ").alias("synonyms"))


@register("r4_vector_candidates", "SELECT query_id, clause_index, candidate_rank::INT AS candidate_rank, round(base_score, 6) AS base_score FROM candidates")
def _(spark, d):
    queries = _questions(spark, d).withColumn("top_k", F.lit(rules.RETRIEVAL_TOP_K))
    found = retrieve.vector_candidates(queries, V.index_blocks(_encoded(spark, d)))
    return found.select("query_id", "clause_index", "candidate_rank", F.round("base_score", 6).alias("base_score"))


@register("r5_category_filter", """
    SELECT query_id, clause_id, similarity_score, n::INT AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, candidate_rank) AS n
          FROM (SELECT b.*, printf('%.4f', least(1, base_score + boost))::DOUBLE AS similarity_score FROM boosted b JOIN questions q USING (query_id)
                WHERE b.primary_category = q.category OR list_contains(b.secondary_categories, q.category))) WHERE n <= 5""")
def _(spark, d):
    queries = _questions(spark, d).withColumn("categories", F.array("category"))
    return retrieve.search(queries, _encoded(spark, d)).select("query_id", "clause_id", "similarity_score", "rank")


@register("r6_lexical_boost", "SELECT query_id, clause_id, round(boost, 6) AS boost FROM boosted")
def _(spark, d):
    asked = corpus.questions(spark, d).withColumn("tokens", retrieve.query_tokens(F.col("query")))
    asked = asked.withColumn("synonyms", retrieve.synonym_tokens(F.col("tokens"))).withColumn("vec", V.encode(F.col("query")))
    found = retrieve.vector_candidates(asked.withColumn("top_k", F.lit(5)), V.index_blocks(_encoded(spark, d)))
    rows = found.join(asked.select("query_id", "tokens", "synonyms"), "query_id").join(_clauses(spark, d), ["document_id", "clause_index"])
    boost = retrieve.lexical_boost(F.col("section_title"), F.col("text"), F.col("tokens"), F.col("synonyms"))
    return rows.select("query_id", "clause_id", F.round(boost, 6).alias("boost"))


@register("r7_search", "SELECT query_id, clause_id, similarity_score, rank, meets_threshold FROM hits")
def search_clauses(spark, d):
    return _hits(spark, d).select("query_id", "clause_id", "similarity_score", "rank", "meets_threshold")


@register("r8_query_results", "SELECT query_id, sufficient_evidence, total_matches FROM query_results")
def _(spark, d):
    return retrieve.query_results(corpus.questions(spark, d), _hits(spark, d)).select("query_id", "sufficient_evidence", "total_matches")


def _shifted(spark, d) -> DataFrame:
    """Questions about documents some of which do not exist."""
    size = corpus.table(spark, d, "documents").count()
    number = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("conv_id") + size).otherwise(F.col("conv_id"))
    return corpus.questions(spark, d).withColumn("document_id", F.concat(F.lit("doc_"), number.cast("string")))


@register("r9_missing_documents", """
    SELECT query_id, document_id FROM (SELECT query_id, 'doc_' || CASE WHEN (conv_id + turn) % 3 = 0 THEN conv_id + (SELECT count(*) FROM documents) ELSE conv_id END AS document_id FROM questions)
    WHERE document_id NOT IN (SELECT document_id FROM clauses)""")
def _(spark, d):
    return retrieve.missing_documents(_shifted(spark, d), _clauses(spark, d)).select("query_id", "document_id")


@register("r10_request_limits", """
    SELECT query_id, CASE WHEN turn % 4 = 0 THEN 'query too short' WHEN (conv_id + turn) % 60 NOT BETWEEN 1 AND 50 THEN 'top_k out of range' END AS reject_reason FROM questions""")
def _(spark, d):
    queries = corpus.questions(spark, d).withColumns({
        "query": F.when(F.col("turn") % 4 == 0, F.left("query", F.lit(1))).otherwise(F.col("query")),
        "top_k": (F.col("conv_id") + F.col("turn")) % 60})
    return retrieve.check_queries(queries).select("query_id", "reject_reason")


# -- relationships --------------------------------------------------------------------


@register("x1_isolation", """
    SELECT relationship_id, document_id, clause_id FROM (
        SELECT relationship_id, document_id, unnest([CASE WHEN rank % 3 = 1 THEN 'doc_0_clause_001' ELSE source_clause_id END, CASE WHEN rank % 5 = 2 THEN 'none' ELSE target_clause_id END]) AS clause_id
        FROM relationships) r
    WHERE NOT EXISTS (SELECT 1 FROM clauses c WHERE c.document_id = r.document_id AND c.clause_id = r.clause_id)""")
def _(spark, d):
    # Some ends are led to a clause of another document or to none; the operator has to find exactly those.
    found = _relationships(spark, d).withColumns({
        "source_clause_id": F.when(F.col("rank") % 3 == 1, "doc_0_clause_001").otherwise(F.col("source_clause_id")),
        "target_clause_id": F.when(F.col("rank") % 5 == 2, "none").otherwise(F.col("target_clause_id"))})
    return relate.isolation_violations(_clauses(spark, d), found).select("relationship_id", "document_id", "clause_id")


@register("r1_blocks", """
    SELECT document_id, block, count(*)::INT AS n, min(clause_index) AS first, max(clause_index) AS last, round(sum(fingerprint), 3) AS fingerprint
    FROM (SELECT document_id, ((clause_index - 1) // 6)::INT AS block, clause_index, list_sum(list_transform(vec, lambda x, i: x::DOUBLE * i)) * clause_index AS fingerprint
          FROM clauses JOIN clause_vec USING (clause_id)) GROUP BY 1, 2""")
def _(spark, d):
    # The index itself, in blocks of six clauses: what it holds, in which order.
    dim = F.col("dim")
    part = lambda r, k: F.aggregate(
        F.transform(F.slice(F.col("flat"), k * dim + 1, dim), lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x) * r["i"]
    return V.index_blocks(_encoded(spark, d), size=6).select(
        "document_id", "block", F.size("rows").alias("n"), F.get("rows", F.lit(0))["i"].alias("first"), F.element_at("rows", -1)["i"].alias("last"),
        F.round(F.aggregate(F.transform("rows", part), F.lit(0.0), lambda s, x: s + x), 3).alias("fingerprint"))


@register("x2_section_index", "SELECT document_id, sec, owner AS clause_index FROM owners")
def _(spark, d):
    return relate.section_owners(relate.clause_features(_clauses(spark, d)))


@register("x3_section_references", "SELECT clause_id, array_to_string(refs, ',') AS refs FROM features WHERE len(refs) > 0")
def _(spark, d):
    return relate.clause_features(_clauses(spark, d)).where(F.size("refs") > 0).select("clause_id", F.array_join("refs", ",").alias("refs"))


@register("x4_domain_keywords", "SELECT clause_id, array_to_string(kws, ',') AS keywords FROM features")
def _(spark, d):
    rows = _clauses(spark, d).withColumn("lower", F.lower("text")).withColumn("kw", relate.keyword_mask(F.col("lower")))
    return rows.select("clause_id", F.array_join(relate.keywords_of(F.col("kw")), ",").alias("keywords"))


@register("x5_pair_scores", "SELECT document_id, i, j, round(score, 6) AS score FROM clause_cut")
def _(spark, d):
    pairs = relate.candidate_pairs(_features(spark, d), per_document=1 << 30)
    return pairs.select("document_id", "i", "j", F.round("score", 6).alias("score"))


def _reason(name: str, start: str):
    @register(name, f"""
        SELECT document_id, i, j, array_to_string(list_filter(reasons, lambda r: starts_with(r, {lit(start)})), '; ') AS reason
        FROM pairs WHERE len(list_filter(reasons, lambda r: starts_with(r, {lit(start)}))) > 0""")
    def _(spark, d):
        found = relate.candidate_reasons(_pairs(spark, d)).withColumn("r", F.filter("reasons", lambda r: r.startswith(start)))
        return found.where(F.size("r") > 0).select("document_id", "i", "j", F.array_join("r", "; ").alias("reason"))


_reason("x6_cross_reference", "Explicit cross-reference")
_reason("x7_category_signal", "Shared category")
_reason("x7_affinity_signal", "High-affinity")
_reason("x8_shared_keywords", "Shared domain concepts")
_reason("x9_semantic_signal", "Semantic similarity")
_reason("x10_cancel_tension_signal", "Cancellation")
_reason("x10_modify_tension_signal", "Modification")
_reason("x11_temporal_signal", "Both clauses")
_reason("x12_exception_signal", "Exception")
_reason("x12_proviso_signal", "Qualifying")
_reason("x13_small_document", "Document-level")


@register("x14_candidate_reasons", "SELECT document_id, i, j, array_to_string(reasons, '; ') AS reasons FROM pairs")
def _(spark, d):
    return relate.candidate_reasons(_pairs(spark, d)).select("document_id", "i", "j", F.array_join("reasons", "; ").alias("reasons"))


@register("x15_clause_cap", """
    SELECT document_id, i, j, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY document_id, i ORDER BY score DESC, j) AS k FROM pair_scores WHERE score >= 0.25 OR n <= 5) WHERE k <= 3""")
def _(spark, d):
    pairs = relate.candidate_pairs(_features(spark, d), per_clause=3, per_document=1 << 30)
    return pairs.select("document_id", "i", "j", F.round("score", 6).alias("score"))


@register("x16_candidate_pairs", "SELECT document_id, i, j, round(score, 6) AS score, candidate_rank FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("document_id", "i", "j", F.round("score", 6).alias("score"), "candidate_rank")


@register("x16_block_merge", "SELECT document_id, i, j, round(score, 6) AS score, candidate_rank FROM pairs")
def _(spark, d):
    # Blocks of six clauses: nearly every document is ranked across several blocks.
    pairs = relate.candidate_pairs(_features(spark, d), block=6)
    return pairs.select("document_id", "i", "j", F.round("score", 6).alias("score"), "candidate_rank")


@register("x17_topical_affinity", "SELECT document_id, i, j, near FROM ways WHERE NOT reverse")
def _(spark, d):
    return _pairs(spark, d).select("document_id", "i", "j", relate.has_affinity(F.col("a"), F.col("b")).alias("near"))


def _chosen(spark, d) -> DataFrame:
    """The clauses of a request that leaves the general ones out: their indexes have gaps."""
    return _clauses(spark, d).where(F.col("primary_category") != rules.GENERAL)


def _chosen_features(spark, d) -> DataFrame:
    return relate.clause_features(_chosen(spark, d).withColumn("vec", V.encode(F.col("text"))))


@register("x5_gapped_pairs", "SELECT document_id, i, j, round(score, 6) AS score FROM chosen_clause_cut")
def _(spark, d):
    pairs = relate.candidate_pairs(_chosen_features(spark, d), per_document=None)
    return pairs.select("document_id", "i", "j", F.round("score", 6).alias("score"))


@register("x16_gapped_pairs", "SELECT document_id, i, j, round(score, 6) AS score, candidate_rank FROM chosen_pairs")
def _(spark, d):
    # Ranges of six indexes hold few of the chosen clauses each and are joined to blocks.
    pairs = relate.candidate_pairs(_chosen_features(spark, d), block=6)
    return pairs.select("document_id", "i", "j", F.round("score", 6).alias("score"), "candidate_rank")


@register("x17_gapped_affinity", "SELECT document_id, i, j, near FROM chosen_ways WHERE NOT reverse")
def _(spark, d):
    pairs = relate.candidate_pairs(_chosen_features(spark, d))
    return pairs.select("document_id", "i", "j", relate.has_affinity(F.col("a"), F.col("b")).alias("near"))


def _typed(name: str, type_: str):
    @register(name, f"SELECT relationship_id, source_clause_id, target_clause_id, confidence, trigger FROM relationships WHERE relationship_type = {lit(type_)}")
    def _(spark, d):
        return _relationships(spark, d).where(F.col("relationship_type") == type_).select(
            "relationship_id", "source_clause_id", "target_clause_id", "confidence", "evidence.trigger")


_typed("x18_overrides", "OVERRIDES")
_typed("x19_excepts", "EXCEPTS")
_typed("x20_depends_on", "DEPENDS_ON")
_typed("x21_qualifies", "QUALIFIES")
_typed("x22_temporal", "TEMPORAL")
_typed("x23_supports", "SUPPORTS")
_typed("x24_tension", "POTENTIAL_TENSION")


@register("x25_pair_rules", "SELECT document_id, i, j, type, reverse, confidence FROM edges")
def _(spark, d):
    edges = relate.pair_edges(_pairs(spark, d))
    return edges.select("document_id", F.least("src", "tgt").alias("i"), F.greatest("src", "tgt").alias("j"), "type", "reverse", "confidence")


@register("x26_clause_labels", "SELECT clause_id, label FROM features")
def _(spark, d):
    label = relate.clause_label(F.col("clause_index"), F.col("section_title"), F.col("primary_category"))
    return _clauses(spark, d).select("clause_id", label.alias("label"))


@register("x27_rationale", "SELECT relationship_id, rationale, trigger, md5(s_text) AS source_md5, md5(t_text) AS target_md5, s_loc AS source_location, t_loc AS target_location FROM relationships")
def _(spark, d):
    return _relationships(spark, d).select(
        "relationship_id", "rationale", "evidence.trigger", F.md5("evidence.source_text").alias("source_md5"), F.md5("evidence.target_text").alias("target_md5"),
        segment.location_display(F.col("source_location")).alias("source_location"), segment.location_display(F.col("target_location")).alias("target_location"))


@register("x29_min_confidence", "SELECT document_id, i, j, type, reverse FROM edges WHERE confidence >= 0.79")
def _(spark, d):
    edges = relate.pair_edges(_pairs(spark, d), 0.79)
    return edges.select("document_id", F.least("src", "tgt").alias("i"), F.greatest("src", "tgt").alias("j"), "type", "reverse")


@register("x31_relationships", "SELECT relationship_id, document_id, source_clause_id, target_clause_id, relationship_type, confidence, rank FROM relationships")
def relationships(spark, d):
    return relate.detect_relationships(_clauses(spark, d)).select(
        "relationship_id", "document_id", "source_clause_id", "target_clause_id", "relationship_type", "confidence", "rank")


@register("x32_run_metadata", "SELECT document_id, count(*) AS candidate_pairs, count(*) AS evaluated_pairs FROM pairs GROUP BY 1")
def _(spark, d):
    return relate.run_metadata(_pairs(spark, d))


@register("x33_chosen_clauses", "SELECT relationship_id, document_id, source_clause_id, target_clause_id, relationship_type, confidence, rank FROM chosen_relationships")
def _(spark, d):
    return relate.detect_relationships(_chosen(spark, d)).select(
        "relationship_id", "document_id", "source_clause_id", "target_clause_id", "relationship_type", "confidence", "rank")


@register("x33_request_limits", """
    SELECT query_id, CASE WHEN (conv_id + turn) * 9 NOT BETWEEN 1 AND 500 THEN 'max_relationships out of range' WHEN turn / 5.0 NOT BETWEEN 0 AND 1 THEN 'min_confidence out of range' END AS reject_reason FROM questions""")
def _(spark, d):
    asked = corpus.questions(spark, d).withColumns({"max_relationships": (F.col("conv_id") + F.col("turn")) * 9, "min_confidence": F.col("turn") / 5.0})
    return relate.check_limits(asked).select("query_id", "reject_reason")


# -- questions, payloads, grounding ---------------------------------------------------


@register("q1_question_validity", f"""
    SELECT query_id, CASE WHEN q = '' THEN 'Question cannot be empty or contain only whitespace.' WHEN length(q) > 1000 THEN 'Question exceeds maximum length of 1000 characters.'
           WHEN k NOT BETWEEN 1 AND 10 THEN 'top_k out of range' WHEN t NOT BETWEEN 0 AND 1 THEN 'threshold out of range' END AS reject_reason
    FROM (SELECT query_id, CASE WHEN turn % 8 = 6 THEN '' ELSE {strip('query')} END AS q, 1 + (conv_id * 3 + turn) % 12 AS k, (conv_id + turn) % 13 / 10.0 AS t FROM questions)""")
def _(spark, d):
    asked = corpus.questions(spark, d).select(
        "query_id", F.when(F.col("turn") % 8 == 6, " \t ").otherwise(F.col("query")).alias("question"),
        ((F.col("conv_id") * 3 + F.col("turn")) % 12 + 1).alias("top_k"), ((F.col("conv_id") + F.col("turn")) % 13 / 10.0).alias("threshold"))
    return ground.check_questions(asked).select("query_id", "reject_reason")


@register("q2_abstention", f"""
    SELECT query_id, 'insufficient_evidence' AS status, NULL::VARCHAR AS answer, 0.0::DOUBLE AS confidence, {lit(rules.INSUFFICIENT)} AS uncertainty FROM query_results WHERE NOT sufficient_evidence""")
def _(spark, d):
    return ground.abstention_gate(retrieve.query_results(corpus.questions(spark, d), _hits(spark, d)))


@register("q3_evidence", "SELECT query_id, rank, clause_id, similarity_score FROM hits WHERE meets_threshold")
def _(spark, d):
    return ground.evidence_rows(_hits(spark, d)).select("query_id", "rank", "clause_id", "similarity_score")


_EVIDENCE = "struct<question:string,evidence:array<struct<clause_id:string,section_title:string,text:string,category:string,attention_level:string,source_location:string,similarity_score:double>>>"


@register("q4_question_payload", """
    SELECT h.query_id, md5(q.query) AS question_md5, h.rank - 1 AS pos, h.clause_id, h.section_title, md5(h.text) AS text_md5, h.primary_category AS category, h.attention_level, h.location AS source_location,
           printf('%.3f', h.similarity_score)::DOUBLE AS similarity_score FROM hits h JOIN questions q USING (query_id) WHERE h.meets_threshold""")
def _(spark, d):
    rows = ground.question_payloads(corpus.questions(spark, d), ground.evidence_rows(_hits(spark, d)))
    rows = rows.select("query_id", F.from_json("payload", _EVIDENCE).alias("p"))
    rows = rows.select("query_id", F.md5("p.question").alias("question_md5"), F.posexplode("p.evidence").alias("pos", "e"))
    return rows.select("query_id", "question_md5", "pos", "e.clause_id", "e.section_title", F.md5("e.text").alias("text_md5"), "e.category", "e.attention_level", "e.source_location", "e.similarity_score")


@register("q5_clause_payload", """
    SELECT clause_id, 'EXPLAIN_CLAUSE' AS task, section_title, primary_category AS category, attention_level, array_to_string(attention_reasons, ', ') AS attention_indicators, location AS source_location, md5(text) AS text_md5 FROM levelled""")
def _(spark, d):
    inner = "struct<task:string,clause:struct<clause_id:string,section_title:string,category:string,attention_level:string,attention_indicators:string,source_location:string,text:string>>"
    rows = ground.clause_payloads(_levelled(spark, d)).select("clause_id", F.from_json("payload", inner).alias("p"))
    return rows.select("clause_id", "p.task", "p.clause.section_title", "p.clause.category", "p.clause.attention_level", "p.clause.attention_indicators", "p.clause.source_location", F.md5("p.clause.text").alias("text_md5"))


@register("q6_relationship_payload", """
    SELECT r.relationship_id, r.relationship_type, r.rationale, r.trigger, s.section_title AS source_title, t.attention_level AS target_level, md5(t.text) AS target_md5
    FROM relationships r JOIN levelled s ON s.clause_id = r.source_clause_id JOIN levelled t ON t.clause_id = r.target_clause_id""")
def _(spark, d):
    side = "struct<clause_id:string,section_title:string,category:string,attention_level:string,source_location:string,text:string>"
    inner = f"struct<task:string,relationship_type:string,rationale:string,trigger:string,source_clause:{side},target_clause:{side}>"
    rows = ground.relationship_payloads(_relationships(spark, d), _levelled(spark, d))
    rows = rows.select("relationship_id", F.from_json("payload", inner).alias("p"))
    return rows.select("relationship_id", "p.relationship_type", "p.rationale", "p.trigger", F.col("p.source_clause.section_title").alias("source_title"), F.col("p.target_clause.attention_level").alias("target_level"), F.md5("p.target_clause.text").alias("target_md5"))


_PRIORITY = """
    SELECT document_id, clause_id, n::INT AS priority
    FROM (SELECT document_id, clause_id, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN many THEN CASE attention_level WHEN 'High Attention' THEN 1 WHEN 'Medium Attention' THEN 2 WHEN 'Low Attention' THEN 3 ELSE 4 END ELSE 0 END, clause_index) AS n
          FROM (SELECT *, count(*) OVER (PARTITION BY document_id) > 20 AS many FROM levelled)) WHERE n <= 20"""


@register("q7_synthesis_payload", f"""
    SELECT document_id, p.n_clauses, coalesce(r.n, 0)::INT AS n_relationships, p.clause_ids, coalesce(r.ids, '') AS relationship_ids
    FROM (SELECT document_id, count(*)::INT AS n_clauses, string_agg(clause_id, ',' ORDER BY priority) AS clause_ids FROM ({_PRIORITY}) GROUP BY 1) p
    LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(relationship_id, ',' ORDER BY rank) AS ids FROM relationships WHERE rank <= 15 GROUP BY 1) r USING (document_id)""")
def _(spark, d):
    inner = "struct<task:string,user_concerns:array<string>,clauses:array<struct<clause_id:string>>,relationships:array<struct<relationship_id:string>>>"
    rows = ground.synthesis_payloads(_levelled(spark, d), _relationships(spark, d), ["Payment"])
    rows = rows.select("document_id", F.from_json("payload", inner).alias("p"))
    return rows.select(
        "document_id", F.size("p.clauses").alias("n_clauses"), F.size("p.relationships").alias("n_relationships"),
        F.array_join(F.col("p.clauses.clause_id"), ",").alias("clause_ids"), F.array_join(F.col("p.relationships.relationship_id"), ",").alias("relationship_ids"))


@register("q8_prioritized_clauses", _PRIORITY)
def _(spark, d):
    return ground.prioritized_clauses(_levelled(spark, d)).select("document_id", "clause_id", "priority")


@register("q9_top_relationships", "SELECT document_id, relationship_id, rank FROM relationships WHERE rank <= 15")
def _(spark, d):
    return ground.top_relationships(_relationships(spark, d)).select("document_id", "relationship_id", "rank")


def _wanted(spark, d) -> DataFrame:
    """Requested clauses: the one that follows each clause of a fixed template, real or not."""
    rows = _clauses(spark, d).where("template = 5")
    return rows.select("document_id", F.format_string("%s_clause_%03d", "document_id", F.col("clause_index") + 1).alias("clause_id"))


_WANTED = "(SELECT document_id, document_id || '_clause_' || printf('%03d', clause_index + 1) AS clause_id FROM clauses WHERE tmpl = 5)"


@register("q10_clause_subset", f"SELECT document_id, clause_id FROM clauses WHERE clause_id IN (SELECT clause_id FROM {_WANTED})")
def _(spark, d):
    return ground.clause_subset(_clauses(spark, d), _wanted(spark, d)).select("document_id", "clause_id")


@register("q10_empty_requests", f"SELECT DISTINCT document_id FROM {_WANTED} WHERE document_id NOT IN (SELECT document_id FROM clauses WHERE clause_id IN (SELECT clause_id FROM {_WANTED}))")
def _(spark, d):
    return ground.empty_requests(_clauses(spark, d), _wanted(spark, d))


_QUOTE = "CASE WHEN length(string_split(text, '.')[1]) > 10 THEN string_split(text, '.')[1] ELSE left(text, 50) END"


@register("q11_quotes", f"SELECT clause_id, {_QUOTE} AS quote FROM clauses")
def _(spark, d):
    return _clauses(spark, d).select("clause_id", ground.extractive_quote(F.col("text")).alias("quote"))


def _answers(spark, d, hits) -> DataFrame:
    """Answers from the talks: the reply to a question, citing its two best clauses.

    The number of talk and turn decides which fault the citations have, if any.
    """
    kind = (F.col("conv_id") + F.col("turn")) % 8
    cited = ground.evidence_rows(hits).where("rank <= 2").join(corpus.questions(spark, d).select("query_id", "conv_id", "turn"), "query_id")
    quote = ground.extractive_quote(F.col("text"))
    source = F.struct(
        F.when(kind == 2, F.concat("clause_id", F.lit("x"))).otherwise(F.col("clause_id")).alias("clause_id"),
        F.when(kind == 4, "Other title").when(kind == 6, "").otherwise(F.col("section_title")).alias("section_title"),
        F.when(kind == 3, "Page 999").when(kind == 6, "").otherwise(F.upper("location")).alias("source_location"),
        F.when(kind == 1, F.concat(F.lit("we promise "), F.left("text", F.lit(30)))).when(kind == 5, " ... ")
        .otherwise(F.concat(F.lit('"'), F.upper(quote), F.lit('..."'))).alias("quoted_text"))
    sources_ = cited.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))), lambda x: x["s"]).alias("sources"))
    replies = corpus.table(spark, d, "conversations").where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    asked = corpus.questions(spark, d).join(replies, ["conv_id", "turn"], "left").join(sources_, "query_id")
    said = F.when(kind == 7, F.concat(F.coalesce("reply", F.lit("")), F.lit(" That term is clearly illegal."))).otherwise(F.col("reply"))
    return asked.select(
        F.col("query_id").alias("answer_id"), "document_id", said.alias("answer"), F.lit(True).alias("evidence_sufficient"),
        F.lit(0.85).alias("confidence"), "sources", F.lit("").alias("uncertainty"))


def _supplied(hits) -> DataFrame:
    return ground.evidence_rows(hits).select(F.col("query_id").alias("answer_id"), "clause_id", "section_title", "location", "text")


oracles.PARTS["cited"] = f"""
    SELECT query_id AS answer_id, rank - 1 AS pos, section_title AS true_title, location AS true_location, text AS true_text, clause_id AS true_id, v,
           clause_id || CASE WHEN v = 2 THEN 'x' ELSE '' END AS clause_id,
           CASE v WHEN 4 THEN 'Other title' WHEN 6 THEN '' ELSE section_title END AS section_title,
           CASE v WHEN 3 THEN 'Page 999' WHEN 6 THEN '' ELSE upper(location) END AS source_location,
           CASE v WHEN 1 THEN 'we promise ' || left(text, 30) WHEN 5 THEN ' ... ' ELSE '"' || upper({_QUOTE}) || '..."' END AS quoted_text
    FROM (SELECT h.*, (conv_id + turn) % 8 AS v FROM hits h JOIN questions q USING (query_id) WHERE h.meets_threshold AND h.rank <= 2)"""
_Q, _S = f"trim({oracles.matching('quoted_text')}, ' .' || chr(8230) || '''\"')", oracles.matching("true_text")
_BARE = r"regexp_replace({}, '[^\pL\pM\pN\pPc\s_]', '', 'g')"
oracles.PARTS["judged"] = f"""
    SELECT *, CASE WHEN v = 2 THEN 'unknown' WHEN {_Q} = '' THEN 'empty' WHEN contains({_S}, {_Q}) OR ({_BARE.format(_Q)} <> '' AND contains({_BARE.format(_S)}, {_BARE.format(_Q)})) THEN 'found' ELSE 'missing' END AS state
    FROM cited"""
oracles.PARTS["replies"] = """
    SELECT q.query_id AS answer_id, q.document_id, CASE WHEN (q.conv_id + q.turn) % 8 = 7 THEN coalesce(a.text, '') || ' That term is clearly illegal.' ELSE a.text END AS answer
    FROM questions q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
    WHERE q.query_id IN (SELECT answer_id FROM cited)"""
oracles.PARTS["errors"] = f"""
    SELECT answer_id, 1 AS phase, pos, 0 AS ord, 'Unsupported clause ID in source citation: ''' || clause_id || '''. Retrieved candidate IDs were: [' ||
           (SELECT string_agg('''' || h.clause_id || '''', ', ' ORDER BY h.clause_id) FROM hits h WHERE h.query_id = answer_id AND h.meets_threshold) || '].' AS message FROM judged WHERE state = 'unknown'
    UNION ALL SELECT answer_id, 2, pos, 0, 'Section title mismatch for clause ''' || clause_id || ''': cited ''' || section_title || ''', expected ''' || true_title || '''.' FROM judged WHERE v = 4
    UNION ALL SELECT answer_id, 2, pos, 1, 'Location mismatch for clause ''' || clause_id || ''': cited ''' || source_location || ''', expected ''' || true_location || '''.' FROM judged WHERE v = 3
    UNION ALL SELECT answer_id, 2, pos, 2, CASE state WHEN 'empty' THEN 'Empty quotation cited for clause ''' || clause_id || '''.'
           ELSE 'Fabricated or modified quotation in clause ''' || clause_id || ''': quoted excerpt "' || left(quoted_text, 80) || '..." was not found in source clause text.' END FROM judged WHERE state IN ('empty', 'missing')
    UNION ALL SELECT answer_id, 3, 0, n, 'Forbidden legal conclusion detected in answer: ''' || phrase || '''. The system must remain informational and neutral without asserting legal determinations.'
           FROM ({' UNION ALL '.join(f"SELECT answer_id, {n} AS n, {oracles.first(chr(97) + 'nswer', p)} AS phrase FROM replies" for n, p in enumerate(rules.FORBIDDEN_CONCLUSIONS))}) WHERE phrase <> ''"""
oracles.PARTS["verdicts"] = f"""
    SELECT a.answer_id, a.document_id, count(e.message) = 0 AS is_valid, coalesce(string_agg(e.message, '; ' ORDER BY phase, pos, ord), '') AS errors, count(e.message) AS n_errors, any_value(a.answer) AS answer
    FROM replies a LEFT JOIN errors e USING (answer_id) GROUP BY 1, 2"""


@register("q12_citation_exists", "SELECT answer_id, pos, clause_id, v <> 2 AS supplied FROM cited")
def _(spark, d):
    hits = stage(_hits(spark, d))
    rows = ground.citations(_answers(spark, d, hits), _supplied(hits), "sources")
    return rows.select("answer_id", "pos", "clause_id", F.col("clause").isNotNull().alias("supplied"))


@register("q13_filled_citations", """
    SELECT answer_id, pos, clause_id, CASE WHEN section_title = '' THEN true_title ELSE section_title END AS section_title, CASE WHEN source_location = '' THEN true_location ELSE source_location END AS source_location, quoted_text FROM cited""")
def _(spark, d):
    hits = stage(_hits(spark, d))
    return ground.fill_citations(_answers(spark, d, hits), _supplied(hits))


@register("q14_citation_errors", "SELECT answer_id, phase, pos::INT AS pos, ord, message FROM errors WHERE phase < 3")
def _(spark, d):
    hits = stage(_hits(spark, d))
    return ground.citation_errors(_answers(spark, d, hits), _supplied(hits), "sources", True)


@register("q15_quote_check", "SELECT answer_id, pos, state FROM judged WHERE state <> 'unknown'")
def _(spark, d):
    hits = stage(_hits(spark, d))
    rows = ground.citations(_answers(spark, d, hits), _supplied(hits), "sources").where("clause is not null")
    return rows.select("answer_id", "pos", ground.quote_state(F.col("c.quoted_text"), F.col("clause.text")).alias("state"))


@register("q16_forbidden_conclusions", "SELECT answer_id, ord, message FROM errors WHERE phase = 3")
def _(spark, d):
    answers = _answers(spark, d, _hits(spark, d))
    return ground.guard_errors(answers, F.array("answer"), "answer").select("answer_id", "ord", "message")


@register("q17_verdict", f"""
    SELECT answer_id, is_valid, CASE WHEN is_valid THEN answer ELSE {lit(rules.REJECTED_ANSWER)} END AS answer,
           CASE WHEN is_valid THEN '' ELSE 'Evidence validation failed with ' || n_errors || ' error(s): ' || errors END AS uncertainty FROM verdicts""")
def validate_answers(spark, d):
    hits = stage(_hits(spark, d))
    return ground.validate_answers(_answers(spark, d, hits), _supplied(hits)).select("answer_id", "is_valid", "answer", "uncertainty")


def _explanations(spark, d, hits) -> DataFrame:
    """The answers as explanations of clauses: their citations are the references."""
    return _answers(spark, d, hits).select(
        "answer_id", F.coalesce("answer", F.lit("")).alias("summary"), F.lit("").alias("attention_explanation"), F.lit("").alias("relationship_explanation"),
        F.array(F.lit("one point")).alias("key_points"), "evidence_sufficient", "uncertainty", F.col("sources").alias("evidence_references"))


@register("q17_explanations", f"""
    SELECT answer_id, count(*) FILTER (WHERE NOT ok) = 0 AND NOT bool_or(v = 7) AS is_valid FROM (SELECT answer_id, v, v NOT IN (2, 3) AND state <> 'missing' AS ok FROM judged) GROUP BY 1""")
def _(spark, d):
    hits = stage(_hits(spark, d))
    return ground.validate_explanations(_explanations(spark, d, hits), _supplied(hits)).select("answer_id", "is_valid")


@register("q13_filled_references", """
    SELECT answer_id, pos, clause_id, section_title, CASE WHEN source_location = '' THEN true_location ELSE source_location END AS source_location, quoted_text FROM cited""")
def _(spark, d):
    hits = stage(_hits(spark, d))
    return ground.fill_references(_explanations(spark, d, hits), _supplied(hits)).select("answer_id", "pos", "reference.*")


@register("q17_explanation_fields", f"""
    SELECT j.answer_id, ok AS is_valid, ok AS evidence_sufficient, CASE WHEN ok THEN coalesce(r.answer, '') ELSE {lit(rules.REJECTED_EXPLANATION)} END AS summary,
           CASE WHEN ok THEN 'one point' ELSE '' END AS key_points, CASE WHEN ok THEN refs ELSE '' END AS refs, CASE WHEN ok THEN '' ELSE n_errors::VARCHAR END AS n_errors
    FROM (SELECT answer_id, n_wrong = 0 AS ok, n_wrong AS n_errors, refs
          FROM (SELECT answer_id, count(*) FILTER (WHERE v IN (2, 3)) + count(*) FILTER (WHERE state = 'missing') + max(CASE WHEN v = 7 THEN 1 ELSE 0 END) AS n_wrong,
                       string_agg(clause_id || '@' || CASE WHEN source_location = '' THEN true_location ELSE source_location END, '|' ORDER BY pos) AS refs FROM judged GROUP BY 1)) j
    JOIN replies r ON r.answer_id = j.answer_id""")
def _(spark, d):
    hits = stage(_hits(spark, d))
    rows = ground.validate_explanations(_explanations(spark, d, hits), _supplied(hits))
    refs = F.transform("evidence_references", lambda c: F.concat(c["clause_id"], F.lit("@"), c["source_location"]))
    return rows.select(
        "answer_id", "is_valid", "evidence_sufficient", "summary", F.array_join("key_points", "|").alias("key_points"), F.array_join(refs, "|").alias("refs"),
        F.regexp_extract("uncertainty", r"^Evidence validation failed with (\d+) error\(s\): ", 1).alias("n_errors"))


@register("q18_status", """
    SELECT q.query_id AS answer_id, CASE WHEN v.is_valid THEN 'success' WHEN v.is_valid IS NOT NULL THEN 'validation_failed' ELSE 'insufficient_evidence' END AS status FROM questions q LEFT JOIN verdicts v ON v.answer_id = q.query_id""")
def _(spark, d):
    return _results(spark, d).select(F.col("query_id").alias("answer_id"), F.col("system_status").alias("status"))


def _results(spark, d) -> DataFrame:
    """One evaluated question per row, as E13-E17 read it."""
    hits = stage(_hits(spark, d))
    checked = ground.validate_answers(_answers(spark, d, hits), _supplied(hits)).select(
        F.col("answer_id").alias("query_id"), "evidence_sufficient", "uncertainty", "sources",
        F.when(F.col("evidence_sufficient"), F.coalesce("answer", F.lit(""))).alias("answer"))
    wanted = _relevant(spark, d).groupBy("query_id").agg(F.collect_list("clause_id").alias("expected_source_clause_ids"))
    none = F.array().cast("array<string>")
    rows = corpus.questions(spark, d).join(checked, "query_id", "left").join(wanted, "query_id", "left")
    return rows.withColumns({
        "question_id": F.col("query_id"),
        "system_status": F.when(F.col("evidence_sufficient").isNull(), "insufficient_evidence").otherwise(
            ground.answer_status(F.col("evidence_sufficient"), F.col("uncertainty"))),
        "expected_answerable": F.col("expected_source_clause_ids").isNotNull(),
        "expected_source_clause_ids": F.coalesce("expected_source_clause_ids", none),
        "cited_clause_ids": F.coalesce(F.transform("sources", lambda s: s["clause_id"]), none),
    })


oracles.PARTS["results"] = """
    SELECT q.query_id, q.document_id, CASE WHEN v.is_valid THEN 'success' WHEN v.is_valid IS NOT NULL THEN 'validation_failed' ELSE 'insufficient_evidence' END AS system_status,
           CASE WHEN v.is_valid THEN coalesce(v.answer, '') END AS answer, r.ids IS NOT NULL AS expected_answerable, coalesce(r.ids, []) AS expected_ids,
           CASE WHEN v.is_valid THEN (SELECT list(clause_id) FROM cited c WHERE c.answer_id = q.query_id) ELSE [] END AS cited_ids
    FROM questions q LEFT JOIN verdicts v ON v.answer_id = q.query_id LEFT JOIN (SELECT query_id, list(clause_id) AS ids FROM relevant GROUP BY 1) r ON r.query_id = q.query_id"""


@register("q19_degraded_sources", """
    SELECT query_id, rank, clause_id, section_title, location AS source_location, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS quoted_text, 'llm_unavailable' AS status FROM hits WHERE meets_threshold""")
def _(spark, d):
    return ground.degraded_sources(ground.evidence_rows(_hits(spark, d)))


# -- document summaries ---------------------------------------------------------------

oracles.PARTS["counts"] = """
    SELECT document_id, n_clauses, n_high, n_medium, n_low, n_info, n_low + n_info AS n_standard, coalesce(n_rel, 0) AS n_relationships
    FROM (SELECT document_id, count(*) AS n_clauses, count(*) FILTER (WHERE attention_level = 'High Attention') AS n_high, count(*) FILTER (WHERE attention_level = 'Medium Attention') AS n_medium,
                 count(*) FILTER (WHERE attention_level = 'Low Attention') AS n_low, count(*) FILTER (WHERE attention_level = 'Informational') AS n_info FROM levelled GROUP BY 1)
    LEFT JOIN (SELECT document_id, count(*) AS n_rel FROM relationships GROUP BY 1) USING (document_id)"""


def _counts(spark, d) -> DataFrame:
    return summary.attention_counts(_levelled(spark, d), _relationships(spark, d))


@register("d1_attention_counts", "SELECT * FROM counts")
def attention_counts(spark, d):
    return _counts(spark, d)


_SCORED = """(SELECT *, CASE WHEN n_high = 0 AND n_medium = 0 THEN least(15, raw) WHEN n_high > 0 THEN greatest(65, raw) ELSE greatest(38, least(60, raw)) END AS score
    FROM (SELECT *, least(100, floor((n_high * 30 + n_medium * 10 + n_low * 2) / greatest(n_clauses, 1) * 20 + least(15, n_relationships * 1.5) + 0.5))::BIGINT AS raw FROM counts))"""


@register("d2_exposure_score", f"SELECT document_id, score, CASE WHEN score < 30 THEN 'Standard Agreement' WHEN score <= 60 THEN 'Moderate Caution' ELSE 'Critical Traps Detected' END AS verdict FROM {_SCORED}")
def exposure(spark, d):
    return summary.exposure(_counts(spark, d)).select("document_id", "score", "verdict")


_PCT = "floor({} / greatest(n_clauses, 1) * 100 + 0.5)::BIGINT"


@register("d3_flag_ratio", f"SELECT document_id, {_PCT.format('(n_high + n_medium)')} AS flag_ratio FROM counts")
def _(spark, d):
    return summary.exposure(summary.attention_counts(_levelled(spark, d))).select("document_id", "flag_ratio")


@register("d4_level_percentages", f"SELECT document_id, {_PCT.format('n_high')} AS pct_high, {_PCT.format('n_medium')} AS pct_medium, {_PCT.format('n_low')} AS pct_low, {_PCT.format('n_info')} AS pct_info, least(100, n_relationships) AS relationship_bar FROM counts")
def _(spark, d):
    return summary.exposure(_counts(spark, d)).select("document_id", "pct_high", "pct_medium", "pct_low", "pct_info", "relationship_bar")


@register("d5_category_distribution", """
    SELECT document_id, category, n, round(n / sum(n) OVER (PARTITION BY document_id), 6) AS share, (row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first_seen))::INT AS position
    FROM (SELECT document_id, primary_category AS category, count(*) AS n, min(clause_index) AS first_seen FROM clauses GROUP BY 1, 2)""")
def _(spark, d):
    return summary.category_distribution(_clauses(spark, d)).select("document_id", "category", "n", F.round("share", 6).alias("share"), "position")


def _domain(category: str, keywords: list[str]) -> str:
    return "(primary_category = " + lit(category) + "".join(f" OR contains(lower(text), {lit(k)})" for k in keywords) + ")"


@register("d6_exposure_matrix", " UNION ALL ".join(f"""
    SELECT document_id, {lit(n)} AS domain, count(*) FILTER (WHERE {_domain(c, k)}) AS matches,
           CASE WHEN bool_or({_domain(c, k)} AND attention_level = 'High Attention') THEN 'Flagged' WHEN bool_or({_domain(c, k)} AND attention_level = 'Medium Attention') OR count(*) FILTER (WHERE {_domain(c, k)}) > 2 THEN 'Notable' ELSE 'Guarded' END AS state
    FROM levelled GROUP BY 1""" for n, c, k in rules.EXPOSURE_DOMAINS))
def _(spark, d):
    return summary.exposure_matrix(_levelled(spark, d))


@register("d7_level_strip", "SELECT document_id, ((clause_index - 1) // 20)::INT AS segment, string_agg(attention_level, ',' ORDER BY clause_index) AS levels FROM levelled GROUP BY 1, 2")
def _(spark, d):
    rows = summary.level_strip(_levelled(spark, d), 20)
    return rows.select("document_id", "segment", F.array_join("levels", ",").alias("levels"))


@register("d8_clause_filter", """
    SELECT clause_id FROM levelled WHERE (contains(lower(text), 'plan') OR contains(lower(section_title), 'plan') OR len(list_filter(attention_reasons, lambda r: contains(lower(r), 'plan'))) > 0)
      AND (primary_category = 'Payment' OR list_contains(secondary_categories, 'Payment')) AND attention_level IN ('Low Attention', 'Informational')""")
def _(spark, d):
    return summary.filter_clauses(_levelled(spark, d), " Plan ", "Payment", "STANDARD").select("clause_id")


oracles.PARTS["ends"] = """
    SELECT document_id, relationship_id, rank, 0 AS side, source_clause_id AS clause_id, target_clause_id AS other_id FROM relationships
    UNION ALL SELECT document_id, relationship_id, rank, 1, target_clause_id, source_clause_id FROM relationships"""


@register("d9_relationships_per_clause", "SELECT document_id, clause_id, count(*) AS n_relationships FROM ends GROUP BY 1, 2")
def _(spark, d):
    return summary.relationship_counts(_relationships(spark, d))


@register("d10_related_clauses", "SELECT e.document_id, e.clause_id, e.relationship_id, e.other_id, c.section_title AS other_title FROM ends e JOIN clauses c ON c.clause_id = e.other_id")
def _(spark, d):
    return summary.related_clauses(_relationships(spark, d), _clauses(spark, d))


oracles.PARTS["nodes"] = """
    SELECT * FROM (SELECT document_id, clause_id, row_number() OVER (PARTITION BY document_id ORDER BY f)::INT AS node FROM (SELECT document_id, clause_id, min(rank * 2 + side) AS f FROM ends GROUP BY 1, 2)) WHERE node <= 24"""
oracles.PARTS["graph"] = """
    SELECT * FROM (SELECT r.document_id, r.relationship_id, r.source_clause_id, r.target_clause_id, row_number() OVER (PARTITION BY r.document_id ORDER BY rank)::INT AS edge FROM relationships r
                   WHERE source_clause_id IN (SELECT clause_id FROM nodes) AND target_clause_id IN (SELECT clause_id FROM nodes)) WHERE edge <= 50"""


def _drawn(spark, d) -> DataFrame:
    """What a graph shows of the relationships: their ends and ranks.  The texts of an edge are cut before they are joined or kept."""
    return stage(_relationships(spark, d).select("document_id", "relationship_id", "source_clause_id", "target_clause_id", "rank"))


@register("d11_graph_nodes", """
    SELECT n.document_id, n.clause_id, n.node, count(e.relationship_id) AS degree FROM nodes n
    LEFT JOIN (SELECT source_clause_id AS clause_id, relationship_id FROM graph UNION ALL SELECT target_clause_id, relationship_id FROM graph) e USING (clause_id) GROUP BY 1, 2, 3""")
def _(spark, d):
    edges = _drawn(spark, d)
    nodes = summary.graph_nodes(edges)
    return summary.node_degrees(summary.graph_edges(edges, nodes), nodes)


@register("d11_graph_edges", "SELECT document_id, relationship_id, edge FROM graph")
def _(spark, d):
    edges = _drawn(spark, d)
    return summary.graph_edges(edges, summary.graph_nodes(edges)).select("document_id", "relationship_id", "edge")


@register("d12_default_view", "SELECT document_id, CASE WHEN n_high > 0 THEN 'High Attention' WHEN n_medium > 0 THEN 'Medium Attention' ELSE 'ALL' END AS default_view FROM counts")
def _(spark, d):
    return summary.exposure(summary.attention_counts(_levelled(spark, d))).select("document_id", "default_view")


@register("d13_display_title", r"""
    SELECT clause_id, 'Clause #' || clause_index || CASE WHEN section_title <> 'General' AND primary_category <> 'General' THEN ': ' || section_title || ' (' || primary_category || ')'
        WHEN section_title <> 'General' THEN ': ' || section_title WHEN primary_category <> 'General' THEN ' (' || primary_category || ')'
        ELSE ': "' || CASE WHEN length(t) > 28 THEN left(t, 28) || '...' ELSE t END || '"' END AS title
    FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM clauses)""")
def _(spark, d):
    title = summary.display_title(F.col("clause_index"), F.col("section_title"), F.col("primary_category"), F.col("text"))
    return _clauses(spark, d).select("clause_id", title.alias("title"))


# -- evaluation -----------------------------------------------------------------------


def _level_pairs(spark, d) -> DataFrame:
    return _levelled(spark, d).select("clause_id", F.col("expected_level").alias("truth"), F.col("attention_level").alias("pred"), "text")


def _category_pairs(spark, d) -> DataFrame:
    rows = classify.classify(_encoded(spark, d))
    return rows.select("clause_id", F.col("expected_category").alias("truth"), F.col("primary_category").alias("pred"), "text")


oracles.PARTS["level_pairs"] = "SELECT clause_id, expected_level AS truth, attention_level AS pred, text FROM levelled"
oracles.PARTS["category_pairs"] = "SELECT c.clause_id, c.expected_category AS truth, p.primary_category AS pred, c.text FROM clauses c JOIN picked p USING (clause_id)"


def _matrix(source: str, labels: list[str]) -> str:
    return "SELECT truth, " + ", ".join(f'count(*) FILTER (WHERE pred = {lit(x)}) AS "{x}"' for x in labels) + f" FROM {source} GROUP BY 1"


def _per_class(source: str) -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0::DOUBLE END AS f1
        FROM (SELECT label, tp, support, predicted - tp AS fp, support - tp AS fn, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0::DOUBLE END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0::DOUBLE END AS recall
              FROM (SELECT label, sum(tp)::BIGINT AS tp, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted
                    FROM (SELECT truth AS label, 1 AS t, 0 AS p, (truth = pred)::INT AS tp FROM {source} UNION ALL SELECT pred, 0, 1, 0 FROM {source}) GROUP BY 1))"""


_PER_CLASS_OUT = "label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def _summary_sql(source: str) -> str:
    return f"""SELECT sum(support)::BIGINT AS sample_size, sum(tp)::BIGINT AS correct_predictions, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision) FILTER (WHERE support > 0), 6) AS macro_precision,
        round(avg(recall) FILTER (WHERE support > 0), 6) AS macro_recall, round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1 FROM ({_per_class(source)})"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


oracles.PARTS["class_counts"] = _per_class("category_pairs")


@register("e1_confusion_matrix", _matrix("category_pairs", rules.CATEGORIES + [rules.GENERAL]))
def _(spark, d):
    return metrics.confusion_matrix(_category_pairs(spark, d), rules.CATEGORIES + [rules.GENERAL])


_MATRIX_LABELS = rules.CATEGORIES + [rules.GENERAL]
_CELL = lambda c: f"' ' || CASE WHEN length(CAST({c} AS VARCHAR)) < 7 THEN lpad(CAST({c} AS VARCHAR), 7, ' ') ELSE CAST({c} AS VARCHAR) END"
_FIRST_CELL = "CASE WHEN length(truth) < 24 THEN rpad(truth, 24, ' ') ELSE truth END"


@register("s9_text_matrix", f"""
    SELECT {_FIRST_CELL} || {" || ".join(_CELL(f'"{x}"') for x in _MATRIX_LABELS)} AS line
    FROM ({_matrix("category_pairs", _MATRIX_LABELS)}) UNION ALL
    SELECT {_FIRST_CELL} || {" || ".join(_CELL(lit(x)) for x in _MATRIX_LABELS)} FROM (SELECT 'truth' AS truth)""")
def _(spark, d):
    folder = scratch_folder(spark)
    write_matrix(metrics.confusion_matrix(_category_pairs(spark, d), _MATRIX_LABELS), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@register("e1_confusion_totals", "SELECT truth, pred, count(*) AS n FROM level_pairs GROUP BY CUBE (truth, pred)")
def _(spark, d):
    return metrics.confusion_totals(_level_pairs(spark, d))


@register("e2_per_class", f"SELECT {_PER_CLASS_OUT} FROM class_counts")
def _(spark, d):
    return _rounded(metrics.per_class(_category_pairs(spark, d)), "precision", "recall", "f1")


#: Every second category, and one that occurs nowhere.
_GIVEN = [*rules.CATEGORIES[::2], "Unused"]
_GIVEN_SQL = ", ".join(lit(x) for x in _GIVEN)


@register("e2_given_labels", f"""
    SELECT g.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(support, 0) AS support,
           round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1
    FROM (SELECT unnest([{_GIVEN_SQL}]) AS label) g LEFT JOIN class_counts USING (label)""")
def _(spark, d):
    return _rounded(metrics.per_class(_category_pairs(spark, d), _GIVEN), "precision", "recall", "f1")


@register("e3_given_labels", f"""
    SELECT sum(support)::BIGINT AS sample_size, sum(tp)::BIGINT AS correct_predictions, round(sum(tp) / sum(support), 6) AS accuracy,
           round(coalesce(avg(precision) FILTER (WHERE present), 0), 6) AS macro_precision, round(coalesce(avg(recall) FILTER (WHERE present), 0), 6) AS macro_recall, round(coalesce(avg(f1) FILTER (WHERE present), 0), 6) AS macro_f1
    FROM (SELECT *, support > 0 AND label IN ({_GIVEN_SQL}) AS present FROM class_counts)""")
def _(spark, d):
    return _rounded(metrics.classification_summary(_category_pairs(spark, d), _GIVEN), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@register("e3_category_summary", _summary_sql("category_pairs"))
def _(spark, d):
    return _rounded(metrics.classification_summary(_category_pairs(spark, d)), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@register("e4_attention_matrix", _matrix("level_pairs", rules.LEVELS))
def _(spark, d):
    return metrics.confusion_matrix(_level_pairs(spark, d), rules.LEVELS)


@register("e4_attention_summary", _summary_sql("level_pairs"))
def _(spark, d):
    return _rounded(metrics.classification_summary(_level_pairs(spark, d)), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@register("e5_mismatches", "SELECT clause_id, truth, pred, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS snippet FROM level_pairs WHERE truth <> pred")
def _(spark, d):
    return metrics.mismatches(_level_pairs(spark, d))


_KS = (1, 3, 5)
oracles.PARTS["query_scores"] = f"""
    SELECT r.query_id, coalesce(1 / min(h.rank), 0)::DOUBLE AS rr, {', '.join(f"count(h.rank) FILTER (WHERE h.rank <= {k}) / count(DISTINCT r.clause_id) AS recall_{k}" for k in _KS)},
           {', '.join(f"count(h.rank) FILTER (WHERE h.rank <= {k}) / {k} AS precision_{k}" for k in _KS)}
    FROM relevant r LEFT JOIN hits h ON h.query_id = r.query_id AND h.clause_id = r.clause_id GROUP BY 1"""
_MEANS = ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in [f"{m}_{k}" for m in ("recall", "precision") for k in _KS])
_MEAN_NAMES = ["mrr"] + [f"{m}_{k}" for m in ("recall", "precision") for k in _KS]


@register("e6_retrieval_metrics", f"SELECT (SELECT count(*) FROM questions) AS query_count, round(coalesce(avg(rr), 0), 6) AS mrr, {_MEANS} FROM query_scores")
def _(spark, d):
    return _rounded(metrics.retrieval_summary(corpus.questions(spark, d), _relevant(spark, d), _hits(spark, d)), *_MEAN_NAMES)


oracles.PARTS["cuts"] = "SELECT * FROM (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in rules.SWEEP_THRESHOLDS) + ") AS t(threshold)"
oracles.PARTS["sweep"] = f"""
    SELECT c.threshold, q.query_id, bool_or(h.similarity_score >= c.threshold) AS enough, n.n AS n_relevant, coalesce(1 / min(h.rank) FILTER (WHERE h.similarity_score >= c.threshold AND r.clause_id IS NOT NULL), 0)::DOUBLE AS rr,
           {', '.join(f"count(*) FILTER (WHERE h.similarity_score >= c.threshold AND r.clause_id IS NOT NULL AND h.rank <= {k}) AS hits_{k}" for k in _KS)}
    FROM questions q CROSS JOIN cuts c LEFT JOIN hits h ON h.query_id = q.query_id LEFT JOIN relevant r ON r.query_id = h.query_id AND r.clause_id = h.clause_id
    LEFT JOIN (SELECT query_id, count(*) AS n FROM relevant GROUP BY 1) n ON n.query_id = q.query_id GROUP BY 1, 2, 4"""


@register("e7_threshold_sweep", f"""
    SELECT threshold, count(*) AS query_count, round(avg(rr) FILTER (WHERE n_relevant IS NOT NULL), 6) AS mrr, {', '.join(f"round(avg(hits_{k} / n_relevant), 6) AS recall_{k}" for k in _KS)},
           {', '.join(f"round(avg(hits_{k} / {k}) FILTER (WHERE n_relevant IS NOT NULL), 6) AS precision_{k}" for k in _KS)}, round(avg(coalesce(enough, false)::INT), 6) AS sufficient_rate, round(avg(1 - coalesce(enough, false)::INT), 6) AS abstention_rate
    FROM sweep GROUP BY 1""")
def _(spark, d):
    rows = metrics.threshold_sweep(corpus.questions(spark, d), _relevant(spark, d), _hits(spark, d))
    return _rounded(rows, *_MEAN_NAMES, "sufficient_rate", "abstention_rate")


@register("e8_retrieval_misses", """
    SELECT DISTINCT query_id FROM relevant WHERE query_id NOT IN (SELECT r.query_id FROM relevant r JOIN hits h ON h.query_id = r.query_id AND h.clause_id = r.clause_id AND h.similarity_score >= 0.45)""")
def _(spark, d):
    return metrics.retrieval_misses(_relevant(spark, d), _hits(spark, d))


def _true_pairs(spark, d) -> DataFrame:
    """Label pairs: each clause with its successor, typed by their templates."""
    c = _clauses(spark, d)
    after = c.select("document_id", (F.col("clause_index") - 1).alias("clause_index"), F.col("clause_id").alias("target_clause_id"), F.col("template").alias("t2"))
    types = F.array(*[F.lit(t) for t in rules.RELATIONSHIP_TYPES])
    return c.join(after, ["document_id", "clause_index"]).select(
        "document_id", F.col("clause_id").alias("source_clause_id"), "target_clause_id",
        F.get(types, (F.col("template") + F.col("t2")) % 7).alias("relationship_type"), F.lit(1).alias("ord"))


def _matched(spark, d) -> DataFrame:
    return metrics.match_pairs(_true_pairs(spark, d), _relationships(spark, d).withColumn("ord", F.col("rank")))


oracles.PARTS["matched"] = f"""
    SELECT coalesce(t.document_id, p.document_id) AS document_id, coalesce(t.s, p.s) AS source_clause_id, coalesce(t.t, p.t) AS target_clause_id, t.type AS true_type, p.type AS pred_type
    FROM (SELECT a.document_id, a.clause_id AS s, b.clause_id AS t, {oracles._list(rules.RELATIONSHIP_TYPES)}[(a.tmpl + b.tmpl) % 7 + 1] AS type FROM clauses a JOIN clauses b ON b.document_id = a.document_id AND b.clause_index = a.clause_index + 1) t
    FULL JOIN (SELECT document_id, source_clause_id AS s, target_clause_id AS t, max_by(relationship_type, rank) AS type FROM relationships GROUP BY 1, 2, 3) p ON t.s = p.s AND t.t = p.t"""
oracles.PARTS["type_pairs"] = "SELECT true_type AS truth, pred_type AS pred FROM matched"


@register("e9_pair_detection", """
    SELECT n_true AS ground_truth_count, n_pred AS predicted_count, tp, fp, fn, type_matches, round(tp / n_pred, 6) AS precision, round(tp / n_true, 6) AS recall, round(type_matches / tp, 6) AS type_accuracy, round(2 * tp / (n_pred + n_true), 6) AS f1
    FROM (SELECT count(true_type) AS n_true, count(pred_type) AS n_pred, count(*) FILTER (WHERE true_type IS NOT NULL AND pred_type IS NOT NULL) AS tp, count(*) FILTER (WHERE true_type IS NULL) AS fp,
                 count(*) FILTER (WHERE pred_type IS NULL) AS fn, count(*) FILTER (WHERE true_type = pred_type) AS type_matches FROM matched)""")
def _(spark, d):
    return _rounded(metrics.pair_detection(_matched(spark, d)), "precision", "recall", "type_accuracy", "f1")


oracles.PARTS["type_counts"] = _per_class("type_pairs").replace("(truth = pred)::INT", "coalesce((truth = pred)::INT, 0)")


@register("e11_per_type", f"SELECT {_PER_CLASS_OUT} FROM type_counts WHERE label IS NOT NULL")
def _(spark, d):
    return _rounded(metrics.per_type(_matched(spark, d)), "precision", "recall", "f1")


@register("e12_pair_examples", """
    SELECT * FROM (SELECT CASE WHEN true_type IS NULL THEN 'false_positive' ELSE 'false_negative' END AS error, document_id, source_clause_id, target_clause_id, coalesce(pred_type, true_type) AS relationship_type,
                          row_number() OVER (PARTITION BY true_type IS NULL ORDER BY document_id, source_clause_id, target_clause_id)::INT AS n FROM matched WHERE true_type IS NULL OR pred_type IS NULL) WHERE n <= 5""")
def _(spark, d):
    return metrics.pair_examples(_matched(spark, d))


@register("e13_abstention", """
    SELECT *, CASE WHEN abstention_precision + abstention_recall > 0 THEN round(2 * abstention_precision * abstention_recall / (abstention_precision + abstention_recall), 5) ELSE 0::DOUBLE END AS abstention_f1
    FROM (SELECT unsupported_total, correctly_abstained, false_abstentions, abstained, unsupported_total - correctly_abstained AS incorrectly_answered,
                 correctly_abstained / abstained AS abstention_precision, correctly_abstained / unsupported_total AS abstention_recall
          FROM (SELECT count(*) FILTER (WHERE NOT expected_answerable) AS unsupported_total, count(*) FILTER (WHERE NOT expected_answerable AND gone) AS correctly_abstained,
                       count(*) FILTER (WHERE expected_answerable AND gone) AS false_abstentions, count(*) FILTER (WHERE gone) AS abstained
                FROM (SELECT *, system_status = 'insufficient_evidence' OR answer IS NULL AS gone FROM results)))""")
def _(spark, d):
    return metrics.abstention(_results(spark, d)).withColumn("abstention_f1", F.round("abstention_f1", 5))


@register("e14_citations", """
    SELECT count(*) AS answered_questions, round(coalesce(avg(CASE WHEN len(cited_ids) > 0 THEN tp / len(cited_ids) ELSE 0 END), 0), 6) AS citation_precision, round(coalesce(avg(tp / len(expected_ids)), 0), 6) AS citation_recall,
           round(coalesce(avg((tp = len(expected_ids))::INT), 0), 6) AS citation_accuracy
    FROM (SELECT *, len(list_intersect(expected_ids, cited_ids)) AS tp FROM results WHERE expected_answerable AND answer IS NOT NULL)""")
def _(spark, d):
    return _rounded(metrics.citation_scores(_results(spark, d)), "citation_precision", "citation_recall", "citation_accuracy")


_CLAIM = "coalesce(contains(lower(answer), 'the') OR contains(lower(answer), 'que'), false)"


@register("e15_hallucination", f"""
    SELECT count(*) AS total_questions, count(*) FILTER (WHERE {_CLAIM}) AS unsupported_claim_count, round(avg({_CLAIM}::INT), 6) AS unsupported_claim_rate, 0::BIGINT AS fabricated_citation_count, 0::DOUBLE AS fabricated_citation_rate FROM results""")
def _(spark, d):
    rows = stage(_results(spark, d))
    made_up = metrics.fabricated_citations(rows, _clauses(spark, d)).select("question_id").distinct().withColumn("has_fabricated_citation", F.lit(True))
    rows = rows.withColumn("has_unsupported_claim", metrics.has_forbidden_claim(F.col("answer"), F.array(F.lit("THE"), F.lit("Que"))))
    return _rounded(metrics.hallucination_rates(rows.join(made_up, "question_id", "left")), "unsupported_claim_rate", "fabricated_citation_rate")


@register("e16_forbidden_claims", """
    SELECT conv_id, turn, contains(lower(text), 'le') OR contains(lower(text), 'und') AS has_unsupported_claim FROM conversations""")
def _(spark, d):
    rows = corpus.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", metrics.has_forbidden_claim(F.col("text"), F.array(F.lit("LE"), F.lit("und"))).alias("has_unsupported_claim"))


@register("e17_fabricated_citations", "SELECT answer_id AS question_id, clause_id FROM cited WHERE v = 2")
def _(spark, d):
    answers = _answers(spark, d, _hits(spark, d)).select(
        F.col("answer_id").alias("question_id"), "document_id", F.transform("sources", lambda s: s["clause_id"]).alias("cited_clause_ids"))
    return metrics.fabricated_citations(answers, _clauses(spark, d)).select("question_id", "clause_id")


@register("e18_validator_acceptance", """
    SELECT adversarial_cases, correctly_rejected, false_acceptances, valid_accepted, valid_rejected, round(correctly_rejected / adversarial_cases, 6) AS rejection_rate, round(false_acceptances / adversarial_cases, 6) AS false_acceptance_rate
    FROM (SELECT count(*) FILTER (WHERE NOT ok) AS adversarial_cases, count(*) FILTER (WHERE NOT ok AND NOT is_valid) AS correctly_rejected, count(*) FILTER (WHERE NOT ok AND is_valid) AS false_acceptances,
                 count(*) FILTER (WHERE ok AND is_valid) AS valid_accepted, count(*) FILTER (WHERE ok AND NOT is_valid) AS valid_rejected
          FROM (SELECT v.is_valid, (q.conv_id + q.turn) % 8 IN (0, 6) AS ok FROM verdicts v JOIN questions q ON q.query_id = v.answer_id))""")
def _(spark, d):
    hits = stage(_hits(spark, d))
    verdicts = ground.validate_answers(_answers(spark, d, hits), _supplied(hits))
    kind = corpus.questions(spark, d).select(F.col("query_id").alias("answer_id"), ((F.col("conv_id") + F.col("turn")) % 8).isin(0, 6).alias("should_pass"))
    return _rounded(metrics.validator_acceptance(verdicts.join(kind, "answer_id")), "rejection_rate", "false_acceptance_rate")


@register("e19_latency", """
    SELECT event_type, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS median_ms, min(value) AS min_ms, max(value) AS max_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY 1""")
def latency(spark, d):
    samples = corpus.table(spark, d, "events").select("event_type", F.col("value").alias("ms"))
    return _rounded(metrics.latency_summary(samples, "event_type"), "mean_ms", "median_ms", "p95_ms")


def _specification(spark, d) -> DataFrame:
    return corpus.table(spark, d, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), (F.col("quality") + 1).alias("clause_index"),
        F.when(F.col("toxic") == 1, rules.HIGH).otherwise(rules.INFORMATIONAL).alias("expected_attention_level"))


@register("e20_label_assembly", """
    SELECT c.document_id, c.clause_index, c.clause_id, c.section_title, CASE WHEN l.toxic = 1 THEN 'High Attention' ELSE 'Informational' END AS expected_attention_level
    FROM labels l JOIN clauses c ON c.document_id = 'doc_' || l.doc_id AND c.clause_index = l.quality + 1""")
def _(spark, d):
    return metrics.assemble_labels(_specification(spark, d), _clauses(spark, d)).drop("text")


@register("e21_label_distribution", "SELECT expected_level AS label, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS percent FROM clauses GROUP BY 1")
def _(spark, d):
    return _rounded(metrics.label_distribution(_clauses(spark, d), "expected_level"), "percent")


@register("e22_label_rules", """
    SELECT document_id, clause_id, violation FROM (
        SELECT document_id, clause_id, unnest([CASE WHEN tmpl % 9 = 0 THEN 'missing_field' END, CASE WHEN tmpl % 7 = 0 THEN 'unknown_category' END, CASE WHEN tmpl % 6 = 0 THEN 'unknown_level' END,
               CASE WHEN length(title) <= 10 THEN 'short_rationale' END]) AS violation FROM clauses JOIN templates USING (tmpl)) WHERE violation IS NOT NULL""")
def _(spark, d):
    n = F.col("template")
    titles = F.array(*[F.lit(t[0]) for t in corpus.TEMPLATES])
    return metrics.label_violations(_clauses(spark, d).withColumns({
        "text": F.when(n % 9 == 0, " ").otherwise(F.col("text")),
        "expected_primary_category": F.when(n % 7 == 0, "Other").otherwise(F.col("expected_category")),
        "expected_attention_level": F.when(n % 6 == 0, F.lit(None)).otherwise(F.col("expected_level")),
        "rationale": F.get(titles, n)}))


@register("e22_label_coverage", """
    SELECT document_id, clause_index, clause_id FROM clauses c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE c.document_id = 'doc_' || l.doc_id AND c.clause_index = l.quality + 1)""")
def _(spark, d):
    return metrics.label_coverage(_specification(spark, d), _clauses(spark, d))


# -- flagship -------------------------------------------------------------------------


@register("document_overview", """
    SELECT document_id, count(*) AS n_clauses, count(*) FILTER (WHERE attention_level = 'High Attention') AS n_high, count(*) FILTER (WHERE attention_level = 'Medium Attention') AS n_medium,
           count(*) FILTER (WHERE attention_level = 'Low Attention') AS n_low, count(*) FILTER (WHERE attention_level = 'Informational') AS n_info FROM located_levels GROUP BY 1""")
def document_overview(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts to attention counts per document: clean, segment, level, count."""
    clauses = attention.assign_levels(segment.segment(_documents(spark, d)))
    return summary.attention_counts(clauses).drop("n_standard", "n_relationships")
