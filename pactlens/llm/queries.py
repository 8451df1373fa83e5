"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.staging import scratch_folder
from pactlens.llm import (
    conversation_repair, decontaminate, exact_dedup, language_id, line_cleaning, merkle, mixing, parity_join, personal_data, quality, token_counts,
    token_output, url_filter,
)
from pactlens.llm.common import is_held_out, table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    token_output.write_token_shards(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", 2)
    return token_output.read_token_shards(spark, path)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")

    def number(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*personal_data.KINDS[:4]))
    return found.select(
        "doc_id", *[number(k) for k in ("email", "ip", "card", "phone")], F.sha2(personal_data.listed(base), 256).alias("base_sha256"),
        personal_data.listed(spans).alias("spans"), F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    n = decontaminate.n_hit(c["hits"])
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), n.alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mix")
    return mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("judged")
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", *[j[c].alias(c) for c in ("host", "path", "rule", "verdict", "trust", "distrust")]
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.linked(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_quality(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, "piece_bpe_32k.model", 4096).drop("text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    found, l = language_id.with_language(docs.select("doc_id", "text"), model), F.col("language")
    return found.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), l["lang"].alias("lang_pred"), l["score"].alias("score"), F.size(l["spans"]).alias("n_spans")
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cleaning")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate", "n_navigation", "n_punctuation", "lost_chars")
    return line_cleaning.with_cleaning(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[c[f].alias(f) for f in fields])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.audited_all(rows, conversation_repair.damaged(rows))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_output, op2_personal_data, op3_decontamination, op4_mixing, op5_url_filter, op6_jaccard_join, op7_quality, op8_exact_dedup,
        op9_token_counts, op10_language_id, op11_quality_rules, op12_merkle_manifest, op13_conversation_repair, pipeline,
    )
}

def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rules_sql() -> str:
    """op11: words of the lines, the rule that each line fails, windows of eight words."""
    q = _sql_text
    separators = ", ".join(map(q, line_cleaning.SEPARATORS))
    symbols = lambda t: f"len(regexp_replace({t}, '[^#*$%&|<>]', '', 'g'))"
    spoken = lambda t: f"len(regexp_replace({t}, '[\\x20\\x09-\\x0D]', '', 'g'))"
    window = " || ' ' || ".join(f"words[i + {k}]" for k in range(line_cleaning.WINDOW))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (
  SELECT r, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT r, string_split(t, chr(10)) AS ls FROM docs)
), words AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM lines),
judged AS (
  SELECT *, CASE WHEN len(ws) = 0 THEN NULL
    WHEN len(ws) <= {line_cleaning.BOILERPLATE_WORDS} AND regexp_matches(line, {q(line_cleaning.BOILERPLATE)}) THEN 'boilerplate'
    WHEN len(list_filter(ws, lambda w: w IN ({separators}))) >= 3 AND 4 * len(list_filter(ws, lambda w: w IN ({separators}))) >= len(ws) THEN 'navigation'
    WHEN len(ws) <= {line_cleaning.MENU_WORDS} AND regexp_matches(line, {q(line_cleaning.MENU)}) THEN 'navigation'
    WHEN {symbols("line")} * 2 > len(ws) OR len(list_filter(ws, lambda w: regexp_matches(w, '[!?][!?]'))) * 3 > len(ws)
      OR len(list_filter(ws, lambda w: regexp_matches(w, {q(line_cleaning.SENTENCE_END)}))) = 0 THEN 'punctuation' END AS rule
  FROM words
), per_doc AS (
  SELECT r, flatten(list(ws ORDER BY k)) AS words, count(*) FILTER (len(ws) > 0) - count(DISTINCT line) FILTER (len(ws) > 0) AS n_dup_lines,
    count(*) FILTER (rule = 'boilerplate') AS n_boilerplate, count(*) FILTER (rule = 'navigation') AS n_navigation,
    count(*) FILTER (rule = 'punctuation') AS n_punctuation, coalesce(sum({spoken("line")}) FILTER (rule IS NOT NULL), 0)::BIGINT AS lost_chars
  FROM judged GROUP BY r
), starts AS (SELECT r, words, unnest(range(1, len(words) - {line_cleaning.WINDOW - 2})) AS i FROM per_doc WHERE len(words) > {line_cleaning.WINDOW}),
twins AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, {window}) AS n FROM starts) WHERE n > 1),
repeats AS (
  SELECT r, sum(least({line_cleaning.WINDOW}, coalesce(next - i, {line_cleaning.WINDOW})))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twins) GROUP BY r
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, {spoken("t")}::BIGINT AS word_chars, {symbols("t")}::BIGINT AS n_symbols, n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, n_boilerplate, n_navigation, n_punctuation, lost_chars
  FROM docs JOIN per_doc USING (r) LEFT JOIN repeats USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= {line_cleaning.MAX_LOST_PERCENT} * word_chars AS kept
FROM measured
"""


def _manifest_sql(levels: int = 9) -> str:
    """op12: the levels of all trees one above the other, enough for 8^levels leaves a tree."""
    shown = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join([shown(c) for c in ("doc_id", "source", "lang", "n_chars")] + [shown(t)]) + ")"

    def tree(name: str, ground: str, key: str) -> str:
        """Levels, and per leaf the path: the roots above, siblings joined, the runs on the way."""
        out = [f"{name}0 AS (SELECT {key} AS k, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM {ground})"]
        for l in range(levels):
            out.append(f"""{name}{l + 1} AS (
  SELECT k, CASE WHEN n > 1 THEN pos // 8 ELSE 0 END AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
    CASE WHEN any_value(n) > 1 THEN (any_value(n) + 7) // 8 ELSE 1 END AS n
  FROM {name}{l} GROUP BY k, CASE WHEN n > 1 THEN pos // 8 ELSE 0 END)""")
            out.append(f"""{name}s{l} AS (
  SELECT k, pos, n > 1 AS inside, coalesce(string_agg(h, '' ORDER BY pos) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ahead,
    coalesce(string_agg(h, '' ORDER BY pos) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM {name}{l} WINDOW run AS (PARTITION BY k, pos // 8 ORDER BY pos))""")
        return ",\n".join(out)

    def climb(name: str, source: str, start: str) -> str:
        """From ``source(r, k, pos, cur, proof)`` through all levels of a tree."""
        out, prior = [], source
        for l in range(levels):
            out.append(f"""{start}{l} AS (
  SELECT r, c.k, CASE WHEN inside THEN c.pos // 8 ELSE 0 END AS pos, CASE WHEN inside THEN sha256(ahead || cur || behind) ELSE cur END AS cur,
    proof || CASE WHEN inside THEN ahead || behind ELSE '' END AS proof
  FROM {prior} c JOIN {name}s{l} s ON s.k = c.k AND s.pos = c.pos)""")
            prior = f"{start}{l}"
        return ",\n".join(out)

    # DuckDB has no crc32; this one goes through the bits of the digits of the id.
    crc = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b:
      list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT))"""
    return f"""
WITH ids AS (SELECT *, row_number() OVER () AS r, coalesce('=' || lang, '') AS tree FROM documents),
hashed AS (
  SELECT r, doc_id, tree, {leaf("text")} AS h,
    CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS other FROM ids
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, other) - 1 AS pos FROM hashed),
{tree("a", "placed", "tree")},
subroots AS (SELECT k AS tree, h, row_number() OVER (ORDER BY k) - 1 AS pos FROM a{levels}),
{tree("b", "subroots", "''")},
start AS (SELECT r, tree AS k, pos, other AS cur, '' AS proof FROM placed),
{climb("a", "start", "c")},
middle AS (SELECT c.r, '' AS k, s.pos, c.cur, c.proof FROM c{levels - 1} c JOIN subroots s ON s.tree = c.k),
{climb("b", "middle", "d")}
SELECT doc_id, p.h AS leaf, s.h AS subroot, b.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = b.h AS verified
FROM placed p JOIN subroots s USING (tree) JOIN b{levels} b ON true JOIN d{levels - 1} d USING (r)
"""


ORACLES: dict[str, str] = {
    "op11_quality_rules": _rules_sql(),
    "op12_merkle_manifest": _manifest_sql(),
    "op4_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
), sizes AS (SELECT source, sum(n)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
    2.0::DOUBLE * source_size AS top FROM sizes
), level AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS total_w,
    coalesce(sum(top) OVER below, 0) AS top_before, coalesce(sum(w) OVER below, 0) AS w_before
  FROM weighed WINDOW below AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stops AS (SELECT *, top * (total_w - w_before) <= w * (total - top_before) AS at_top FROM level),
targets AS (
  SELECT source, source_size,
    CASE WHEN at_top THEN top ELSE (total - coalesce(sum(top) FILTER (at_top) OVER (), 0)) * w / sum(w) FILTER (NOT at_top) OVER () END AS target
  FROM stops
), rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, n::BIGINT AS size, source_size, target,
  (n * (floor(rate)::BIGINT + CASE WHEN
    (('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, md5(t))), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 < rate - floor(rate)
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs JOIN rates ON docs.source IS NOT DISTINCT FROM rates.source
""",
    "op8_exact_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
""",
}
