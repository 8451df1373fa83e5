"""The registered queries once more, as SQL over the same tables.

Each entry of ``PARTS`` is one named step; ``sql`` puts the steps that a query needs in
front of it.  The steps state the semantics in the plainest relational form (all pairs,
no blocks, no staging), which is what makes them a check of the Spark plans.
"""

from __future__ import annotations

import re

from pactlens import rules
from pactlens.plans import corpus

SPACE = r"^\s+|\s+$"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join(
        "(" + ", ".join(lit(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows
    )


def _list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def match(text: str, pattern: str, options: str = "i") -> str:
    return f"regexp_matches({text}, {lit(pattern)}, '{options}')"


def first(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, 0, 'i')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {lit(SPACE)}, '', 'g')"


def words(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def char_class(spans: str) -> str:
    """A character class such as ``\\u2010-\\u2015`` in RE2 notation."""
    return "[" + "".join(c if c == "-" or c == "`" else f"\\x{{{ord(c):04x}}}" for c in spans) + "]"


PARTS: dict[str, str] = {}

# -- derived tables -------------------------------------------------------------------

PARTS["templates"] = (
    "SELECT * FROM (" + _values((n,) + row for n, row in enumerate(corpus.TEMPLATES))
    + ") AS t(tmpl, title, category, level, sentence)"
)
PARTS["asked"] = (
    "SELECT * FROM (" + _values((n,) + row for n, row in enumerate(corpus.QUESTIONS)) + ") AS t(n, category, question)"
)
PARTS["lines"] = f"""
    SELECT doc_id, source, k, line, (doc_id * 7 + k * 11) % {len(corpus.TEMPLATES)} AS tmpl
    FROM (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k
          FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""
PARTS["clauses"] = """
    SELECT 'doc_' || doc_id AS document_id, doc_id, printf('doc_%d_clause_%03d', doc_id, k + 1) AS clause_id,
           (k + 1)::INT AS clause_index,
           CASE WHEN tmpl % 8 = 7 THEN 'General' ELSE (k + 1) || '. ' || title END AS section_title,
           sentence || ' ' || line AS text,
           CASE WHEN doc_id % 3 = 0 THEN (k // 3)::INT + 1 END AS page_number,
           CASE WHEN doc_id % 3 = 0 THEN (k // 3)::INT + 1 + (k % 2)::INT END AS end_page_number,
           (k * 1000)::INT AS start_char, (k * 1000 + length(sentence || ' ' || line))::INT AS end_char,
           category AS expected_category, level AS expected_level, tmpl, category AS primary_category,
           CASE WHEN tmpl % 3 = 0 THEN ['Account', 'Changes'] ELSE []::VARCHAR[] END AS secondary_categories,
           CASE WHEN doc_id % 3 = 0 AND k % 2 = 1
                THEN printf('Pages %d-%d (chars %d-%d)', k // 3 + 1, k // 3 + 2, k * 1000, k * 1000 + length(sentence || ' ' || line))
                WHEN doc_id % 3 = 0 THEN printf('Page %d (chars %d-%d)', k // 3 + 1, k * 1000, k * 1000 + length(sentence || ' ' || line))
                ELSE printf('Offset %d-%d', k * 1000, k * 1000 + length(sentence || ' ' || line)) END AS location
    FROM lines JOIN templates USING (tmpl)"""
PARTS["pieces"] = r"""
    SELECT doc_id, source, k, CASE
        WHEN doc_id % 6 = 0 THEN (k + 1) || '. ' || title || chr(10) || sentence || ' ' || line
        WHEN doc_id % 6 = 1 AND k % 3 = 0 THEN 'SECTION ' || (k + 1) || ': ' || title || chr(10) || chr(10) || (k + 1) || '.1 Scope' || chr(10) || sentence || ' ' || line
        WHEN doc_id % 6 = 1 AND k % 3 = 1 THEN (k + 1) || '.2 ' || sentence || ' ' || line
        WHEN doc_id % 6 = 1 THEN '(b)' || chr(10) || chr(10) || sentence || ' ' || line || chr(10) || chr(10) || 'Closing remark.'
        WHEN doc_id % 6 = 2 AND k % 2 = 0 THEN chr((65 + k % 26)::INT) || '. ' || title || chr(10) || sentence || ' ' || line
        WHEN doc_id % 6 = 2 THEN '(' || chr((97 + k % 26)::INT) || ') ' || sentence || ' ' || line
        WHEN doc_id % 6 = 3 THEN upper(title) || chr(10) || chr(10) || sentence || ' ' || line
        WHEN doc_id % 6 = 4 AND k = 0 THEN '1. ' || sentence || ' ' || line
        WHEN doc_id % 6 = 4 THEN title || ': ' || sentence || ' ' || line
        ELSE line END AS piece
    FROM lines JOIN templates USING (tmpl)"""
PARTS["raw_docs"] = r"""
    SELECT 'doc_' || doc_id AS document_id, doc_id, source || '.txt' AS title, CASE
        WHEN doc_id % 4 = 1 THEN replace(replace(t, ' the ', '  the' || chr(9)), ' your ', chr(160) || 'your ' || chr(8203))
        WHEN doc_id % 4 = 2 THEN replace(replace(replace(t, '''', chr(8217)), ' - ', ' ' || chr(8212) || ' '), 'termination', 'termi-' || chr(10) || 'nation')
        WHEN doc_id % 4 = 3 THEN replace(t, chr(10), ' ' || chr(13) || chr(10)) ELSE t END AS raw_text
    FROM (SELECT d.doc_id, d.source, CASE WHEN d.doc_id % 2 = 0 THEN 'Master ' || d.source || ' - Terms of Service' || chr(10) || chr(10) ELSE '' END || coalesce(p.t, '') AS t
          FROM documents d LEFT JOIN (SELECT doc_id, string_agg(piece, chr(10) || chr(10) ORDER BY k) AS t FROM pieces GROUP BY 1) p USING (doc_id))"""
PARTS["raw_pages"] = r"""
    SELECT 'doc_' || doc_id AS document_id, page_number::INT AS page_number,
           'Agreement doc_' || doc_id || chr(10) || coalesce(body, '') || chr(10) || 'Page ' || page_number || ' of ' || n_pages
           || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Confidential' ELSE '' END AS text
    FROM (SELECT d.doc_id, p.page_number, p.body, p.n_pages FROM documents d
          JOIN (SELECT doc_id, k // 3 + 1 AS page_number, string_agg(piece, chr(10) ORDER BY k) AS body,
                       max(k // 3 + 1) OVER (PARTITION BY doc_id) AS n_pages FROM pieces GROUP BY doc_id, k // 3 + 1) p USING (doc_id)
          UNION ALL SELECT doc_id, 1, '', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines))"""
PARTS["raw_pages"] = PARTS["raw_pages"].replace(
    "max(k // 3 + 1) OVER (PARTITION BY doc_id) AS n_pages FROM pieces GROUP BY doc_id, k // 3 + 1) p",
    "any_value(n) AS n_pages FROM pieces JOIN (SELECT doc_id, max(k // 3 + 1) AS n FROM pieces GROUP BY 1) USING (doc_id) GROUP BY doc_id, k // 3 + 1) p",
)
PARTS["questions"] = f"""
    SELECT 'q_' || conv_id || '_' || turn AS query_id, 'doc_' || conv_id AS document_id, question || ' ' || trim(text) AS query,
           category, conv_id, turn
    FROM conversations JOIN asked ON n = (conv_id + turn) % {len(corpus.QUESTIONS)} WHERE role = 'user'"""

# -- cleaning -------------------------------------------------------------------------


def clean_encoding(t: str) -> str:
    t = rf"regexp_replace({t}, '\r\n|\r', chr(10), 'g')"
    t = f"regexp_replace({t}, '{char_class(rules.ZERO_WIDTH)}', '', 'g')"
    t = f"regexp_replace({t}, '{char_class(rules.EXOTIC_SPACES)}', ' ', 'g')"
    t = f"regexp_replace({t}, '{char_class(rules.SINGLE_QUOTES)}', '''', 'g')"
    t = f"regexp_replace({t}, '{char_class(rules.DOUBLE_QUOTES)}', '\"', 'g')"
    return rf"regexp_replace({t}, '\s*{char_class(rules.LONG_DASHES)}\s*', ' - ', 'g')"


def clean_hyphens(t: str) -> str:
    return rf"regexp_replace({t}, '([a-zA-Z]{{2,}})-\n([a-z]{{2,}})', '\1\2', 'g')"


def clean_space(t: str) -> str:
    t = rf"regexp_replace(replace({t}, chr(9), ' '), ' {{2,}}', ' ', 'g')"
    t = rf"regexp_replace({t}, '[ \r\f\v]+\n', chr(10), 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def matching(t: str) -> str:
    t = f"regexp_replace({t}, '{char_class(rules.ZERO_WIDTH)}', '', 'g')"
    t = f"regexp_replace({t}, '{char_class(rules.SINGLE_QUOTES)}', '''', 'g')"
    t = f"regexp_replace({t}, '{char_class(rules.DOUBLE_QUOTES)}', '\"', 'g')"
    t = f"regexp_replace({t}, '{char_class(rules.ALL_HYPHENS)}', '-', 'g')"
    return rf"lower(trim(regexp_replace({t}, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')))"


PARTS["clean_docs"] = f"SELECT document_id, doc_id, title, raw_text, {clean_space(clean_hyphens(clean_encoding('raw_text')))} AS cleaned_text FROM raw_docs"
PARTS["page_lines"] = f"""
    SELECT document_id, page_number, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
    FROM (SELECT document_id, page_number, string_split(text, chr(10)) AS ls FROM raw_pages)"""
PARTS["cut_pages"] = f"""
    WITH filled AS (SELECT *, {strip('line')} AS bare FROM page_lines WHERE {strip('line')} <> ''),
    ends AS (SELECT document_id, page_number, min_by(bare, pos) AS top, max_by(bare, pos) AS bottom FROM filled GROUP BY 1, 2),
    total AS (SELECT document_id, count(*) AS n FROM raw_pages GROUP BY 1),
    often AS (SELECT document_id, top AS bare FROM ends GROUP BY 1, 2 HAVING count(*) >= (SELECT n // 2 + 1 FROM total t WHERE t.document_id = ends.document_id)
              UNION SELECT document_id, bottom FROM ends GROUP BY 1, 2 HAVING count(*) >= (SELECT n // 2 + 1 FROM total t WHERE t.document_id = ends.document_id))
    SELECT p.document_id, p.page_number, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n < 2 OR (o.bare IS NULL AND NOT {match(strip('line'), rules.PAGE_NUMBER_LINE)})), '') AS text
    FROM page_lines p JOIN total USING (document_id) LEFT JOIN often o ON o.document_id = p.document_id AND o.bare = {strip('line')}
    GROUP BY 1, 2"""

# -- segmentation ---------------------------------------------------------------------

_W = "(PARTITION BY document_id ORDER BY pos)"
_BEFORE = "(PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _group(pattern: str, n: int) -> str:
    return f"regexp_extract(line, {lit(pattern)}, {n})"


PARTS["doc_lines"] = f"""
    SELECT document_id, pos, {strip('l')} AS line
    FROM (SELECT document_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos
          FROM (SELECT document_id, string_split(cleaned_text, chr(10)) AS ls FROM clean_docs WHERE cleaned_text <> ''))"""
PARTS["kinds"] = f"""
    SELECT *, CASE WHEN line = '' THEN 'blank' WHEN is_paren THEN 'paren' WHEN is_sub THEN 'sub'
                   WHEN is_major AND n_words <= 12 THEN 'major' WHEN is_major THEN 'long'
                   WHEN is_lettered AND n_words <= 10 THEN 'lettered' WHEN as_upper THEN 'upper' ELSE 'body' END AS kind,
           NOT is_major AND {match('line', rules.DOCUMENT_TITLE)} AND {words('line')} <= 15 AS is_title
    FROM (SELECT *, {words('rest')} AS n_words,
                 {match('line', rules.UPPERCASE_LINE, 'c')} AND coalesce(lag(line) OVER {_W}, '') = '' AND coalesce(lead(line) OVER {_W}, '') = '' AS as_upper
          FROM (SELECT *, CASE WHEN is_paren THEN {_group(rules.PAREN_LINE, 1)} WHEN is_sub THEN {_group(rules.SUBSECTION_LINE, 1)}
                               WHEN is_major THEN {_group(rules.MAJOR_LINE, 1)} WHEN is_lettered THEN {_group(rules.LETTERED_LINE, 1)} END AS mark,
                       CASE WHEN is_paren THEN {strip(_group(rules.PAREN_LINE, 2))} WHEN is_sub THEN {strip(_group(rules.SUBSECTION_LINE, 2))}
                            WHEN is_major THEN {strip(_group(rules.MAJOR_LINE, 2))} WHEN is_lettered THEN {_group(rules.LETTERED_LINE, 2)} END AS rest
                FROM (SELECT *, {match('line', rules.PAREN_LINE, 'c')} AS is_paren, {match('line', rules.SUBSECTION_LINE, 'c')} AS is_sub,
                             {match('line', rules.MAJOR_LINE, 'c')} AS is_major, {match('line', rules.LETTERED_LINE, 'c')} AS is_lettered FROM doc_lines)))"""
PARTS["prefixed"] = f"SELECT *, bool_and(is_title OR kind = 'blank') OVER {_W} AS in_prefix FROM kinds"
PARTS["resolved"] = f"""
    SELECT * REPLACE (CASE WHEN eligible AND NOT coalesce(bool_or(eligible) OVER {_BEFORE}, false) THEN 'longmajor'
                           WHEN kind = 'long' AND as_upper THEN 'upper' WHEN kind = 'long' THEN 'body' ELSE kind END AS kind)
    FROM (SELECT *, kind = 'long' AND NOT coalesce(bool_or(kind IN ('major', 'lettered', 'upper')) OVER {_BEFORE}, false)
                    AND NOT coalesce(lag(kind IN ('body', 'long') OR (kind = 'paren' AND rest <> '') OR (kind = 'sub' AND n_words > 10)) OVER {_W}, false) AS eligible
          FROM (SELECT * REPLACE (CASE WHEN in_prefix THEN 'skip' ELSE kind END AS kind) FROM prefixed))"""
PARTS["carried"] = rf"""
    WITH parts AS (SELECT *, regexp_extract(rest, '^(.*?[.:])\s+(.*)$', ['head', 'tail']) AS cut FROM resolved),
    texts AS (SELECT *, CASE WHEN kind = 'body' THEN line WHEN kind = 'paren' AND rest <> '' THEN rest
                             WHEN kind = 'sub' AND n_words > 10 THEN rest WHEN kind = 'longmajor' AND cut.tail <> '' THEN cut.tail END AS body,
                     CASE WHEN kind IN ('major', 'lettered') THEN regexp_replace({strip("mark || '. ' || rest")}, '[.:\- ]+$', '')
                          WHEN kind = 'longmajor' THEN regexp_replace({strip("mark || '. ' || CASE WHEN cut.head <> '' THEN cut.head ELSE rest END")}, '[.:\- ]+$', '')
                          WHEN kind = 'upper' THEN line END AS major_here,
                     CASE WHEN kind = 'sub' AND n_words > 10 THEN mark WHEN kind = 'sub' THEN {strip("mark || ' ' || rest")} END AS sub_here
              FROM parts),
    numbered AS (SELECT *, body IS NOT NULL AND (kind <> 'body' OR NOT coalesce(lag(body IS NOT NULL) OVER {_W}, false)) AS starts FROM texts),
    marks AS (SELECT *, sum(starts::INT) OVER {_W} AS block,
                     max(CASE WHEN major_here IS NOT NULL THEN pos END) OVER {_W} AS major_pos,
                     max(CASE WHEN kind = 'sub' THEN pos END) OVER {_W} AS sub_pos,
                     max(CASE WHEN kind = 'paren' AND rest = '' THEN pos END) OVER {_BEFORE} AS paren_pos,
                     max(CASE WHEN kind = 'sub' OR major_here IS NOT NULL OR body IS NOT NULL THEN pos END) OVER {_BEFORE} AS reset_pos FROM numbered)
    SELECT m.document_id, m.pos, m.block::BIGINT AS block, m.body, m.kind, a.major_here AS major,
           CASE WHEN m.sub_pos > coalesce(m.major_pos, -1) THEN s.sub_here END AS sub,
           CASE WHEN m.kind = 'paren' THEN m.mark WHEN m.kind = 'body' AND m.paren_pos > coalesce(m.reset_pos, -1) THEN p.mark END AS paren
    FROM marks m LEFT JOIN texts a ON a.document_id = m.document_id AND a.pos = m.major_pos
    LEFT JOIN texts s ON s.document_id = m.document_id AND s.pos = m.sub_pos
    LEFT JOIN texts p ON p.document_id = m.document_id AND p.pos = m.paren_pos"""


def inline_title(body: str) -> str:
    lead = f"regexp_extract({body}, {lit(rules.INLINE_TITLE)}, 1, 's')"
    return f"CASE WHEN {lead} <> '' AND {words(lead)} <= 6 THEN {strip(lead)} ELSE 'General' END"


PARTS["blocks"] = f"""
    SELECT document_id, block, CASE WHEN heads <> '' THEN heads ELSE {inline_title('body')} END AS section_title, body
    FROM (SELECT document_id, block, {strip("string_agg(body, ' ' ORDER BY pos)")} AS body,
                 concat_ws(' - ', min_by(major, pos) FILTER (WHERE at_start), min_by(sub, pos) FILTER (WHERE at_start),
                           '(' || (min_by(paren, pos) FILTER (WHERE at_start)) || ')') AS heads
          FROM (SELECT *, pos = min(pos) OVER (PARTITION BY document_id, block) AS at_start FROM carried WHERE body IS NOT NULL)
          GROUP BY 1, 2) WHERE body <> ''"""
PARTS["chunks"] = rf"""
    SELECT document_id, block, section_title, unnest(texts) AS text, generate_subscripts(texts, 1) AS chunk
    FROM (SELECT *, CASE WHEN {words('body')} <= 250 THEN [body] ELSE list_append(packed.done, packed.open) END AS texts
          FROM (SELECT *, list_reduce(list_transform(
                    string_split(regexp_replace(body, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
                    lambda s: {{'done': []::VARCHAR[], 'open': s, 'n': {words('s')}}}),
                    lambda a, x: CASE WHEN a.n + x.n > 250
                        THEN {{'done': list_append(a.done, a.open), 'open': x.open, 'n': x.n}}
                        ELSE {{'done': a.done, 'open': a.open || ' ' || x.open, 'n': a.n + x.n}} END) AS packed
                FROM blocks))"""
PARTS["paragraphs"] = f"""
    SELECT document_id, {inline_title('p')} AS section_title, p AS text, pos
    FROM (SELECT document_id, {strip('l')} AS p, pos
          FROM (SELECT document_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos
                FROM (SELECT document_id, string_split(cleaned_text, chr(10) || chr(10)) AS ls FROM clean_docs))) WHERE p <> ''"""
PARTS["segments"] = """
    SELECT document_id, section_title, text, n::INT AS clause_index, document_id || '_clause_' || printf('%03d', n) AS clause_id
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block, chunk) AS n
          FROM (SELECT document_id, block, chunk, section_title, text FROM chunks
                UNION ALL SELECT document_id, pos, 0, section_title, text FROM paragraphs
                          WHERE document_id NOT IN (SELECT document_id FROM blocks)))"""
PARTS["located"] = f"""
    SELECT s.document_id, s.clause_id, s.clause_index, s.section_title, s.text, spot.a::INT AS start_char, spot.b::INT AS end_char, spot.f AS found
    FROM (SELECT document_id, unnest(spots) AS spot, generate_subscripts(spots, 1) AS n
          FROM (SELECT document_id, list_reduce(
                    list_prepend({{'p': '', 'len': 0, 'hint': 0, 'spots': []::STRUCT(a BIGINT, b BIGINT, f BOOLEAN)[]}}, probes),
                    lambda z, x: CASE
                        WHEN instr(substr(raw_text, z.hint + 1), x.p) > 0
                        THEN {{'p': '', 'len': 0, 'hint': z.hint + instr(substr(raw_text, z.hint + 1), x.p) - 1 + x.len,
                               'spots': list_append(z.spots, {{'a': z.hint + instr(substr(raw_text, z.hint + 1), x.p) - 1, 'b': z.hint + instr(substr(raw_text, z.hint + 1), x.p) - 1 + x.len, 'f': true}})}}
                        WHEN instr(raw_text, x.p) > 0
                        THEN {{'p': '', 'len': 0, 'hint': instr(raw_text, x.p) - 1 + x.len,
                               'spots': list_append(z.spots, {{'a': instr(raw_text, x.p) - 1, 'b': instr(raw_text, x.p) - 1 + x.len, 'f': true}})}}
                        ELSE {{'p': '', 'len': 0, 'hint': z.hint + x.len, 'spots': list_append(z.spots, {{'a': z.hint, 'b': z.hint + x.len, 'f': false}})}} END).spots AS spots
                FROM (SELECT document_id, list({{'p': {strip('left(text, 40)')}, 'len': length(text), 'hint': 0::BIGINT, 'spots': []::STRUCT(a BIGINT, b BIGINT, f BOOLEAN)[]}} ORDER BY clause_index) AS probes
                      FROM segments GROUP BY 1) JOIN clean_docs USING (document_id))) f
    JOIN segments s ON s.document_id = f.document_id AND s.clause_index = f.n"""

# -- attention, categories, vectors ---------------------------------------------------


def reasons(text: str, indicators) -> str:
    hits = ", ".join(f"CASE WHEN {match(text, p)} THEN {lit(r)} END" for p, r in indicators)
    return f"list_filter([{hits}], lambda r: r IS NOT NULL)"


def levels(source: str) -> str:
    return f"""
    SELECT * EXCLUDE (strong, weak), CASE WHEN len(strong) >= 2 THEN 'High Attention' WHEN len(strong) = 1 THEN 'Medium Attention'
                        WHEN len(weak) > 0 THEN 'Low Attention' ELSE 'Informational' END AS attention_level,
           CASE WHEN len(strong) > 0 THEN strong WHEN len(weak) > 0 THEN weak ELSE [{lit(rules.NO_INDICATOR_REASON)}] END AS attention_reasons
    FROM (SELECT *, {reasons('text', rules.STRONG_INDICATORS)} AS strong, {reasons('text', rules.WEAK_INDICATORS)} AS weak FROM {source})"""


PARTS["levelled"] = levels("clauses")


def vectors(source: str, key: str) -> str:
    """Signed-hash vectors of ``source(key, text)`` as ``(key, vec)``."""
    return f"""
    SELECT {key}, list((coalesce(v, 0) / CASE WHEN norm > 0 THEN norm ELSE 1 END)::FLOAT ORDER BY d) AS vec
    FROM (SELECT {key}, d, v, sqrt(sum(coalesce(v, 0) * coalesce(v, 0)) OVER (PARTITION BY {key})) AS norm
          FROM (SELECT {key}, d FROM {source}, range(64) AS r(d))
          LEFT JOIN (SELECT {key}, c // 2 AS d, sum(CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
                     FROM (SELECT {key}, ('0x' || substr(md5(w), 1, 5))::INT % 128 AS c
                           FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS w FROM {source}))
                     GROUP BY 1, 2) USING ({key}, d)) GROUP BY 1"""


DOT = "round(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9)"


def dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


PARTS["clause_vec"] = vectors("clauses", "clause_id")
PARTS["question_vec"] = vectors("(SELECT query_id, query AS text FROM questions)", "query_id")
PARTS["seeds"] = "SELECT * FROM (" + _values(
    (n, c, p) for n, c, p in (
        (100 * i + j, i, p) for i, cat in enumerate(rules.CATEGORIES) for j, p in enumerate(rules.CATEGORY_SEEDS[cat])
    )
) + ") AS t(seed, pos, text)"
PARTS["seed_vec"] = vectors("seeds", "seed")
PARTS["category_names"] = "SELECT * FROM (" + _values(enumerate(rules.CATEGORIES)) + ") AS t(pos, category)"


def keyword_hits(text: str, category: str) -> str:
    return " + ".join(f"{match(text, p)}::INT" for p in rules.CATEGORY_PATTERNS[category])


def scored(source: str, vec: str) -> str:
    hits = "[" + ", ".join(keyword_hits("text", c) for c in rules.CATEGORIES) + "]"
    return f"""
    SELECT *, greatest(0, least(1, CASE WHEN hits >= 2 THEN least(1.0::DOUBLE, 0.55::DOUBLE * semantic + 0.45::DOUBLE * least(1.0::DOUBLE, hits * 0.35::DOUBLE) + 0.08::DOUBLE)
                                        WHEN hits > 0 THEN 0.55::DOUBLE * semantic + 0.45::DOUBLE * least(1.0::DOUBLE, hits * 0.35::DOUBLE) ELSE semantic END)) AS score
    FROM (SELECT clause_id, pos, category, hits[pos + 1] AS hits, greatest(0.0::DOUBLE, least(1.0::DOUBLE, max({dot('v.vec', 's.vec')}))) AS semantic
          FROM (SELECT clause_id, {hits} AS hits FROM {source}) c JOIN {vec} v USING (clause_id), seed_vec s JOIN seeds USING (seed) JOIN category_names USING (pos)
          GROUP BY ALL)"""


def picked(source: str) -> str:
    return f"""
    SELECT clause_id, CASE WHEN top >= 0.32 THEN best ELSE 'General' END AS primary_category,
           CASE WHEN top >= 0.32 THEN array_to_string(coalesce(others, []), ', ') ELSE '' END AS secondary_categories, printf('%.2f', top)::DOUBLE AS category_confidence
    FROM (SELECT clause_id, max(score) FILTER (WHERE n = 1) AS top, max(category) FILTER (WHERE n = 1) AS best,
                 list(category ORDER BY n) FILTER (WHERE n > 1 AND score >= 0.28::DOUBLE AND best_score - score <= 0.18::DOUBLE) AS others
          FROM (SELECT *, row_number() OVER (PARTITION BY clause_id ORDER BY score DESC, pos) AS n, max(score) OVER (PARTITION BY clause_id) AS best_score FROM {source})
          GROUP BY 1)"""


PARTS["scores"] = scored("clauses", "clause_vec")
PARTS["picked"] = picked("scores")
PARTS["located_vec"] = vectors("located", "clause_id")
PARTS["located_scores"] = scored("located", "located_vec")
PARTS["located_picked"] = picked("located_scores")
PARTS["located_levels"] = levels("located")

# -- retrieval ------------------------------------------------------------------------

PARTS["synonyms"] = "SELECT * FROM (" + _values(
    (k, s) for k, v in rules.SYNONYMS.items() for s in v
) + ") AS t(head, synonym)"
PARTS["query_words"] = f"""
    SELECT query_id, list_filter(regexp_extract_all(lower(query), '[\\pL\\pM\\pN_]+'), lambda t: regexp_full_match(t, '[a-z]{{2,}}') AND NOT list_contains({_list(rules.STOP_WORDS)}, t)) AS tokens
    FROM questions"""
PARTS["query_synonyms"] = """
    SELECT q.query_id, any_value(q.tokens) AS tokens, coalesce(list(DISTINCT s.synonym) FILTER (WHERE s.synonym IS NOT NULL AND NOT list_contains(q.tokens, s.synonym)), []) AS synonyms
    FROM query_words q LEFT JOIN synonyms s ON list_contains(q.tokens, s.head) GROUP BY 1"""
PARTS["candidates"] = f"""
    SELECT * FROM (SELECT query_id, document_id, clause_id, clause_index, base_score, row_number() OVER (PARTITION BY query_id ORDER BY base_score DESC, clause_index) AS candidate_rank
                   FROM (SELECT q.query_id, c.document_id, c.clause_id, c.clause_index, {dot('qv.vec', 'cv.vec')} AS base_score
                         FROM questions q JOIN question_vec qv USING (query_id) JOIN clauses c USING (document_id) JOIN clause_vec cv USING (clause_id)))
    WHERE candidate_rank <= 20"""


def _hits(where: str, what: str) -> str:
    return f"len(list_filter({what}, lambda t: contains({where}, t)))"


def _boost_part(where: str, direct: str, indirect: str) -> str:
    return f"""CASE WHEN {_hits(where, 's.tokens')} > 0 THEN least({_hits(where, 's.tokens')}, 2) * {direct}::DOUBLE
                    WHEN {_hits(where, 's.synonyms')} > 0 THEN least({_hits(where, 's.synonyms')}, 2) * {indirect}::DOUBLE ELSE 0::DOUBLE END"""


PARTS["boosted"] = f"""
    SELECT k.*, c.section_title, c.text, c.primary_category, c.secondary_categories, c.attention_level, c.location,
           least({_boost_part('lower(c.section_title)', '0.08', '0.04')} + {_boost_part('lower(c.text)', '0.04', '0.02')}, 0.15::DOUBLE) AS boost
    FROM candidates k JOIN levelled c USING (document_id, clause_index, clause_id) JOIN query_synonyms s USING (query_id)"""
PARTS["hits"] = """
    SELECT *, similarity_score >= 0.35 AS meets_threshold
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, candidate_rank)::INT AS rank
          FROM (SELECT *, printf('%.4f', least(1, base_score + boost))::DOUBLE AS similarity_score FROM boosted)) WHERE rank <= 5"""
PARTS["relevant"] = "SELECT q.query_id, c.clause_id FROM questions q JOIN clauses c ON c.document_id = q.document_id AND c.expected_category = q.category"
PARTS["query_results"] = """
    SELECT q.query_id, q.document_id, coalesce(bool_or(h.meets_threshold), false) AS sufficient_evidence, count(h.clause_id) AS total_matches
    FROM questions q LEFT JOIN hits h USING (query_id) GROUP BY 1, 2"""

# -- relationships --------------------------------------------------------------------

_FLAGS = {
    "cancel": rules.CANCEL_ANYTIME, "renewal": rules.STRICT_RENEWAL, "modify": rules.MODIFY_NO_NOTICE,
    "notify": rules.NOTIFY_CHANGES, "immediate": rules.IMMEDIATE_TERMINATION, "cure": rules.CURE_PERIOD,
    "final_fee": rules.NON_REFUNDABLE, "refundable": rules.REFUND_ELIGIBLE, "f_overrides": rules.OVERRIDES,
    "f_excepts": rules.EXCEPTS, "f_depends_on": rules.DEPENDS_ON, "f_qualifies": rules.QUALIFIES, "f_temporal": rules.TEMPORAL,
}


def _label(prefix: str = "") -> str:
    t, c = f"{prefix}section_title", f"{prefix}primary_category"
    titled = f"({strip(t)} <> '' AND lower({strip(t)}) NOT IN ('general', 'pasted text', 'terms of service', 'unknown'))"
    filed = f"({strip(c)} <> '' AND lower({strip(c)}) NOT IN ('general', 'unknown'))"
    return f"""'Clause #' || {prefix}clause_index || CASE WHEN {titled} AND {filed} THEN ' (''' || {t} || ''' - ' || {c} || ')'
               WHEN {titled} THEN ' (''' || {t} || ''')' WHEN {filed} THEN ' (' || {c} || ')' ELSE '' END"""


PARTS["affinity"] = "SELECT * FROM (" + _values(sorted({
    pair for a, bs in rules.CATEGORY_AFFINITY.items() for b in bs for pair in ((a, b), (b, a))
})) + ") AS t(ca, cb)"
PARTS["features"] = f"""
    SELECT c.*, v.vec, list_filter({_list(rules.DOMAIN_KEYWORDS)}, lambda k: contains(lower(c.text), k)) AS kws,
           regexp_extract_all(c.text, {lit(rules.SECTION_REFERENCE)}, 1, 'i') AS refs,
           nullif(regexp_extract(c.section_title, {lit(rules.SECTION_HEADING_NUMBER)}, 1, 'i'), '') AS sec,
           {', '.join(f"{match('c.text', p)} AS {n}" for n, p in _FLAGS.items())},
           {_label('c.')} AS label
    FROM clauses c JOIN clause_vec v USING (clause_id)"""
PARTS["owners"] = "SELECT document_id, sec, max(clause_index) AS owner FROM features WHERE sec IS NOT NULL GROUP BY 1, 2"
PARTS["owned"] = "SELECT f.*, o.sec AS own FROM features f LEFT JOIN owners o ON o.document_id = f.document_id AND o.owner = f.clause_index"


def _either(x: str, y: str) -> str:
    return f"((a.{x} AND b.{y}) OR (b.{x} AND a.{y}))"


PARTS["sizes"] = "SELECT document_id, count(*) AS n FROM clauses GROUP BY 1"
PARTS["signals"] = f"""
    SELECT a.document_id, a.clause_index AS i, b.clause_index AS j, z.n,
           list_concat(list_filter(a.refs, lambda r: r = b.own), list_filter(b.refs, lambda r: r = a.own)) AS cross_refs,
           a.primary_category AS ca, b.primary_category AS cb,
           a.primary_category = b.primary_category AND a.primary_category <> 'General' AS same_cat,
           (a.primary_category, b.primary_category) IN (SELECT (ca, cb) FROM affinity) AS friends,
           list_sort(list_intersect(a.kws, b.kws)) AS shared, {dot('a.vec', 'b.vec')} AS cos,
           {_either('cancel', 'renewal')} AS e1, {_either('modify', 'notify')} AS e2, a.f_temporal AND b.f_temporal AS e3,
           a.f_excepts OR b.f_excepts AS e4, a.f_qualifies OR b.f_qualifies AS e5
    FROM owned a JOIN owned b ON a.document_id = b.document_id AND a.clause_index < b.clause_index JOIN sizes z ON z.document_id = a.document_id"""
PARTS["pair_scores"] = """
    SELECT *, CASE WHEN n <= 5 AND raw < 0.2 THEN 0.3::DOUBLE ELSE raw END AS score
    FROM (SELECT *, linked + CASE WHEN e4 THEN CASE WHEN linked > 0 OR n <= 5 THEN 0.30::DOUBLE ELSE 0.15::DOUBLE END ELSE 0::DOUBLE END
                           + CASE WHEN e5 THEN CASE WHEN linked > 0 OR n <= 5 THEN 0.30::DOUBLE ELSE 0.15::DOUBLE END ELSE 0::DOUBLE END AS raw
          FROM (SELECT *, list_reduce(list_prepend(0::DOUBLE, list_transform(cross_refs, lambda r: 0.40::DOUBLE)), lambda s, x: s + x)
                        + CASE WHEN same_cat THEN 0.35::DOUBLE WHEN friends THEN 0.30::DOUBLE ELSE 0::DOUBLE END
                        + CASE WHEN len(shared) >= 2 THEN 0.25::DOUBLE WHEN len(shared) = 1 THEN 0.15::DOUBLE ELSE 0::DOUBLE END
                        + CASE WHEN cos >= 0.55 THEN 0.25::DOUBLE ELSE 0::DOUBLE END + CASE WHEN e1 THEN 0.40::DOUBLE ELSE 0::DOUBLE END
                        + CASE WHEN e2 THEN 0.40::DOUBLE ELSE 0::DOUBLE END + CASE WHEN e3 THEN 0.35::DOUBLE ELSE 0::DOUBLE END AS linked
                FROM signals))"""
PARTS["clause_cut"] = """
    SELECT *, CASE WHEN len(r) = 0 THEN ['Document-level candidate pairing'] ELSE r END AS reasons
    FROM (SELECT *, list_concat(list_transform(cross_refs, lambda x: 'Explicit cross-reference to Section ' || x), list_filter([
                 CASE WHEN same_cat THEN 'Shared category (' || ca || ')' WHEN friends THEN 'High-affinity category pairing (' || ca || ' ' || chr(8596) || ' ' || cb || ')' END,
                 CASE WHEN len(shared) >= 2 THEN 'Shared domain concepts: ' || array_to_string(shared[1:3], ', ') END,
                 CASE WHEN cos >= 0.55 THEN printf('Semantic similarity score %.2f', cos) END,
                 CASE WHEN e1 THEN 'Cancellation vs auto-renewal tension trigger' END, CASE WHEN e2 THEN 'Modification vs change notice tension trigger' END,
                 CASE WHEN e3 THEN 'Both clauses contain temporal/timing indicators' END, CASE WHEN e4 THEN 'Exception trigger phrasing present' END,
                 CASE WHEN e5 THEN 'Qualifying proviso phrasing present' END], lambda x: x IS NOT NULL)) AS r,
                 row_number() OVER (PARTITION BY document_id, i ORDER BY score DESC, j) AS m
          FROM pair_scores WHERE score >= 0.25 OR n <= 5) WHERE m <= 10"""
PARTS["pairs"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, i, j)::INT AS candidate_rank FROM clause_cut) WHERE candidate_rank <= 500"""
PARTS["narrow"] = "SELECT document_id, i, j, candidate_rank, same_cat, friends, len(shared) AS n_shared FROM pairs"
PARTS["ways"] = f"""
    SELECT p.document_id, p.i, p.j, p.candidate_rank, p.reverse, s.clause_id AS s_id, t.clause_id AS t_id,
           p.same_cat OR p.friends OR p.n_shared > 0 OR abs(p.i - p.j) <= 1 OR len(s.refs) > 0 AS near,
           s.f_overrides, s.f_excepts, s.f_depends_on, s.f_qualifies, s.f_temporal AND t.f_temporal AS f_temporal,
           len(list_filter(s.refs, lambda r: contains(t.section_title, r))) > 0 AS refers,
           s.cancel, t.renewal, s.modify, t.notify, s.immediate, t.cure, s.final_fee, t.refundable
    FROM (SELECT *, false AS reverse, i AS src, j AS tgt FROM narrow UNION ALL SELECT *, true, j, i FROM narrow) p
    JOIN features s ON s.document_id = p.document_id AND s.clause_index = p.src
    JOIN features t ON t.document_id = p.document_id AND t.clause_index = p.tgt"""


def _directed() -> str:
    out = []
    for n, (name, confidence, _) in enumerate(rules.DIRECTED_RULES):
        near = "" if name == "TEMPORAL" else " AND near"
        out.append(f"SELECT *, {lit(name)} AS type, {confidence}::DOUBLE AS confidence, {n} AS ord FROM ways WHERE f_{name.lower()}{near}")
    return " UNION ALL ".join(out)


PARTS["directed"] = f"""
    WITH fired AS ({_directed()})
    SELECT * FROM fired UNION ALL
    SELECT *, 'SUPPORTS', 0.68::DOUBLE, 5 FROM ways w WHERE refers
      AND NOT EXISTS (SELECT 1 FROM fired f WHERE f.document_id = w.document_id AND f.i = w.i AND f.j = w.j AND f.reverse = w.reverse)"""
_TENSIONS = " ".join(
    f"WHEN {a} AND {b} THEN {n}" for n, (a, b, *_rest) in enumerate(rules.TENSION_RULES)
)
PARTS["tensions"] = f"""
    SELECT * EXCLUDE (h, best), 'POTENTIAL_TENSION' AS type, list_extract([{', '.join(str(r[2]) for r in rules.TENSION_RULES)}]::DOUBLE[], h + 1) AS confidence, h
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id, i, j ORDER BY h, reverse) AS best
          FROM ({" UNION ALL ".join(f"SELECT *, {n} AS h FROM ways WHERE {a} AND {b}" for n, (a, b, *_r) in enumerate(rules.TENSION_RULES))})) WHERE best = 1"""


def _rationale(template: str) -> str:
    parts = re.split(r"(\{[stg]\})", template)
    names = {"{s}": "s_label", "{t}": "t_label", "{g}": "trigger"}
    return " || ".join(names.get(p, lit(p)) for p in parts if p)


PARTS["edges"] = """
    SELECT document_id, i, j, candidate_rank, reverse, s_id, t_id, type, confidence, ord + CASE WHEN reverse THEN 10 ELSE 0 END AS ord, -1 AS h
    FROM directed d WHERE NOT reverse OR NOT EXISTS (
        SELECT 1 FROM directed e WHERE e.document_id = d.document_id AND e.i = d.i AND e.j = d.j AND e.type = d.type AND NOT e.reverse)
    UNION ALL SELECT document_id, i, j, candidate_rank, reverse, s_id, t_id, type, confidence, 20, h FROM tensions"""
_TRIGGER = "CASE WHEN type = 'SUPPORTS' THEN 'Section reference in text' " + " ".join(
    f"WHEN type = {lit(n)} THEN {first('s_text', p)}" for n, p in (
        ("OVERRIDES", rules.OVERRIDES), ("EXCEPTS", rules.EXCEPTS), ("DEPENDS_ON", rules.DEPENDS_ON),
        ("QUALIFIES", rules.QUALIFIES), ("TEMPORAL", rules.TEMPORAL))
) + " " + " ".join(f"WHEN h = {n} THEN {lit(r[3])}" for n, r in enumerate(rules.TENSION_RULES)) + " END"
_RATIONALE = "CASE " + " ".join(
    f"WHEN type = {lit(n)} THEN {_rationale(t)}" for n, _, t in rules.DIRECTED_RULES + [rules.SUPPORTS_RULE]
) + " " + " ".join(f"WHEN h = {n} THEN {_rationale(r[4])}" for n, r in enumerate(rules.TENSION_RULES)) + " END"
PARTS["strongest"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, candidate_rank, ord)::INT AS rank FROM edges)
    WHERE rank <= 100"""
PARTS["described"] = """
    SELECT e.*, s.text AS s_text, t.text AS t_text, s.label AS s_label, t.label AS t_label, s.location AS s_loc, t.location AS t_loc
    FROM strongest e JOIN features s ON s.clause_id = e.s_id JOIN features t ON t.clause_id = e.t_id"""
PARTS["relationships"] = f"""
    SELECT 'rel_' || left(sha256(s_id || '_' || t_id || '_' || type), 8) AS relationship_id, document_id, s_id AS source_clause_id, t_id AS target_clause_id,
           type AS relationship_type, confidence, {_RATIONALE} AS rationale, trigger, s_loc, t_loc, rank, s_text, t_text
    FROM (SELECT *, {_TRIGGER} AS trigger FROM described)"""

def _again(prefix: str, steps: list[str], sources: list[str]) -> None:
    """The same steps over other sources, all under names with a prefix."""
    names = "|".join(sources + steps)
    for name in steps:
        PARTS[prefix + name] = re.sub(rf"\b(FROM|JOIN) ({names})\b", rf"\1 {prefix}\2", PARTS[name])


# Paged documents: their pages in order are the raw text, the pages without running lines the cleaned one.
PARTS["page_ranges"] = """
    SELECT document_id, page_number, text, (e - length(text))::INT AS char_start, e::INT AS char_end
    FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS e FROM raw_pages)"""
PARTS["paged_clean_docs"] = f"""
    SELECT document_id, raw_text, {clean_space(clean_hyphens(clean_encoding('t')))} AS cleaned_text
    FROM (SELECT document_id, string_agg(text, chr(10) ORDER BY page_number) AS raw_text FROM raw_pages GROUP BY 1)
    JOIN (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS t FROM cut_pages GROUP BY 1) USING (document_id)"""
_again("paged_", ["doc_lines", "kinds", "prefixed", "resolved", "carried", "blocks", "chunks", "paragraphs", "segments", "located"], ["clean_docs"])
PARTS["on_pages"] = """
    SELECT l.clause_id, l.start_char, l.end_char, l.found,
           coalesce(max(p.page_number) FILTER (WHERE l.found AND l.start_char BETWEEN p.char_start AND p.char_end), 1) AS first_page,
           coalesce(max(p.page_number) FILTER (WHERE l.found AND l.end_char BETWEEN p.char_start AND p.char_end), 1) AS last_page
    FROM paged_located l JOIN page_ranges p USING (document_id) GROUP BY ALL"""

# The same steps over chosen clauses, whose indexes have gaps: names with the prefix ``chosen_``.
_CHAIN = [
    "features", "owners", "owned", "sizes", "signals", "pair_scores", "clause_cut", "pairs", "narrow", "ways", "directed", "tensions",
    "edges", "strongest", "described", "relationships",
]
PARTS["chosen_clauses"] = "SELECT * FROM clauses WHERE primary_category <> 'General'"
_again("chosen_", _CHAIN, ["clauses"])


def sql(final: str) -> str:
    """``final`` with every step it needs, in the order in which ``PARTS`` defines them."""
    order = list(PARTS)

    def needs(text: str) -> set[str]:
        return {p for p in order if re.search(rf"(?:\bFROM|\bJOIN|,)\s*\(?{p}\b", text)}

    wanted, todo = set(), needs(final)
    while todo:
        part = todo.pop()
        if part not in wanted:
            wanted.add(part)
            todo |= needs(PARTS[part])
    steps = ",\n".join(f"{p} AS MATERIALIZED ({PARTS[p]})" for p in order if p in wanted)
    return f"WITH {steps}\n{final}" if steps else final
