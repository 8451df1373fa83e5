"""Typed relationships between clauses of one document.

Patterns and keywords are evaluated once per clause and packed into two integers.  The
pairs of a document are scored inside rows that hold two blocks of clauses (``pair_blocks``),
and a row hands on only the best partners of each clause; no row is ever made per pair.
A document of one block needs no shuffle beyond the one that packs it.  Longer documents
spread their block pairs over tasks, leave out those that cannot change the result, and
merge the partial rankings exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.functions import vectors as V
from pactlens.functions.joins import within_documents
from pactlens.functions.needles import occurring, occurs
from pactlens.operators import pair_blocks as P

# Bits of the flag column, one per pattern.
_FLAG_PATTERNS = {
    "cancel": rules.CANCEL_ANYTIME,
    "renewal": rules.STRICT_RENEWAL,
    "modify": rules.MODIFY_NO_NOTICE,
    "notify": rules.NOTIFY_CHANGES,
    "TEMPORAL": rules.TEMPORAL,
    "EXCEPTS": rules.EXCEPTS,
    "QUALIFIES": rules.QUALIFIES,
    "immediate": rules.IMMEDIATE_TERMINATION,
    "cure": rules.CURE_PERIOD,
    "final_fee": rules.NON_REFUNDABLE,
    "refundable": rules.REFUND_ELIGIBLE,
    "OVERRIDES": rules.OVERRIDES,
    "DEPENDS_ON": rules.DEPENDS_ON,
}
_BIT = {name: 1 << n for n, name in enumerate(_FLAG_PATTERNS)}
_TRIGGERS = {
    "OVERRIDES": rules.OVERRIDES, "EXCEPTS": rules.EXCEPTS, "DEPENDS_ON": rules.DEPENDS_ON,
    "QUALIFIES": rules.QUALIFIES, "TEMPORAL": rules.TEMPORAL,
}
_NAMES = [rules.GENERAL] + rules.CATEGORIES


def _affine(a: str, b: str) -> bool:
    return b in rules.CATEGORY_AFFINITY.get(a, []) or a in rules.CATEGORY_AFFINITY.get(b, [])


def section_number(title: Column) -> Column:
    """The number that opens a section title, null without one."""
    number = F.regexp_extract(title, T.java(rules.SECTION_HEADING_NUMBER, True), 1)
    return F.when(number != "", number)


def section_references(text: Column, may: Column | None = None) -> Column:
    """The numbers of all sections that a text refers to, repeats included; none where it may hold none."""
    found = F.regexp_extract_all(text, F.lit(T.java(rules.SECTION_REFERENCE, True)), F.lit(1))
    return found if may is None else F.when(may, found).otherwise(F.array().cast("array<string>"))


def keyword_mask(lower: Column) -> Column:
    """Bit ``n`` is set if the ``n``-th domain keyword occurs in the lower-case text."""
    mask = F.lit(0).cast("long")
    for n, word in enumerate(rules.DOMAIN_KEYWORDS):
        mask = mask + F.when(lower.contains(word), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def keywords_of(mask: Column) -> Column:
    """The domain keywords of a mask, in alphabetical order."""
    words = F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << n).cast("long")) != 0, w) for n, w in enumerate(rules.DOMAIN_KEYWORDS)
    ])
    return F.filter(words, lambda w: w.isNotNull())


def _first_keywords(mask: Column, most: int) -> Column:
    """The first domain keywords of a mask, in alphabetical order, with commas."""
    bit = lambda n: F.lit(1 << n).cast("long")
    named = [
        F.when((mask.bitwiseAND(bit(n)) != 0) & (F.bit_count(mask.bitwiseAND(F.lit((1 << n) - 1).cast("long"))) < most), F.lit(w))
        for n, w in enumerate(rules.DOMAIN_KEYWORDS)
    ]
    return F.concat_ws(", ", *named)


def clause_features(clauses: DataFrame) -> DataFrame:
    """Everything the pair rules ask about a clause, evaluated once per clause.

    One pass over the lower-case text finds the domain keywords and, for each pattern, whether one
    of its anchors occurs; the patterns are tried only there.
    """
    text, lower, marks = F.col("text"), F.lower(F.col("text")), F.col("_marks")
    words, anchored = len(rules.DOMAIN_KEYWORDS), [*_FLAG_PATTERNS.values(), rules.SECTION_REFERENCE]
    may = [occurs(marks, words + n) for n in range(len(anchored))]
    flags = F.lit(0)
    for (name, pattern), here in zip(_FLAG_PATTERNS.items(), may):
        flags = flags + F.when(here & text.rlike(T.java(pattern, True)), _BIT[name]).otherwise(0)
    category = F.coalesce("primary_category", F.lit(rules.GENERAL))
    number = F.array_position(F.array(*[F.lit(n) for n in _NAMES]), category).cast("int") - 1
    friends = F.array(*[
        F.lit(sum(1 << j for j, b in enumerate(_NAMES) if _affine(a, b))) for a in _NAMES
    ])
    # A text with a letter that only folding makes ASCII may hold every anchor.
    rows = clauses.withColumn("_marks", occurring(
        lower, [[w] for w in rules.DOMAIN_KEYWORDS] + [[*rules.ANCHORS[p], *T.FOLDED] for p in anchored]
    ))
    return rows.withColumns({
        "flags": flags, "kw": F.get(marks, F.lit(0)).bitwiseAND(F.lit((1 << words) - 1).cast("long")),
        "refs": section_references(text, may[-1]),
        "sec": section_number(F.coalesce("section_title", F.lit(""))), "cat": number,
        "friends": F.coalesce(F.get(friends, number), F.lit(0)),
    }).drop("_marks")


def section_owners(features: DataFrame) -> DataFrame:
    """(document, section number) with the last clause that carries it."""
    return features.where("sec is not null").groupBy("document_id", "sec").agg(
        F.max("clause_index").alias("clause_index")
    )


def _has(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(_BIT[name]) != 0


def _same_category(a: Column, b: Column) -> Column:
    return (a["cat"] == b["cat"]) & (a["cat"] != 0)


def _affine_categories(a: Column, b: Column) -> Column:
    return F.call_function("getbit", a["friends"], F.greatest(b["cat"], F.lit(0))) == 1


def _either_way(a: Column, b: Column, first: str, second: str) -> Column:
    return (_has(a, first) & _has(b, second)) | (_has(b, first) & _has(a, second))


def candidate_pairs(
    features: DataFrame,
    threshold: float = rules.SEMANTIC_PAIR_THRESHOLD,
    per_clause: int = rules.MAX_PAIRS_PER_CLAUSE,
    per_document: int = rules.MAX_PAIRS_PER_DOCUMENT,
    block: int = V.BLOCK,
) -> DataFrame:
    """``(document_id, i, j, score, candidate_rank, cross_refs, cos, a, b)``.

    ``features`` from ``clause_features`` with ``vec``, any subset of the clauses of a document;
    gaps in ``clause_index`` do not matter.  ``a`` and ``b`` are the narrow features of the two
    clauses, so the rules need no join back.  A cut that is ``None`` is not made.
    """
    per_clause, per_document = (c or (1 << 30) for c in (per_clause, per_document))
    short, long = P.packed_blocks(features, block)
    pairs = P.short_pairs(short, _BIT, threshold, per_clause, per_document)
    if long is not None:
        pairs = pairs.unionByName(P.long_pairs(long, _BIT, threshold, per_clause, per_document))
    return pairs.select("document_id", "i", "j", (-F.col("minus")).alias("score"), "candidate_rank", "cross_refs", "cos", "a", "b")


def candidate_reasons(pairs: DataFrame, threshold: float = rules.SEMANTIC_PAIR_THRESHOLD) -> DataFrame:
    """Adds ``reasons``, in the order in which the signals are looked at."""
    a, b = F.col("a"), F.col("b")
    names = F.array(*[F.lit(n) for n in _NAMES])
    cat = lambda c: F.get(names, c["cat"])
    both = a["kw"].bitwiseAND(b["kw"])
    any_flags = a["flags"].bitwiseOR(b["flags"])
    same, affine = _same_category(a, b), _affine_categories(a, b)
    signals = [
        (same, F.concat(F.lit("Shared category ("), cat(a), F.lit(")"))),
        (~same & affine, F.concat(F.lit("High-affinity category pairing ("), cat(a), F.lit(" \u2194 "), cat(b), F.lit(")"))),
        (F.bit_count(both) >= 2, F.concat(F.lit("Shared domain concepts: "), _first_keywords(both, 3))),
        (F.col("cos") >= threshold, F.format_string("Semantic similarity score %.2f", F.col("cos"))),
        (_either_way(a["flags"], b["flags"], "cancel", "renewal"), F.lit("Cancellation vs auto-renewal tension trigger")),
        (_either_way(a["flags"], b["flags"], "modify", "notify"), F.lit("Modification vs change notice tension trigger")),
        (_has(a["flags"], "TEMPORAL") & _has(b["flags"], "TEMPORAL"), F.lit("Both clauses contain temporal/timing indicators")),
        (_has(any_flags, "EXCEPTS"), F.lit("Exception trigger phrasing present")),
        (_has(any_flags, "QUALIFIES"), F.lit("Qualifying proviso phrasing present")),
    ]
    none = F.array().cast("array<string>")
    crossed = F.when(
        F.size("cross_refs") > 0, F.transform("cross_refs", lambda r: F.concat(F.lit("Explicit cross-reference to Section "), r))
    ).otherwise(none)
    bare = F.size("cross_refs") == 0
    for fired, _ in signals:
        bare = bare & ~fired
    # Arrays joined end to end: Spark interprets a filter over an array of all signals, and compiles this.
    reasons = F.concat(
        crossed, *[F.when(fired, F.array(reason)).otherwise(none) for fired, reason in signals],
        F.when(bare, F.array(F.lit("Document-level candidate pairing"))).otherwise(none),
    )
    return T.settle(pairs, {"reasons": reasons})


def clause_label(index: Column, title: Column, category: Column) -> Column:
    """A clause as a reader would name it; generic titles and categories are left out."""
    real = lambda c, generic: F.coalesce(T.strip(c) != "", F.lit(False)) & ~F.lower(T.strip(c)).isin(generic)
    titled, sorted_ = real(title, rules.GENERIC_TITLES), real(category, rules.GENERIC_CATEGORIES)
    head = F.concat(F.lit("Clause #"), index.cast("string"))
    return (
        F.when(titled & sorted_, F.concat(head, F.lit(" ('"), title, F.lit("' - "), category, F.lit(")")))
        .when(titled, F.concat(head, F.lit(" ('"), title, F.lit("')")))
        .when(sorted_, F.concat(head, F.lit(" ("), category, F.lit(")")))
        .otherwise(head)
    )


def _fill(template: str, s: Column, t: Column, g: Column) -> Column:
    """A rationale template with its parts put in."""
    filled, rest = [], template
    values = {"{s}": s, "{t}": t, "{g}": g}
    while rest:
        at = min((rest.find(k) for k in values if k in rest), default=-1)
        if at < 0:
            filled.append(F.lit(rest))
            break
        if at:
            filled.append(F.lit(rest[:at]))
        filled.append(values[rest[at:at + 3]])
        rest = rest[at + 3:]
    return F.concat(*filled)


def has_affinity(src: Column, tgt: Column) -> Column:
    """Topical connection that every directed rule but TEMPORAL asks for."""
    shared = src["kw"].bitwiseAND(tgt["kw"]) != 0
    near = F.abs(src["i"] - tgt["i"]) <= 1
    return (
        _same_category(src, tgt) | _affine_categories(src, tgt) | shared | near | (F.size(src["refs"]) > 0)
    )


_BACK, _TENSION = 10, 20  # where the numbers of the edges back and of tensions begin
_DIRECTED = [*rules.DIRECTED_RULES, rules.SUPPORTS_RULE]


def _directed(src: Column, tgt: Column) -> Column:
    """A bit for each directed rule that draws an edge from ``src`` to ``tgt``."""
    near, fired = has_affinity(src, tgt), F.lit(0)
    for n, (name, _, _) in enumerate(rules.DIRECTED_RULES):
        asked = _has(tgt["flags"], name) if name == "TEMPORAL" else near
        fired = fired + F.when(_has(src["flags"], name) & asked, 1 << n).otherwise(0)
    return fired


def _supported(fired: Column, src: Column, tgt: Column) -> Column:
    """The bits with that of SUPPORTS, which holds where no other rule does."""
    title = F.coalesce(tgt["section_title"], F.lit(""))
    refers = F.when((fired == 0) & (F.size(src["refs"]) > 0), F.exists(src["refs"], lambda r: title.contains(r))).otherwise(False)
    return fired + F.when(refers, 1 << len(rules.DIRECTED_RULES)).otherwise(0)


def _tension(a: Column, b: Column) -> Column:
    """The number of the first pair of opposite statements that holds, null if none does."""
    chain = F
    for n, (first, second, _, _, _) in enumerate(rules.TENSION_RULES):
        chain = chain.when(_either_way(a["flags"], b["flags"], first, second), n)
    return chain


def relationship_id(source: Column, target: Column, type_: Column) -> Column:
    """An id that depends on the ends and the type only."""
    return F.concat(F.lit("rel_"), F.left(F.sha2(F.concat_ws("_", source, target, type_), 256), F.lit(8)))


def pair_edges(pairs: DataFrame, min_confidence: float | None = rules.MIN_CONFIDENCE) -> DataFrame:
    """The typed edges of every pair, as narrow rows without text.

    The rules of a pair are bits, so Spark compiles the whole step but for the titles that SUPPORTS looks at.
    """
    a, b = F.col("a"), F.col("b")
    rows = pairs.select(
        "document_id", "i", "j", "candidate_rank", "a", "b", _directed(a, b).alias("forth"), _directed(b, a).alias("back"),
        _tension(a, b).alias("tension"),
    ).select(
        "document_id", "i", "j", "candidate_rank", _supported(F.col("forth"), a, b).alias("forth"),
        _supported(F.col("back"), b, a).alias("back"), "tension", a["flags"].alias("flags"),
    )
    # Of two edges of one type only the forward one stays.
    kept_back = F.col("back").bitwiseAND(F.bitwise_not("forth"))
    fired = F.col("forth").bitwiseOR(F.shiftleft(kept_back, _BACK)).bitwiseOR(F.when(F.col("tension").isNotNull(), 1 << _TENSION).otherwise(0))
    numbers = [*range(len(_DIRECTED)), *range(_BACK, _BACK + len(_DIRECTED)), _TENSION]
    edges = rows.select(
        "document_id", "i", "j", "candidate_rank", "tension", "flags", fired.alias("fired")
    ).withColumn("ord", F.explode(F.array(*[F.lit(n) for n in numbers]))).where("getbit(fired, ord) = 1")
    at, tense = F.col("ord") % _BACK, F.col("ord") == _TENSION
    of = lambda values: F.array(*[F.lit(v) for v in values])
    opens = F.lit(False)
    for n, (first, *_) in enumerate(rules.TENSION_RULES):
        opens = F.when(F.col("tension") == n, _has(F.col("flags"), first)).otherwise(opens)
    reverse = F.when(tense, ~opens).otherwise(F.col("ord") >= _BACK)
    return edges.select(
        "document_id", "i", "j", "candidate_rank",
        F.when(tense, "POTENTIAL_TENSION").otherwise(F.get(of([r[0] for r in _DIRECTED]), at)).alias("type"),
        F.when(tense, F.get(of([r[2] for r in rules.TENSION_RULES]), F.col("tension"))).otherwise(F.get(of([r[1] for r in _DIRECTED]), at)).alias("confidence"),
        reverse.alias("reverse"), "ord", F.when(tense, F.col("tension")).otherwise(-1).alias("tension"),
    ).select(
        "document_id", "candidate_rank", "type", "confidence", "reverse", "ord", "tension",
        F.when(F.col("reverse"), F.col("j")).otherwise(F.col("i")).alias("src"),
        F.when(F.col("reverse"), F.col("i")).otherwise(F.col("j")).alias("tgt"),
    ).where(F.col("confidence") >= (min_confidence or rules.MIN_CONFIDENCE))


def strongest_edges(edges: DataFrame, max_relationships: int = rules.MAX_RELATIONSHIPS) -> DataFrame:
    """At most so many edges per document, by confidence, then in order of emission."""
    order = Window.partitionBy("document_id").orderBy(F.desc("confidence"), "candidate_rank", "ord")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_relationships)


def describe_edges(edges: DataFrame, clauses: DataFrame) -> DataFrame:
    """Joins the clauses of an edge and adds id, trigger, rationale and evidence.

    Both joins are made where a document is: a text travels once, as a clause, and not with each of its edges.
    """
    ends = clauses.select(
        "document_id", "clause_index", "clause_id", "text", "source_location",
        clause_label(F.col("clause_index"), F.col("section_title"), F.col("primary_category")).alias("label"),
    )
    def end(name: str) -> DataFrame:
        return ends.select("document_id", "clause_index", F.struct(
            "clause_id", "text", "source_location", "label"
        ).alias(f"{name}_clause"))

    rows = edges
    for name in ("src", "tgt"):
        rows = within_documents(rows, end(name), name, "clause_index")
    s, t = F.col("src_clause"), F.col("tgt_clause")
    trigger = F.when(F.col("type") == "SUPPORTS", F.lit(rules.SUPPORTS_TRIGGER))
    for name, pattern in _TRIGGERS.items():
        trigger = trigger.when(F.col("type") == name, T.first_match(s["text"], pattern))
    for n, rule in enumerate(rules.TENSION_RULES):
        trigger = trigger.when(F.col("tension") == n, F.lit(rule[3]))
    rows = rows.withColumn("trigger", trigger)
    rationale = F
    for name, _, template in rules.DIRECTED_RULES + [rules.SUPPORTS_RULE]:
        rationale = rationale.when(F.col("type") == name, _fill(template, s["label"], t["label"], F.col("trigger")))
    for n, rule in enumerate(rules.TENSION_RULES):
        rationale = rationale.when(F.col("tension") == n, _fill(rule[4], s["label"], t["label"], F.col("trigger")))
    return rows.select(
        relationship_id(s["clause_id"], t["clause_id"], F.col("type")).alias("relationship_id"),
        "document_id", s["clause_id"].alias("source_clause_id"), t["clause_id"].alias("target_clause_id"),
        F.col("type").alias("relationship_type"), "confidence", rationale.alias("rationale"),
        F.struct(s["text"].alias("source_text"), t["text"].alias("target_text"), "trigger").alias("evidence"),
        s["source_location"].alias("source_location"), t["source_location"].alias("target_location"), "rank",
    )


def detect_relationships(
    clauses: DataFrame,
    min_confidence: float | None = rules.MIN_CONFIDENCE,
    max_relationships: int = rules.MAX_RELATIONSHIPS,
) -> DataFrame:
    """X1-X31 for classified clauses; encodes the text unless there is a ``vec`` column."""
    encoded = clauses if "vec" in clauses.columns else clauses.withColumn("vec", V.encode(F.col("text")))
    pairs = candidate_pairs(clause_features(encoded))
    return describe_edges(strongest_edges(pair_edges(pairs, min_confidence), max_relationships), clauses)


def check_limits(requests: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` to relationship requests out of range."""
    return requests.withColumn(
        "reject_reason",
        F.when(~F.col("max_relationships").between(1, 500), "max_relationships out of range")
        .when(~F.col("min_confidence").between(0.0, 1.0), "min_confidence out of range"),
    )


def run_metadata(pairs: DataFrame) -> DataFrame:
    """Candidate and evaluated pairs per document."""
    return pairs.groupBy("document_id").agg(
        F.count("*").alias("candidate_pairs"), F.count("*").alias("evaluated_pairs")
    )


def isolation_violations(clauses: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships with an end that is no clause of their document."""
    ends = relationships.select(
        "relationship_id", "document_id", F.explode(F.array("source_clause_id", "target_clause_id")).alias("clause_id")
    )
    return ends.join(clauses.select("document_id", "clause_id"), ["document_id", "clause_id"], "left_anti")
