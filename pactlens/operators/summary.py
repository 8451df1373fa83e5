"""Document summaries (D1-D13): aggregates that reduce before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.operators.relate import clause_label  # noqa: F401  (sibling of D13)


def _round(x: Column) -> Column:
    """Half goes up."""
    return F.floor(x + 0.5)


def attention_counts(clauses: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """Clauses per level and relationships of every document."""
    level = F.col("attention_level")
    counts = clauses.groupBy("document_id").agg(
        F.count("*").alias("n_clauses"),
        F.count_if(level == rules.HIGH).alias("n_high"), F.count_if(level == rules.MEDIUM).alias("n_medium"),
        F.count_if(level == rules.LOW).alias("n_low"), F.count_if(level == rules.INFORMATIONAL).alias("n_info"),
    ).withColumn("n_standard", F.col("n_low") + F.col("n_info"))
    if relationships is None:
        return counts.withColumn("n_relationships", F.lit(0).cast("long"))
    edges = relationships.groupBy("document_id").agg(F.count("*").alias("n_relationships"))
    return counts.join(edges, "document_id", "left").fillna(0, ["n_relationships"])


def exposure(counts: DataFrame) -> DataFrame:
    """Score, verdict, flag ratio, percentages and default view of D1 rows."""
    total = F.greatest("n_clauses", F.lit(1))
    h, m, l = F.col("n_high"), F.col("n_medium"), F.col("n_low")
    raw = F.least(F.lit(100), _round((h * 30 + m * 10 + l * 2) / total * 20 + F.least(F.lit(15.0), F.col("n_relationships") * 1.5)))
    score = (
        F.when((h == 0) & (m == 0), F.least(F.lit(15), raw)).when(h > 0, F.greatest(F.lit(65), raw))
        .otherwise(F.greatest(F.lit(38), F.least(F.lit(60), raw)))
    )
    percent = lambda n: _round(n / total * 100)
    return counts.withColumn("score", score.cast("long")).withColumns({
        "verdict": F.when(F.col("score") < 30, "Standard Agreement").when(F.col("score") <= 60, "Moderate Caution")
        .otherwise("Critical Traps Detected"),
        "flag_ratio": percent(h + m), "pct_high": percent(h), "pct_medium": percent(m),
        "pct_low": percent(l), "pct_info": percent(F.col("n_info")),
        "relationship_bar": F.least(F.lit(100), F.col("n_relationships")),
        "default_view": F.when(h > 0, rules.HIGH).when(m > 0, rules.MEDIUM).otherwise("ALL"),
    })


def category_distribution(clauses: DataFrame) -> DataFrame:
    """Clauses per category of a document, most frequent first, with their share."""
    counts = clauses.groupBy("document_id", F.coalesce("primary_category", F.lit(rules.GENERAL)).alias("category")).agg(
        F.count("*").alias("n"), F.min("clause_index").alias("first_seen")
    )
    per_document = Window.partitionBy("document_id")
    return counts.withColumns({
        "share": F.col("n") / F.sum("n").over(per_document),
        "position": F.row_number().over(per_document.orderBy(F.desc("n"), "first_seen")),
    })


def exposure_matrix(clauses: DataFrame) -> DataFrame:
    """The state of every exposure domain of every document, in one pass."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    aggs, made = [], []
    for name, category, keywords in rules.EXPOSURE_DOMAINS:
        hit = F.coalesce(F.col("primary_category") == category, F.lit(False))
        for k in keywords:
            hit = hit | F.col("_lower").contains(k)
        level = F.col("attention_level")
        aggs += [
            F.count_if(hit).alias(f"{name}_n"), F.count_if(hit & (level == rules.HIGH)).alias(f"{name}_h"),
            F.count_if(hit & (level == rules.MEDIUM)).alias(f"{name}_m"),
        ]
        made.append(F.struct(
            F.lit(name).alias("domain"), F.col(f"{name}_n").alias("matches"),
            F.when(F.col(f"{name}_h") > 0, "Flagged")
            .when((F.col(f"{name}_m") > 0) | (F.col(f"{name}_n") > 2), "Notable").otherwise("Guarded").alias("state"),
        ))
    counted = clauses.withColumn("_lower", lower).groupBy("document_id").agg(*aggs)
    return counted.select("document_id", F.inline(F.array(*made)))


def level_strip(clauses: DataFrame, width: int = 1000) -> DataFrame:
    """The levels of a document in clause order, in segments of at most ``width`` clauses."""
    segment = F.floor((F.col("clause_index") - 1) / width).cast("int")
    packed = clauses.groupBy("document_id", segment.alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("clause_index", "attention_level"))).alias("rows")
    )
    return packed.select("document_id", "segment", F.transform("rows", lambda r: r["attention_level"]).alias("levels"))


def filter_clauses(clauses: DataFrame, query: str = "", category: str = "ALL", level: str = "ALL") -> DataFrame:
    """Free text, category and level filters, all of which have to hold."""
    rows = clauses
    q = query.lower().strip()
    if q:
        rows = rows.where(
            F.lower("text").contains(q) | F.coalesce(F.lower("section_title").contains(q), F.lit(False))
            | F.exists("attention_reasons", lambda r: F.lower(r).contains(q))
        )
    if category != "ALL":
        rows = rows.where(
            F.coalesce(F.col("primary_category") == category, F.lit(False)) | F.array_contains("secondary_categories", category)
        )
    key, name = level.upper(), F.upper(F.coalesce("attention_level", F.lit("")))
    if key == "STANDARD":
        return rows.where(name.contains("LOW") | name.contains("INFO"))
    if key != "ALL":
        part = next((p for p in ("HIGH", "MED", "LOW", "INFO") if p in key), None)
        return rows.where(name.contains(part) if part else name == key)
    return rows


def _ends(relationships: DataFrame) -> DataFrame:
    return relationships.select(
        "document_id", "relationship_id", "rank",
        F.posexplode(F.array(
            F.struct(F.col("source_clause_id").alias("clause_id"), F.col("target_clause_id").alias("other_id")),
            F.struct(F.col("target_clause_id").alias("clause_id"), F.col("source_clause_id").alias("other_id")),
        )).alias("side", "e"),
    ).select("document_id", "relationship_id", "rank", "side", "e.*")


def relationship_counts(relationships: DataFrame) -> DataFrame:
    """Relationships per clause, whichever end it is."""
    return _ends(relationships).groupBy("document_id", "clause_id").agg(F.count("*").alias("n_relationships"))


def related_clauses(relationships: DataFrame, clauses: DataFrame) -> DataFrame:
    """For every clause the clauses at the other end, with their titles."""
    titles = clauses.select("document_id", F.col("clause_id").alias("other_id"), F.col("section_title").alias("other_title"))
    return _ends(relationships).join(titles, ["document_id", "other_id"], "left").select(
        "document_id", "clause_id", "relationship_id", "other_id", F.coalesce("other_title", "other_id").alias("other_title")
    )


def graph_nodes(relationships: DataFrame, limit: int = 24) -> DataFrame:
    """The first clauses to appear in the ranked relationships of a document."""
    seen = _ends(relationships).groupBy("document_id", "clause_id").agg(
        F.min(F.col("rank") * 2 + F.col("side")).alias("first_seen")
    )
    order = Window.partitionBy("document_id").orderBy("first_seen")
    return seen.withColumn("node", F.row_number().over(order)).where(F.col("node") <= limit).drop("first_seen")


def graph_edges(relationships: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """The first relationships both ends of which are nodes."""
    def end(name: str) -> DataFrame:
        return nodes.select("document_id", F.col("clause_id").alias(name))

    kept = relationships.join(end("source_clause_id"), ["document_id", "source_clause_id"], "left_semi").join(
        end("target_clause_id"), ["document_id", "target_clause_id"], "left_semi"
    )
    order = Window.partitionBy("document_id").orderBy("rank")
    return kept.withColumn("edge", F.row_number().over(order)).where(F.col("edge") <= limit)


def node_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connections of every node."""
    return nodes.join(relationship_counts(edges), ["document_id", "clause_id"], "left").select(
        "document_id", "clause_id", "node", F.coalesce("n_relationships", F.lit(0)).alias("degree")
    )


def display_title(index: Column, title: Column, category: Column, text: Column) -> Column:
    """Heading of a clause, with a snippet where title and category say nothing."""
    real = lambda c, generic: F.coalesce(T.strip(c) != "", F.lit(False)) & ~F.lower(T.strip(c)).isin(generic)
    titled, filed = real(title, rules.GENERIC_TITLES), real(category, rules.GENERIC_CATEGORIES)
    head = F.concat(F.lit("Clause #"), index.cast("string"))
    clean = T.strip(F.regexp_replace(text, rf"(?U){T.WS}+", " "))
    snippet = F.when(F.length(clean) > 28, F.concat(F.left(clean, F.lit(28)), F.lit("..."))).otherwise(clean)
    return (
        F.when(titled & filed, F.concat(head, F.lit(": "), title, F.lit(" ("), category, F.lit(")")))
        .when(titled, F.concat(head, F.lit(": "), title))
        .when(filed, F.concat(head, F.lit(" ("), category, F.lit(")")))
        .when(F.coalesce(text, F.lit("")) != "", F.concat(head, F.lit(': "'), snippet, F.lit('"')))
        .otherwise(head)
    )
