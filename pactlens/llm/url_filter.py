"""URL filter by rules and link-graph propagation (operator 5).

Rules decide the urls they fit.  They also seed the graph: a host most of whose pages are
allowed is trusted, one most of whose pages are blocked is distrusted.  Trust is a
personalised PageRank along the links between hosts, distrust one along the reversed links;
a host is blocked where distrust exceeds trust by more than the threshold, both in units of what
one seed begins with.  In these units a host's ranks depend only on the seeds that reach it, so
hosts without a path to it, linked or seeds themselves, do not move its verdict.

Links are the absolute ``href`` targets of the pages, summed to one weighted edge per pair of
hosts before anything else, so a host with a third of all pages is one row.  Both ranks move
in the same join and sum; lineage is cut by a written table every few steps, and the steps
end when all that is still to be handed on could move no host by ``TOLERANCE`` mean ranks.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and
is allowed unless propagation says otherwise; null html has no links; links of a host to
itself do not count; rows that repeat count as often as they stand; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import forget, fresh, lower_ascii, written

#: (action, host, path), as the contract fixes them.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, STEPS_PER_TABLE = 0.85, 4
#: Distrust minus trust, in units of what one seed begins with, above which a host is blocked.  The only
#: host that links to a blocked one gets ``DAMPING`` of such a unit, each of two such hosts half of that.
THRESHOLD = 0.5
#: In units of the mean rank 1 / hosts: the most that steps not taken could still add to any host.
TOLERANCE = 1e-6

HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, action); null if none does.

    Rules are a bounded list of the caller, one comparison each.
    """
    chosen = F.lit(None).cast("struct<rule:string,action:string>")
    for action, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(action).alias("action"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, links: one row per ordered pair of different hosts."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    pairs = links.select("src", host_of(absolute).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagated(hosts: DataFrame, edges: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust of each host.

    ``hosts``: host, trusted, distrusted (booleans).  Every step hands a host's trust on along
    its links and its distrust back along the links to it; what a host without such links
    holds is not handed on.

    Ranks only grow, from the restart alone.  A step hands on at most ``damping`` of the last
    growth, so all later steps together add at most growth * damping / (1 - damping), to all
    hosts and so to any; the steps needed grow with the logarithm of the number of hosts.
    """
    if not 0 <= damping < 1 or not tolerance > 0:
        raise ValueError("damping must be in [0, 1) and tolerance above 0")
    spark = hosts.sparkSession
    counts = hosts.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("trusted"), 1)).alias("t"), F.count(F.when(F.col("distrusted"), 1)).alias("d")).first()
    seeds = hosts.select(
        "host", (F.col("trusted").cast("double") / max(1, counts["t"])).alias("t0"), (F.col("distrusted").cast("double") / max(1, counts["d"])).alias("d0")
    )
    out_of = edges.groupBy("src").agg(F.sum("links").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("into"))
    shares = edges.join(out_of, "src").join(into, "dst")
    moves, moves_path = written(
        shares.select(F.col("src").alias("giver"), F.col("dst").alias("host"), (F.col("links") / F.col("out")).alias("t"), F.lit(0.0).alias("d")).unionByName(
            shares.select(F.col("dst").alias("giver"), F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("links") / F.col("into")).alias("d"))
        )
    )
    first, first_path = written(seeds)
    restart = [((1 - damping) * F.col(c)) for c in ("t0", "d0")]
    ranks, path, step, rest = first.select("host", *[c.alias(n) for n, c in zip(("trust", "distrust", "new_t", "new_d"), restart * 2)]), None, 0, 1.0
    while path is None or rest * counts["n"] > tolerance:
        # The growth moves beside the ranks, so that a step reads its predecessor once.
        given = moves.join(ranks.withColumnRenamed("host", "giver"), "giver").groupBy("host").agg(*[
            F.sum(F.col(share) * F.col(held)).alias(f"g_{held}") for share, held in (("t", "trust"), ("d", "distrust"), ("t", "new_t"), ("d", "new_d"))
        ])
        handed = {held: damping * F.coalesce(f"g_{held}", F.lit(0.0)) for held in ("trust", "distrust", "new_t", "new_d")}
        ranks = first.join(given, "host", "left").select(
            "host", (restart[0] + handed["trust"]).alias("trust"), (restart[1] + handed["distrust"]).alias("distrust"),
            handed["new_t"].alias("new_t"), handed["new_d"].alias("new_d"),
        )
        step += 1
        if step % STEPS_PER_TABLE == 0:
            before = path
            ranks, path = written(ranks)
            if before:
                forget(spark, before)
            growth = ranks.agg(F.sum("new_t").alias("t"), F.sum("new_d").alias("d")).first()
            rest = max(growth["t"] or 0.0, growth["d"] or 0.0) * damping / (1 - damping)
    forget(spark, moves_path, first_path)
    return ranks.select("host", "trust", "distrust")


def judged(
    pages: DataFrame, *, url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD,
    damping: float = DAMPING, tolerance: float = TOLERANCE,
) -> DataFrame:
    """``pages`` with a struct column: host, path, rule, verdict, trust, distrust.

    The column is called ``judged``, or longer if that name is taken; it is the last one.
    """
    out = fresh(pages, "judged")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parts = pages.select(host.alias("host"), rule_of(host, path, rules)["action"].alias("action"))
    by_host = parts.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("action") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("action") == "block", 1)).alias("blocked")
    ).where("host <> ''")
    edges, edges_path = written(host_edges(pages, url_col=url_col, html_col=html_col))
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst"))
    hosts = by_host.select("host", (2 * F.col("allowed") > F.col("n")).alias("trusted"), (2 * F.col("blocked") > F.col("n")).alias("distrusted")).unionByName(
        linked.select("host", F.lit(False).alias("trusted"), F.lit(False).alias("distrusted"))
    ).groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("distrusted").alias("distrusted"))
    hosts, hosts_path = written(hosts)
    seeds = hosts.agg(F.count(F.when(F.col("trusted"), 1)).alias("t"), F.count(F.when(F.col("distrusted"), 1)).alias("d")).first()
    ranks = propagated(hosts, edges, damping=damping, tolerance=tolerance)
    forget(pages.sparkSession, edges_path, hosts_path)
    worse = (F.col("distrust") * seeds["d"] - F.col("trust") * seeds["t"]) / (1 - damping) > threshold
    verdicts = ranks.select(F.struct("host", "trust", "distrust", worse.alias("bad")).alias(out))
    rule = rule_of(host, path, rules)
    method = F.when(F.coalesce(F.col(f"{out}.bad"), F.lit(False)), "block").otherwise("allow")
    return pages.join(verdicts, host == F.col(f"{out}.host"), "left").withColumn(out, F.struct(
        host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), F.coalesce(rule["action"], method).alias("verdict"),
        F.coalesce(F.col(f"{out}.trust"), F.lit(0.0)).alias("trust"), F.coalesce(F.col(f"{out}.distrust"), F.lit(0.0)).alias("distrust"),
    ))
