"""Merkle manifest of a table with octopus multiproofs (operator 12).

Rows are leaves, each language is a tree, and the roots of the trees are the leaves of one
tree above them.  A node has up to eight children, its digest is the hash of theirs.

* Leaves are hashed where the texts are read; only digests travel.  They are numbered within
  their tree by ``numbered`` (range parts and offsets), so no task holds a whole language.
* Trees are built upwards in passes over chunks of ``SPAN`` neighbours; each pass writes the
  levels that lie inside a chunk.  The number of passes grows with the logarithm of the rows.
* Proofs: a leaf partition (``SPAN`` neighbours) works out the minimal union of coordinates
  (level, place) that its leaves need and that it cannot derive itself, fetches them once by
  a join, derives the interiors its leaves share, and expands each leaf's proof from them.
  A node near a root is asked for by many partitions: it stands in as many copies as keep
  the requests of one copy near ``REQUESTS``, so no join key is hot.

Digests are lower-case hex text.  Defined cases: a null field is encoded as ``-``; a null
language is a tree of its own, the first; rows with one id are ordered by their digest, equal
rows are leaves each; a null id comes first and is not tampered with; an empty table has no
rows; a very long text is hashed in one piece by its task, as any row; extra columns are not
part of a leaf and do not matter.  Tables written here stay in the folder of the checkpoints.
"""

from __future__ import annotations

import hashlib
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.numbering import numbered
from pactlens.llm.common import lower_ascii, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Children of a node are 8, so three bits of a place per level.  Leaves of a partition; requests of one copy of a node.
BITS, SPAN, REQUESTS = 3, 512, 1000
#: Up to this number of trees their table is broadcast, beyond it joined by a shuffle.
BROADCAST_TREES = 10_000
_TOP = "top"  # key of the tree of the roots; the others are "" (null) or "=" and the language
_PLACES = "tree string, level int, pos bigint, digest string, total bigint"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _encoded(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[_encoded(c.cast("string")) for c in (doc_id, source, lang, n_chars, text)]), 256)


def is_tampered(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, other): digests of the rows and of their tampered forms (else equal)."""
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = leaf_digest(*c.values())
    other = leaf_digest(*{**c, "text": lower_ascii(c["text"])}.values())
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf.alias("leaf"),
        F.when(is_tampered(c["doc_id"]) if tampered is None else tampered, other).alias("other"),
    ).withColumn("other", F.coalesce("other", "leaf"))


def _width(total: int, level: int) -> int:
    """Nodes of a level of a tree with ``total`` leaves."""
    return (total + (1 << BITS * level) - 1) >> BITS * level


def _climb(first_level: int, levels: int):
    def climb(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("pos")
        tree, total, at, digests = chunk["tree"].iat[0], int(chunk["total"].iat[0]), int(chunk["pos"].iat[0]), list(chunk["digest"])
        out = []
        for level in range(first_level, first_level + levels):
            if _width(total, level) <= 1:
                break
            digests = [sha("".join(digests[k:k + 8])) for k in range(0, len(digests), 8)]
            at >>= BITS
            out += [(tree, level + 1, at + k, d, total) for k, d in enumerate(digests)]
        return pd.DataFrame(out, columns=["tree", "level", "pos", "digest", "total"])

    return climb


def build(ground: DataFrame, largest: int, span: int = SPAN) -> DataFrame:
    """All nodes above ``ground(tree, pos, digest, total)``: (tree, level, pos, digest, total).

    ``largest`` is the number of leaves of the largest tree; ``span`` is a power of 8.
    """
    levels = (span.bit_length() - 1) // BITS
    rows, store, level = ground, None, 0
    while _width(largest, level) > 1:
        chunks = rows.select("tree", "pos", "digest", "total").groupBy("tree", F.floor(F.col("pos") / span).alias("chunk"))
        made, _ = written(chunks.applyInPandas(_climb(level, levels), _PLACES))
        store = made if store is None else store.unionByName(made)
        level += levels
        rows = made.where(F.col("level") == level)
    return store if store is not None else ground.select("tree", F.lit(0).alias("level"), "pos", "digest", "total").limit(0)


def _width_sql(total: str, level: str) -> str:
    return f"shiftright({total} + shiftleft(1L, {BITS} * {level}) - 1, {BITS} * {level})"


def missing_places(parts: DataFrame) -> DataFrame:
    """(tree, part, level, pos): what the leaves ``lo`` to ``hi`` of a part need and cannot derive.

    On each level these are the other children of the parents of the part's own nodes: at most
    seven on either side.
    """
    below = lambda x: f"shiftright({x}, {BITS} * level)"
    first, last = f"shiftleft(shiftright({below('lo')}, {BITS}), {BITS})", f"shiftleft(shiftright({below('hi')}, {BITS}), {BITS}) + 7"
    rows = parts.select("*", F.expr(f"explode(filter(sequence(0, 20), l -> {_width_sql('total', 'l')} > 1))").alias("level"))
    return rows.select("tree", "part", "level", F.explode(F.expr(f"""concat(
        if({first} < {below('lo')}, sequence({first}, {below('lo')} - 1), array()),
        if({below('hi')} < least({last}, {_width_sql('total', 'level')} - 1),
           sequence({below('hi')} + 1, least({last}, {_width_sql('total', 'level')} - 1)), array()))""")).alias("pos"))


def fetched(parts: DataFrame, nodes: DataFrame, span: int) -> DataFrame:
    """``parts(tree, part, lo, hi, total)`` with the digests of their missing places, as three arrays.

    ``span`` is the number of leaves of a part, so a node of a level is asked for by about
    8^(level + 1) / span parts, which decides into how many copies it is dealt.
    """
    copies = F.expr(f"int(shiftleft(1L, {BITS} * (level + 1)) div {span * REQUESTS}) + 1")
    asked = missing_places(parts).withColumn("salt", F.pmod(F.xxhash64("part"), copies))
    stored = nodes.select("tree", "level", "pos", "digest", F.explode(F.sequence(F.lit(0).cast("bigint"), (copies - 1).cast("bigint"))).alias("salt"))
    found = asked.join(stored, ["tree", "level", "pos", "salt"]).groupBy("tree", "part").agg(
        F.collect_list(F.struct("level", "pos", "digest")).alias("got")
    ).select("tree", "part", *[F.col(f"got.{c}").alias(f"{c}s") for c in ("level", "pos", "digest")])
    return parts.join(found, ["tree", "part"], "left")


def _runs(lo: int, digests: list[str], total: int, others: dict) -> tuple[list[dict[int, str]], str]:
    """Per level the joined digests of all runs above the given nodes, by place of the parent; and the root."""
    out, level = [], 0
    while (width := _width(total, level)) > 1:
        own = {lo + k: d for k, d in enumerate(digests)}
        parents = range(lo >> BITS, ((lo + len(digests) - 1) >> BITS) + 1)
        run = {p: "".join(own.get(q) or others[level, q] for q in range(p << BITS, min((p << BITS) + 8, width))) for p in parents}
        out.append(run)
        lo, digests, level = parents[0], [sha(run[p]) for p in parents], level + 1
    return out, digests[0]


def _without(run: str, place: int) -> str:
    at = (place & 7) * 64
    return run[:at] + run[at + 64:]


def _fold(digest: str, place: int, runs: list[dict[int, str]]) -> str:
    """The root above a digest at a place, recomputed from its siblings."""
    for run in runs:
        at, siblings = (place & 7) * 64, _without(run[place >> BITS], place)
        digest, place = sha(siblings[:at] + digest + siblings[at:]), place >> BITS
    return digest


def _expand(with_proof: bool):
    def expand(own: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        own, info = own.sort_values("pos"), part.iloc[0]

        def others(prefix: str) -> dict:
            levels, places, digests = (info[f"{prefix}{c}s"] for c in ("level", "pos", "digest"))
            return {} if levels is None else {(int(l), int(p)): d for l, p, d in zip(levels, places, digests)}

        lo, k = int(own["pos"].iat[0]), int(info["place"])
        runs, subroot = _runs(lo, list(own["leaf"]), int(info["total"]), others(""))
        above, root = _runs(k, [subroot], int(info["trees"]), others("top_"))
        # Suffixes of the proofs, shared by all leaves below a node.
        top, place = "", k
        for run in above:
            top, place = top + _without(run[place >> BITS], place), place >> BITS
        suffix: dict[int, str] = {0: top}
        for level in range(len(runs) - 1, -1, -1):
            first, last = lo >> BITS * level, (lo + len(own) - 1) >> BITS * level
            suffix = {q: _without(runs[level][q >> BITS], q) + suffix[q >> BITS] for q in range(first, last + 1)}
        out = []
        for doc_id, leaf, other, pos in zip(own["doc_id"], own["leaf"], own["other"], own["pos"]):
            proof, folded = suffix[int(pos)], _fold(_fold(other, int(pos), runs), k, above)
            out.append((doc_id, leaf, subroot, root, sha(proof), folded, folded == root, *([proof] if with_proof else [])))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * with_proof])

    return expand


def manifest(docs: DataFrame, *, span: int = SPAN, with_proof: bool = False, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, source, lang, n_chars, text)``: its leaf, the roots, the proof's digest.

    ``folded_root`` is the root recomputed from the tampered leaf (else the leaf) and the siblings of
    the original; ``verified`` says whether it is the root.  ``with_proof`` adds the proof itself:
    the siblings' digests, joined.  ``span`` is a power of 8.
    """
    ground = numbered(leaves(docs, tampered), ["tree"], ["doc_id", "leaf", "other"])
    sizes = ground.groupBy("tree").agg(F.max("total").alias("total"))
    largest = sizes.agg(F.max("total"), F.count("*")).first()
    nodes = build(ground.withColumnRenamed("leaf", "digest"), largest[0] or 0, span)
    ground_nodes = ground.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"), "total")
    nodes = nodes.unionByName(ground_nodes)
    roots = nodes.where(f"pos = 0 and {_width_sql('total', 'level')} = 1").groupBy("tree").agg(
        F.min_by("digest", "level").alias("digest"), F.max("total").alias("leaves")
    )
    # The tree above: one leaf for each tree, in order of the languages.
    tops = numbered(roots, [], ["tree"])
    top_ground = tops.select(F.lit(_TOP).alias("tree"), "pos", "digest", "total")
    top_nodes = build(top_ground, largest[1], span).unionByName(top_ground.select("tree", F.lit(0).alias("level"), "pos", "digest", "total"))
    top_parts = tops.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("part"), F.col("pos").alias("lo"), F.col("pos").alias("hi"), "total")
    above, _ = written(fetched(top_parts, top_nodes, 1).select(
        F.col("part").alias("tree"), F.col("lo").alias("place"), F.col("total").alias("trees"),
        *[F.col(f"{c}s").alias(f"top_{c}s") for c in ("level", "pos", "digest")],
    ))
    # The leaf partitions, one narrow row each, and what they fetch.
    rows = ground.withColumn("part", F.floor(F.col("pos") / span))
    parts = rows.groupBy("tree", "part").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("total").alias("total"))
    info = fetched(parts, nodes, span)
    if largest[1] <= BROADCAST_TREES:
        above = F.broadcast(above)
    info = info.join(above, "tree").withColumnsRenamed({"tree": "of_tree", "part": "of_part"})
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * with_proof
    # Ids travel as text: pandas would turn integers with a null among them into floats.
    rows = rows.select("tree", "part", "pos", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "other")
    proven = rows.groupBy("tree", "part").cogroup(info.groupBy("of_tree", "of_part")).applyInPandas(_expand(with_proof), schema)
    return proven.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
