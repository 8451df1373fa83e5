"""Pairs of clauses by blocks: the score kernel, and the bounds by which blocks need not meet.

The kernel scores all pairs of two blocks at once, on bits and vectors in numpy, and hands back
the best partners of each clause only.  A document of several blocks is compared in two
passes.  In the first each block meets itself and its neighbour, which gives every clause a
score that later partners have to beat.  Each block also stands for its postings (the different
sets of category, keywords and patterns, the sections and references) and a ball around its
vectors; a later block is met in the second pass only if, by these, some clause could still gain.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions import vectors as V
from pactlens.functions.staging import stage

# Ship the numpy helpers with the task, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What is packed of each clause.
FIELDS = ("cat", "friends", "kw", "flags", "refs", "sec", "section_title")
#: Rows of long documents up to this number are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Documents of so few clauses pair them all.
SMALL = 5
LEAST = 0.25
#: Pairs that are scored at once.
PAIRS = 1 << 18


# -- packing --------------------------------------------------------------------------


def packed_blocks(features: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """The clauses in blocks of consecutive ones: documents of one block, and the longer ones if there are any.

    Rows ``(document_id, block, rows, flat, dim, clauses, blocks)``.  Clauses are packed by
    ranges of ``size`` indexes; only the counts of the ranges are summed per document, and
    ranges with gaps are joined until a block holds ``size`` clauses or up to twice as many.
    So clauses of a document, with their vectors, are never brought to one task.
    """
    ranges = stage(V.index_blocks(features, *FIELDS, size=size).withColumnRenamed("block", "range"))
    document = Window.partitionBy("document_id")
    ahead = F.coalesce(F.sum("n").over(document.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranges.select("document_id", "range", F.size("rows").alias("n")).select(
        "document_id", "range", F.sum("n").over(document).alias("clauses"), F.count("*").over(document).alias("ranges"),
        F.floor(ahead / size).cast("int").alias("block"),
    ).where("ranges > 1")
    counts = stage(counts.withColumn("blocks", F.max("block").over(document) + 1).drop("ranges"))
    n = counts.count()
    own = {"block": F.lit(0), "clauses": F.size("rows").cast("bigint"), "blocks": F.lit(1)}
    if n == 0:
        return ranges.drop("range").withColumns(own), None
    if n <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    alone = ranges.join(counts.select("document_id").distinct(), "document_id", "left_anti").drop("range").withColumns(own)
    parts = F.array_sort(F.collect_list(F.struct("range", "rows", "flat")))
    joined = ranges.join(counts, ["document_id", "range"]).groupBy("document_id", "block").agg(
        parts.alias("parts"), F.max("dim").alias("dim"), F.max("clauses").alias("clauses"), F.max("blocks").alias("blocks")
    ).withColumns({"rows": F.flatten("parts.rows"), "flat": F.flatten("parts.flat")}).drop("parts")
    joined = stage(joined)
    return alone.unionByName(joined.where("blocks = 1")), joined.where("blocks > 1")


def with_owners(blocks: DataFrame) -> DataFrame:
    """Rows of long documents with ``own``: their section number, if no later clause of the document has it."""
    owners = blocks.select("document_id", "block", F.inline("rows")).where("sec is not null").groupBy("document_id", "sec").agg(
        F.max("i").alias("i"), F.max("block").alias("block")
    ).groupBy("document_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("i", "sec"))).alias("owners"))
    own = lambda r: F.get(F.array(F.col("owners")), F.lit(0))[r["i"]]
    return blocks.join(owners, ["document_id", "block"], "left").withColumn(
        "rows", F.transform("rows", lambda r: r.withField("sec", own(r)))
    ).drop("owners")


def _input(rows: Column, flat: Column, dim: Column, small: Column) -> Column:
    """What the kernel reads of a block, as arrays; sections and references by the place of their clause."""
    of = lambda f: F.transform(rows, lambda r: r[f])
    places = lambda what: F.flatten(F.transform(rows, lambda r, n: F.array_repeat(n, F.size(what(r)))))
    # No lambda within a lambda here: Spark would not recognise the Python call around it.
    sections = lambda r: F.when(r["sec"].isNotNull(), F.array(r["sec"])).otherwise(F.array().cast("array<string>"))
    return F.struct(
        *[of(f).alias(f) for f in ("cat", "friends", "kw", "flags")],
        F.flatten(of("refs")).alias("ref_no"), places(lambda r: r["refs"]).alias("ref_at"),
        F.flatten(F.transform(rows, sections)).alias("sec_no"), places(sections).alias("sec_at"),
        flat.alias("flat"), dim.alias("dim"), small.alias("small"),
    )


# -- the kernel -----------------------------------------------------------------------


def _scored(s, cat, friends, small, kw, cos, flags, others, bits):
    """The sum of the signals of pairs, added in a fixed order; all arguments broadcast.

    Bounds are taken by the same sum, since adding what is not less gives what is not less.
    """
    cancel, renewal, modify, notify, temporal, excepts, qualifies = (
        bits[n] for n in ("cancel", "renewal", "modify", "notify", "TEMPORAL", "EXCEPTS", "QUALIFIES")
    )

    def either(f: int, g: int):
        return ((flags & f != 0) & (others & g != 0)) | ((others & f != 0) & (flags & g != 0))

    s = s + np.where(cat, 0.35, np.where(friends, 0.30, 0.0))
    s = s + np.where(kw & (kw - 1) != 0, 0.25, np.where(kw != 0, 0.15, 0.0))
    s = s + np.where(cos, 0.25, 0.0)
    s = s + np.where(either(cancel, renewal), 0.40, 0.0)
    s = s + np.where(either(modify, notify), 0.40, 0.0)
    s = s + np.where(flags & others & temporal != 0, 0.35, 0.0)
    weight = np.where((s > 0) | small, 0.30, 0.15)
    t = s + np.where((flags | others) & excepts != 0, weight, 0.0)
    return t + np.where((flags | others) & qualifies != 0, weight, 0.0)


def _arrays(block) -> tuple:
    cat, friends, flags = (np.asarray(block[f], dtype=np.int64) for f in ("cat", "friends", "flags"))
    return cat, friends, np.asarray(block["kw"], dtype=np.int64), flags


def _meet(left, right, threshold: float, cap: int, bits: dict):
    """Best partners in ``right`` of each clause in ``left``: (minus, n, m, cos, bits of ownership), by n, then rank."""
    unit = lambda b: V._unit(np.asarray(b["flat"], dtype=np.float64).reshape(-1, int(b["dim"])))
    cos = np.round(unit(left) @ unit(right).T, V.DECIMALS)
    own = [{no: int(at) for at, no in zip(b["sec_at"], b["sec_no"])} for b in (left, right)]
    crossed = np.zeros(cos.shape, dtype=np.int64)
    for at, no in zip(left["ref_at"], left["ref_no"]):
        if no in own[1]:
            crossed[at, own[1][no]] += 1
    for at, no in zip(right["ref_at"], right["ref_no"]):
        if no in own[0]:
            crossed[own[0][no], at] += 1
    (cat, friends, kw, flags), (cats, _, kws, others) = _arrays(left), _arrays(right)
    cat, friends, kw, flags = cat[:, None], friends[:, None], kw[:, None], flags[:, None]
    steps = np.concatenate([[0.0], np.cumsum(np.full(int(crossed.max(initial=0)), 0.40))])
    small = bool(left["small"])
    t = _scored(steps[crossed], (cat == cats) & (cat != 0), friends >> np.maximum(cats, 0) & 1 == 1, small, kw & kws, cos >= threshold, flags, others, bits)
    if small:
        t = np.where(t < 0.2, 0.30, t)
    fits = np.full(t.shape, True) if small else t >= LEAST
    minus = np.where(fits, -t, np.inf)
    order = np.argsort(minus, axis=1, kind="stable")[:, :cap]
    n = np.repeat(np.arange(len(order)), order.shape[1])
    m = order.ravel()
    stay = np.isfinite(minus[n, m])
    n, m = n[stay], m[stay]
    owns = [np.isin(np.arange(size), list(o.values())) for o, size in zip(own, t.shape)]
    return np.column_stack([minus[n, m], n, m, cos[n, m], owns[1][m] + 2 * owns[0][n]])


def _lists(blocks: pa.StructArray, field: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a list field of all blocks in one array, and where those of each block begin in it."""
    lists = blocks.field(field)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _records(blocks: pa.StructArray) -> Iterator[dict]:
    """The blocks one by one; their numbers are views of the batch."""
    lists = {f: _lists(blocks, f) for f in (*_CLAUSE_FIELDS, "flat", "ref_at", "sec_at")}
    lists = {f: (_numbers(values), at) for f, (values, at) in lists.items()}
    words = {f: _lists(blocks, f) for f in ("ref_no", "sec_no")}
    dims, smalls = (_numbers(blocks.field(f)) for f in ("dim", "small"))
    for k in range(len(blocks)):
        found = {f: values[at[k]:at[k + 1]] for f, (values, at) in lists.items()}
        found.update({f: values[at[k]:at[k + 1]].to_pylist() for f, (values, at) in words.items()})
        yield {**found, "dim": dims[k], "small": smalls[k]}


_CLAUSE_FIELDS = ("cat", "friends", "kw", "flags")


def _owned(blocks: pa.StructArray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clause, owner): the clauses with a reference to a section that a clause of their block owns; and who owns one."""
    (sec_no, sec_in), (ref_no, ref_in) = _lists(blocks, "sec_no"), _lists(blocks, "ref_no")
    sec_at, ref_at = (_numbers(_lists(blocks, f)[0]).astype(np.int64) for f in ("sec_at", "ref_at"))
    if not len(sec_no):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    code = pa.chunked_array([sec_no, ref_no]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    block = np.concatenate([np.repeat(np.arange(len(blocks)), np.diff(x)) for x in (sec_in, ref_in)])
    key = block * (int(code.max()) + 1) + code
    place = begins[block] + np.concatenate([sec_at, ref_at])
    order = np.argsort(key[:len(sec_no)], kind="stable")
    keys, owners = key[:len(sec_no)][order], place[:len(sec_no)][order]
    last = np.append(keys[1:] != keys[:-1], True)  # the last section with a number owns it
    keys, owners = keys[last], owners[last]
    wanted = key[len(sec_no):]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return place[len(sec_no):][there], owners[at[there]], owners


def _cosines(blocks: pa.StructArray, begins: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of each block, in the order of their first, then of their second clause."""
    flat, at = _lists(blocks, "flat")
    flat, dims, parts, above = _numbers(flat), _numbers(blocks.field("dim")), [np.empty(0)], {}
    for k, n in enumerate(np.diff(begins).tolist()):
        if n < 2:
            continue
        if n not in above:
            above[n] = np.flatnonzero(np.triu(np.full((n, n), True), 1).ravel())
        unit = V._unit(flat[at[k]:at[k + 1]].astype(np.float64).reshape(-1, int(dims[k])))
        parts.append((unit @ unit.T).ravel()[above[n]])
    return np.round(np.concatenate(parts), V.DECIMALS)


def _meet_within(blocks: pa.StructArray, threshold: float, cap: int, bits: dict, per_document: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The best partners of the clauses within each block, scored for all blocks at once: numbers, and how many pairs a block has.

    A row of numbers is (minus, n, m, cos, bits of ownership), by block, n, then rank, or by rank in the
    block if that is cut.
    """
    _, begins = _lists(blocks, "cat")
    cat, friends, kw, flags = (_numbers(_lists(blocks, f)[0]).astype(np.int64) for f in _CLAUSE_FIELDS)
    clauses = np.arange(len(cat))
    block = np.repeat(np.arange(len(blocks)), np.diff(begins))
    later = begins[block + 1] - clauses - 1  # partners of each clause: those behind it in its block
    first = np.concatenate([[0], np.cumsum(later)])
    left = np.repeat(clauses, later)
    right = np.arange(len(left)) - first[left] + left + 1
    cos = _cosines(blocks, begins)
    refers, refered, owners = _owned(blocks, begins)
    low, high = np.minimum(refers, refered), np.maximum(refers, refered)
    other = low < high
    crossed = np.bincount(first[low[other]] + high[other] - low[other] - 1, minlength=len(left))
    steps = np.concatenate([[0.0], np.cumsum(np.full(int(crossed.max(initial=0)), 0.40))])
    small = _numbers(blocks.field("small")).astype(bool)[block[left]]
    cats = cat[right]
    t = _scored(
        steps[crossed], (cat[left] == cats) & (cat[left] != 0), friends[left] >> np.maximum(cats, 0) & 1 == 1, small,
        kw[left] & kw[right], cos >= threshold, flags[left], flags[right], bits)
    t = np.where(small & (t < 0.2), 0.30, t)
    fits = np.flatnonzero(small | (t >= LEAST))
    left, right, minus, cos = left[fits], right[fits], -t[fits], cos[fits]
    order = np.lexsort((right, minus, left))
    order = order[_rank(left[order]) < cap]
    if per_document is not None:
        order = order[np.lexsort((right[order], left[order], minus[order], block[left[order]]))]
        order = order[_rank(block[left[order]]) < per_document]
    left, right = left[order], right[order]
    owns = np.zeros(len(cat), np.int64)
    owns[owners] = 1
    start = begins[block[left]]
    found = np.column_stack([minus[order], left - start, right - start, cos[order], owns[right] + 2 * owns[left]])
    return found, np.bincount(block[left], minlength=len(blocks))


def _rank(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 0; the rows of a group stand together."""
    at = np.arange(len(groups))
    start = np.append(True, groups[1:] != groups[:-1]) if len(groups) else np.empty(0, bool)
    return at - np.maximum.accumulate(np.where(start, at, 0))


def _parts(blocks: pa.StructArray) -> Iterator[pa.StructArray]:
    """Runs of blocks with at most so many pairs, or one block."""
    sizes = np.diff(_lists(blocks, "cat")[1])
    pairs = np.concatenate([[0], np.cumsum(sizes * (sizes - 1) // 2)])
    at = 0
    while at < len(blocks):
        to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS, "right")) - 1)
        yield blocks[at:to]
        at = to


def _found(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """The numbers of all blocks as one Arrow array of lists."""
    numbers = np.concatenate([np.empty((0, 5)), *(found for found, _ in parts)])
    sizes = np.concatenate([[0], *(n for _, n in parts)])
    return pa.ListArray.from_arrays((np.cumsum(sizes) * 5).astype(np.int32), pa.array(numbers.ravel()))


def _kernel(bits: dict, threshold: float, cap: int, per_document: int | None):
    """The kernel as a column function: ``per_document`` cuts a document that is one block for good."""
    @F.arrow_udf("array<double>")
    def within(blocks: pa.Array) -> pa.Array:
        return _found([_meet_within(part, threshold, cap, bits, per_document) for part in _parts(blocks)])

    @F.arrow_udf("array<double>")
    def across(left: pa.Array, right: pa.Array) -> pa.Array:
        parts = [_meet(a, b, threshold, cap, bits) for a, b in zip(_records(left), _records(right))]
        return _found([(p, np.array([len(p)])) for p in parts])

    # Else the optimizer may copy the call into a filter ahead of it, and into lambdas.
    return within.asNondeterministic(), across.asNondeterministic()


def _unpacked(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Per pair of the kernel's numbers ``found``: document_id, minus, i, j, cross_refs, cos, a, b and ``at``, its place from 0."""
    # No lambda but for references: else Spark interprets the whole step.
    places = "if(size(found) > 0, sequence(0, int(size(found) div 5) - 1), cast(array() as array<int>))"
    rows = pairs.select("document_id", *dict.fromkeys([left, right]), "found", F.explode(F.expr(places)).alias("at"))
    return rows.select(
        "document_id", "at", F.expr("found[5 * at]").alias("minus"), F.expr(f"{left}[int(found[5 * at + 1])]").alias("a"),
        F.expr(f"{right}[int(found[5 * at + 2])]").alias("b"), F.expr("found[5 * at + 3]").alias("cos"), F.expr("int(found[5 * at + 4])").alias("owns"),
    ).select(
        "document_id", "at", "minus", F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.expr("""
            concat(if(owns & 1 != 0 AND size(a.refs) > 0, filter(a.refs, r -> r = b.sec), cast(array() as array<string>)),
                   if(owns & 2 != 0 AND size(b.refs) > 0, filter(b.refs, r -> r = a.sec), cast(array() as array<string>)))""").alias("cross_refs"),
        "cos", "a", "b",
    )


# -- bounds ---------------------------------------------------------------------------


def _postings(blocks: DataFrame) -> DataFrame:
    """Per block its postings (the different sets of category, keywords and patterns), sections, references, and the ball of its vectors."""
    kinds = F.array_distinct(F.transform("rows", lambda r: F.struct(r["cat"].alias("cat"), r["kw"].alias("kw"), r["flags"].alias("flags"))))
    return blocks.select(
        "document_id", "block", kinds.alias("kinds"),
        F.array_distinct(F.flatten(F.transform("rows", lambda r: r["refs"]))).alias("refs"),
        F.filter(F.transform("rows", lambda r: r["sec"]), lambda s: s.isNotNull()).alias("secs"), V.ball(F.col("flat"), F.col("dim")).alias("ball"),
    ).select("document_id", "block", *[F.col(f"kinds.{f}").alias(f"{f}s") for f in ("cat", "kw", "flags")], "refs", "secs", "ball")


def _may_gain(bits: dict, threshold: float):
    @F.pandas_udf("boolean")
    def gains(block: pd.DataFrame, other: pd.DataFrame) -> pd.Series:
        """Whether some clause of a block could have a partner in the other one that beats its present ones."""
        out = []
        for a, b in zip(block.to_dict("records"), other.to_dict("records")):
            cat, friends, kw, flags = _arrays(a)
            x, y = np.asarray(a["ball"]), np.asarray(b["ball"])
            # a.b <= ca.cb + ra |cb| + rb |ca| + ra rb, with room for rounding.
            reach = x[:-1] @ y[:-1] + x[-1] * np.linalg.norm(y[:-1]) + y[-1] * np.linalg.norm(x[:-1]) + x[-1] * y[-1]
            close = reach + 1e-6 >= threshold
            cats, kws, others = (np.asarray(b[f], dtype=np.int64) for f in ("cats", "kws", "flagss"))
            cat, friends, kw, flags = cat[:, None], friends[:, None], kw[:, None], flags[:, None]
            at_most = _scored(
                np.zeros((len(cat), len(cats))), (cat == cats) & (cat != 0), friends >> np.maximum(cats, 0) & 1 == 1, False, kw & kws,
                np.full(len(cats), close), flags, others, bits).max(axis=1)
            out.append(bool(((at_most >= LEAST) & (at_most > np.asarray(a["beaten"], dtype=np.float64)) & (at_most >= a["least"])).any()))
        return pd.Series(out, dtype=bool)

    return gains


def blocks_to_meet(blocks: DataFrame, first: DataFrame, bits: dict, threshold: float, cap: int, per_document: int) -> DataFrame:
    """(document_id, block, right): the pairs of blocks, two or more apart, that can change the result.

    ``first`` holds the best partners of every clause in its own block and the next.  A clause with
    ``cap`` partners gains only by a higher score, since equal ones rank by index; a document
    with ``per_document`` pairs gains by none that is below all of them.
    """
    beaten = first.groupBy("document_id", "i").agg(F.count("*").alias("n"), (-F.max("minus")).alias("score")).where(F.col("n") >= cap)
    beaten = beaten.join(blocks.select("document_id", "block", F.explode("rows.i").alias("i")), ["document_id", "i"]).groupBy("document_id", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "score"))).alias("scores")
    )
    best = Window.partitionBy("document_id").orderBy("minus", "i", "j")
    least = first.select("document_id", "minus", "i", "j").withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_document).groupBy(
        "document_id"
    ).agg(F.when(F.count("*") == per_document, -F.max("minus")).alias("least"))
    never = F.lit(float("-inf"))
    of = lambda f: F.transform("rows", lambda r: r[f])
    score = lambda r: F.coalesce(F.get(F.array(F.col("scores")), F.lit(0))[r["i"]], never)
    held = blocks.join(beaten, ["document_id", "block"], "left").join(least, "document_id", "left").select(
        "document_id", "block", "blocks", "clauses", *[of(f).alias(f) for f in ("cat", "friends", "kw", "flags")],
        F.transform("rows", score).alias("beaten"), F.coalesce("least", never).alias("least"),
    )
    posted = _postings(blocks)
    mine = held.join(posted.select("document_id", "block", "ball", "refs", "secs"), ["document_id", "block"])
    theirs = posted.where("block >= 2").select(
        "document_id", F.explode(F.sequence(F.lit(0), F.col("block") - 2)).alias("block"), F.col("block").alias("right"),
        F.struct("cats", "kws", "flagss", "ball").alias("other"), F.col("refs").alias("other_refs"), F.col("secs").alias("other_secs"),
    )
    met = mine.join(theirs, ["document_id", "block"])
    crossed = F.arrays_overlap("refs", "other_secs") | F.arrays_overlap("other_refs", "secs")
    gains = _may_gain(bits, threshold)(F.struct("cat", "friends", "kw", "flags", "beaten", "least", "ball"), F.col("other"))
    return met.withColumn("gains", gains).where((F.col("clauses") <= SMALL) | crossed | F.col("gains")).select("document_id", "block", "right")


# -- the pairs ------------------------------------------------------------------------

_OUT = ["document_id", "minus", "i", "j", "cross_refs", "cos", "a", "b"]


def short_pairs(blocks: DataFrame, bits: dict, threshold: float, per_clause: int, per_document: int) -> DataFrame:
    """The ranked pairs of documents of one block: final where they are, no exchange."""
    within, _ = _kernel(bits, threshold, per_clause, per_document)
    scored = blocks.select("document_id", "rows", within(_input(F.col("rows"), F.col("flat"), F.col("dim"), F.col("clauses") <= SMALL)).alias("found"))
    return _unpacked(scored, "rows", "rows").select(*_OUT, (F.col("at") + 1).alias("candidate_rank"))


def first_pairs(blocks: DataFrame, bits: dict, threshold: float, per_clause: int) -> DataFrame:
    """The best partners of every clause in its own block and the next one."""
    within, _ = _kernel(bits, threshold, per_clause, None)
    small = F.col("clauses") <= SMALL
    own = blocks.select("document_id", "rows", within(_input(F.col("rows"), F.col("flat"), F.col("dim"), small)).alias("found"))
    own = _unpacked(own, "rows", "rows").select(*_OUT)
    following = blocks.select("document_id", "block", (F.col("block") + 1).alias("right"))
    return _cut(own.unionByName(met_pairs(blocks, following, bits, threshold, per_clause)), per_clause)


def met_pairs(blocks: DataFrame, meetings: DataFrame, bits: dict, threshold: float, per_clause: int) -> DataFrame:
    """The best partners of every clause in the blocks that its own one meets."""
    _, across = _kernel(bits, threshold, per_clause, None)
    right = blocks.select("document_id", F.col("block").alias("right"), F.col("rows").alias("right_rows"), F.col("flat").alias("right_flat"))
    met = blocks.join(meetings, ["document_id", "block"]).join(right, ["document_id", "right"])
    small = F.col("clauses") <= SMALL
    scored = met.select("document_id", "rows", "right_rows", across(
        _input(F.col("rows"), F.col("flat"), F.col("dim"), small), _input(F.col("right_rows"), F.col("right_flat"), F.col("dim"), small)
    ).alias("found"))
    return _unpacked(scored, "rows", "right_rows").select(*_OUT)


def _cut(pairs: DataFrame, per_clause: int) -> DataFrame:
    by_clause = Window.partitionBy("document_id", "i").orderBy("minus", "j")
    return pairs.withColumn("n", F.row_number().over(by_clause)).where(F.col("n") <= per_clause).drop("n")


def long_pairs(blocks: DataFrame, bits: dict, threshold: float, per_clause: int, per_document: int) -> DataFrame:
    """The ranked pairs of documents of several blocks.

    Partial rankings merge exactly: both cuts are row limits per group, taken before and
    after the exchange, so no group travels or gathers whole.
    """
    blocks = stage(with_owners(blocks))
    first = stage(first_pairs(blocks, bits, threshold, per_clause))
    meetings = blocks_to_meet(blocks, first, bits, threshold, per_clause, per_document)
    ranked = _cut(first.unionByName(met_pairs(blocks, meetings, bits, threshold, per_clause)), per_clause)
    by_document = Window.partitionBy("document_id").orderBy("minus", "i", "j")
    return ranked.withColumn("candidate_rank", F.row_number().over(by_document)).where(F.col("candidate_rank") <= per_document)
