"""N-gram Jaccard join by parity sketches (operator 6).

The set of a text is its distinct word shingles.  A parity sketch has one bit per position
and every shingle flips the bit its hash names, so the Hamming distance of two sketches is at
most the size of the symmetric difference.  Sets of Jaccard similarity of at least t differ
in at most d = (1 - t) / (1 + t) * (a + b) shingles.  Sketches of one size band are cut into
more than d parts, so two linked sets agree on a part (pigeonhole); the parts are the keys of
the join.  A narrow sketch of 256 bits then drops candidates whose distance already exceeds
d, inside the last join also one of a bit or more a shingle, a sketch as wide as the sets demand (two bits a shingle or more) drops most of the rest,
and the sets themselves decide.

Equal sets are merged before all this.  Within the bucket of a key no pairs are listed:

1. in a few turns, as long as they settle a fair part of what is open, every set that meets another component in a bucket tries one pair: with
   the hub (one member of each bucket) that it shares most keys with.  That is at most one
   verification per set and turn, and components grow fast;
2. then members of different components of a bucket are compared with each other, so a
   large group of near copies, one component by then, costs nothing more.

The parts of long sets that hold nothing but shingles of a passage many sets have make large
buckets.  Linked sets agree on more parts than are spare, so in any order that all sets share
they still agree on one when each leaves out as many of its last parts as are spare (the prefix
filter).  The order is by members of the bucket, empty parts last: a set leaves its largest buckets.

No bucket, band or partner is capped.  The number of comparisons in step 2 is bounded by the
false candidates of the sketches, not by a limit.  Empty parts would collide most; a set
gives its empty parts only if it has more of them than the band has spare parts, so that the
pigeonhole argument still holds.

Shingles are compared by 64-bit hashes.

Defined cases: null, empty and wordless texts have no shingles and stand alone; fewer words
than the width are one shingle; rows that share an id are one document of the join's result
if their texts are linked, separate rows anyway; a null id never names a component that has
another id; an empty table gives an empty result; other columns are not read by ``linked``
and kept by ``representatives``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.common import bound_batches, forget, fresh, give_back, release, written
from pactlens.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text that is turned into shingles at once; numpy holds about 60 bytes for each of its letters.
CHUNK_BYTES = 1 << 19
GROWTH = 1.25
#: One part more for so many shingles in which linked sets may differ, to leave large buckets out.
SPARE_OF = 24
#: A row of the last join carries at most so many bits of its set.
MIDDLE_BITS = 1 << 13
TURNS, WORTH, FIRST_KEYS = 4, 0.8, 16
BROADCAST_IDS = 3_000_000
SEEN = 1 << 18
SIGNATURE = "n bigint, h bigint, sketch array<bigint>"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    to = np.arange(256, dtype=np.uint8)
    to[0x41:0x5B] += 32
    kind = np.ones(256, bool)
    kind[[0x20, *range(0x09, 0x0E)]] = False
    word = kind[raw]
    letters = to[raw[word]]
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    first_raw = np.flatnonzero(word & ~before)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(first_raw, ends_of), prepend=0)
    if not len(first_raw):
        return [np.empty(0, np.uint64)] * len(texts)
    place = np.cumsum(word) - 1
    firsts = place[first_raw]
    sizes = np.diff(firsts, append=len(letters))
    inside = np.arange(len(letters)) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        hashed = mix(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[inside], firsts))
        n = len(hashed)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for j in range(width):
            rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + hashed[j:j + len(rolled)])
        out, at = [], 0
        for w in words.tolist():
            if w >= width:
                out.append(np.unique(rolled[at:at + w - width + 1]))
            elif w:
                whole = np.array([w], np.uint64)
                for h in hashed[at:at + w]:
                    whole = mix(whole * np.uint64(0xA0761D6478BD642F) + h)
                out.append(whole)
            else:
                out.append(np.empty(0, np.uint64))
            at += w
    return out


class Bands:
    """Size bands: sizes from ``starts[i]`` up to the next start share their partition.

    A set also joins the next band if a partner may lie there; no partner lies further.
    """

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] <= largest * den // num + 1:
            low = starts[-1]
            starts.append(max(low + 1, int(low * GROWTH), (low - 1) * den // num + 1))
        self.starts = np.array(starts)

    def distance(self, a: int, b: int) -> int:
        """The most shingles in which linked sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[int]:
        band = int(np.searchsorted(self.starts, size, "right")) - 1
        return [band] + [band + 1] * (self.den * size >= self.num * int(self.starts[band + 1]))

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, spare parts) of a band; no parts if its linked sets are equal sets."""
        most = int(self.starts[band + 1]) - 1
        d = self.distance(most, most)
        if not d:
            return 0, 0
        spare = 1 + d // SPARE_OF + int(2 * d * np.exp(-int(self.starts[band]) * self.num / self.den / (d + 2)))
        return d + 1 + spare, spare

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """The part keys of a set: a hash of band, part and the parity pattern of the part."""
        return self.keys_and_leave(shingles)[0]

    def keys_and_leave(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part keys, and beside each how many keys of its band the set may leave out, doubled, plus 1 in odd bands."""
        with np.errstate(over="ignore"):
            running = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))])
            out, leave = [], []
            for band in self.of(len(shingles)):
                k, spare = self.parts(band)
                if not k:
                    continue
                # Parts are ranges of the hash, so a sorted set has them in order.
                part = ((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
                cut = np.searchsorted(part, np.arange(k + 1))
                pattern = running[cut[1:]] ^ running[cut[:-1]]
                code = mix(pattern + mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 32)))
                full = cut[1:] > cut[:-1]
                empty = k - int(full.sum())
                out.append(code[full] if empty <= spare else code)
                leave.append(np.full(len(out[-1]), 2 * max(0, spare - empty) + band % 2, np.int32))
            return (np.concatenate(out), np.concatenate(leave)) if out else (np.empty(0, np.uint64), np.empty(0, np.int32))


def narrow_sketch(shingles: np.ndarray) -> np.ndarray:
    """256 parity bits in four integers."""
    bits = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def middle_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits in integers: 256, beyond so many shingles the least power of two that is their number or more, from 1,024 to MIDDLE_BITS."""
    bits = 256 if len(shingles) <= 256 else min(MIDDLE_BITS, max(1024, 1 << (len(shingles) - 1).bit_length()))
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view("<i8")


def wide_sketch(shingles: np.ndarray) -> bytes:
    """Parity bits of a set, a power of two that is at least twice its size (and 256)."""
    bits = max(256, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two wide sketches; the longer one is folded to the bits of the other."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def set_hash(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(shingles ^ np.uint64(0x2545F4914F6CDD1D))) + np.uint64(len(shingles))
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _chunks(texts) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def signature(text: Column, width: int) -> Column:
    """struct(n, h, sketch) of a text's set; h is null for an empty set."""

    @F.pandas_udf(SIGNATURE)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in give_back(batches):
            made = []
            for chunk in _chunks(texts):  # a chunk's sets go before the next one's come
                made += [(len(s), set_hash(s), narrow_sketch(s)) if len(s) else (0, None, None) for s in shingle_sets(chunk, width)]
            yield pd.DataFrame({"n": [n for n, _, _ in made], "h": pd.array([h for _, h, _ in made], dtype="Int64"), "sketch": [k for _, _, k in made]})

    return signed(text)


def _keys(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(key, h, leave) of every set of the text column ``t`` (``Bands.keys_and_leave``); a task names a set it meets again only now and then."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, seen = Bands(num, den, 1 << 12), set()
        for batch in give_back(batches):
            for chunk in _chunks(batch["t"]):
                hashes, keys, leave = [], [], []
                for s in shingle_sets(chunk, width):
                    if not len(s) or (h := set_hash(s)) in seen:
                        continue
                    if len(s) * 2 > bands.starts[-1]:
                        bands = Bands(num, den, len(s) * 4)
                    seen.add(h)
                    hashes.append(h)
                    codes, left = bands.keys_and_leave(s)
                    keys.append(codes.view(np.int64))
                    leave.append(left)
                if len(seen) > SEEN:
                    seen.clear()
                if keys:
                    yield pd.DataFrame({"key": np.concatenate(keys), "h": np.repeat(np.array(hashes, np.int64), [len(k) for k in keys]), "leave": np.concatenate(leave)})

    return docs.select("t").mapInPandas(made, "key bigint, h bigint, leave int")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """h, n, middle and wide (its sketches), shingles (sorted 64-bit integers) of the text column ``t``."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in give_back(batches):
            for chunk in _chunks(batch["t"]):
                sets = [s for s in shingle_sets(chunk, width) if len(s)]
                yield pd.DataFrame({
                    "h": [set_hash(s) for s in sets], "n": [len(s) for s in sets],
                    "middle": [middle_sketch(s) for s in sets], "wide": [wide_sketch(s) for s in sets], "shingles": [s.tobytes() for s in sets],
                })

    return docs.select("t").mapInPandas(made, "h bigint, n bigint, middle array<bigint>, wide binary, shingles binary")


def _beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b, la, lb) with ``columns`` of both sets, as ``<column>_a`` and ``<column>_b``."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("h").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
    return pairs.select("a", "b", "la", "lb", *[f"{c}_{x}" for c in columns for x in "ab"])


def _close(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose wide sketches allow the link; a pair carries about two bits a shingle here, not 64."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in give_back(batches):
            most = (batch["n_a"] + batch["n_b"]) * (den - num) // (den + num)
            keep = [sketch_distance(x, y) <= d for x, y, d in zip(batch["wide_a"], batch["wide_b"], most)]
            yield batch.loc[keep, ["a", "b", "la", "lb"]]

    return _beside(pairs, sets, "n", "wide").mapInPandas(decide, "a bigint, b bigint, la bigint, lb bigint")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b), with their labels (la, lb), whose sets are similar enough."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in give_back(batches):
            keep = []
            for x, y in zip(batch["shingles_a"], batch["shingles_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b", "la", "lb"]]

    return _beside(pairs, sets, "shingles").mapInPandas(decide, "a bigint, b bigint, la bigint, lb bigint")


def _possible(na: Column, nb: Column, sa: Column, sb: Column, num: int, den: int) -> Column:
    """Sizes and narrow sketches allow the link."""
    differ = sum((F.bit_count(sa[k].bitwiseXOR(sb[k])) for k in range(1, 4)), F.bit_count(sa[0].bitwiseXOR(sb[0])))
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & (differ * (den + num) <= (na + nb) * (den - num))


def _near(na: Column, nb: Column, ma: Column, mb: Column, num: int, den: int) -> Column:
    """Middle sketches allow the link; the longer one is folded to the bits of the other, by half or from 1,024 to 256."""
    length = F.least(F.size(ma), F.size(mb))

    def half(m: Column, n: Column) -> Column:
        return F.zip_with(F.slice(m, 1, n), F.slice(m, n + 1, n), lambda x, y: x.bitwiseXOR(y))

    def folded(m: Column) -> Column:
        return F.when(F.size(m) == 2 * length, half(m, length)).when(F.size(m) > length, half(half(m, 2 * length), length)).otherwise(m)

    apart = F.zip_with(folded(ma), folded(mb), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(apart, F.lit(0), lambda x, y: x + y) * (den + num) <= (na + nb) * (den - num)


def classes(docs: DataFrame, *, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """Per row: i (the id), n, h (its set), label (smallest set hash that links reach); paths to forget.

    Two sets link when ``den`` times the intersection is at least ``num`` times the union.
    """
    spark, spent = docs.sparkSession, []
    bound_batches(spark)

    def stage(df: DataFrame) -> DataFrame:
        df, path = written(df)
        spent.append(path)
        release(spark)
        return df

    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    signed = stage(rows.withColumn("s", signature(F.col("t"), width)).select("i", "s.*"))
    known = signed.where("h is not null")
    in_bucket = "partition by key"
    # One exchange by key serves the removal of repeats and the count; a task sent a set once, however often it met it.
    buckets = _keys(rows, width, num, den).repartition("key").dropDuplicates(["key", "h"])
    # Buckets of one member are most of the table and end here.
    met = stage(buckets.selectExpr("key", "h", "leave", f"count(*) over ({in_bucket}) as members").where("members > 1"))
    largest = Window.partitionBy("h", F.col("leave") % 2).orderBy(F.desc("members"), "key")
    shared = stage(met.withColumn("nth", F.row_number().over(largest)).where("nth > leave div 2").select("key", "h"))
    merged = known.groupBy("h").agg(F.min("i").alias("i"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    traits = stage(merged.join(shared.select("h").distinct(), "h", "left_semi"))
    sets_of = traits.select("h")
    mine = traits.select(F.col("i").alias("known")).distinct()
    if traits.count() <= BROADCAST_IDS:
        mine = F.broadcast(mine)  # checked: one number a row; beyond that both sides are shuffled
    sets = stage(_sets(rows.join(mine, F.col("i").eqNullSafe(F.col("known")), "left_semi"), width).dropDuplicates(["h"]).join(sets_of, "h", "left_semi"))
    of = [traits.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab"]
    possible = _possible(F.col("na"), F.col("nb"), F.col("ka"), F.col("kb"), num, den)
    placed, tried, links, open_rows = shared.withColumn("label", F.col("h")), None, None, None
    for turn in range(TURNS):
        # Every set with another component in a bucket tries the hub that it shares most keys with.
        facing = placed.selectExpr(
            "h", "label", f"min_by(struct(h, label), xxhash64(h, {turn})) over ({in_bucket}) as hub"
        ).where("label <> hub.label").selectExpr(
            "h", "least(h, hub.h) as a", "greatest(h, hub.h) as b",
            "if(h < hub.h, label, hub.label) as la", "if(h < hub.h, hub.label, label) as lb",
        )
        pairs = facing.groupBy("h", "a", "b", "la", "lb").agg(F.count(F.lit(1)).alias("keys"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        allowed = pairs.join(of[0], "a").join(of[1], "b").where(possible)
        best = allowed.groupBy("h").agg(F.max(F.struct("keys", "a", "b", "la", "lb")).alias("p"))
        now = stage(best.select("p.a", "p.b", "p.la", "p.lb").distinct())
        # A label is a member of its component, so links between labels join the same sets.
        found = stage(_verified(stage(_close(now, sets, num, den)), sets, num, den).select("la", "lb").distinct())
        now = now.select("a", "b")
        tried, links = (now, found) if tried is None else (tried.unionByName(now), links.unionByName(found))
        labels, path = components(found, "la", "lb")
        spent.append(path)
        placed = placed.join(labels.select(F.col("node").alias("label"), F.col("label").alias("newer")), "label", "left").select("key", "h", F.coalesce("newer", "label").alias("label"))
        # Labels only merge, so a bucket of one component is done for good.
        placed = stage(placed.selectExpr("key", "h", "label", f"min(label) over ({in_bucket}) <> max(label) over ({in_bucket}) as open").where("open").drop("open"))
        before, open_rows = open_rows, placed.count()
        if not open_rows or (before is not None and open_rows > before * WORTH):
            break  # the rest is compared below; more turns would settle little of it
    # What is left: members of one bucket in different components.
    open_buckets = placed
    # A pair is left to the bucket of a smaller common key where the first keys of both show one;
    # the smallest common key always lists it.
    own_keys = open_buckets.withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("key"))).where(F.col("nth") <= FIRST_KEYS).groupBy("h").agg(F.collect_list("key").alias("keys"))
    mixed = stage(open_buckets.join(own_keys, "h").join(traits.select("h", "n", "sketch"), "h").join(sets.select("h", "middle"), "h"))
    sides = [mixed.select("key", F.col("h").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"), F.col("keys").alias(f"keys{x}"), F.col("middle").alias(f"m{x}")) for x in "ab"]
    first_in_common = F.coalesce(F.array_min(F.array_intersect("keysa", "keysb")) >= sides[0]["key"], F.lit(True))
    # A sketch of 256 bits tells nothing about sets of more than some 600 shingles.
    near = _near(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), num, den)
    across = sides[0].join(sides[1], (sides[0]["key"] == sides[1]["key"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & possible & first_in_common & near)
    rest = across.select("a", "b", "la", "lb").distinct().join(tried, ["a", "b"], "left_anti")
    more = stage(_verified(stage(_close(rest, sets, num, den)), sets, num, den))
    labels, path = components(links.unionByName(more.select("la", "lb")), "la", "lb")
    spent.append(path)
    placed = signed.select("i", "n", "h").join(labels.withColumnRenamed("node", "h"), "h", "left").select("i", "n", "h", F.coalesce("label", "h").alias("label"))
    return placed, spent


def linked(docs: DataFrame, *, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    placed, spent = classes(docs, width=width, num=num, den=den, id_col=id_col, text_col=text_col)
    names = placed.where("h is not null").groupBy("label").agg(F.min("i").alias("name"))
    result, _ = written(placed.join(names, "label", "left").select(
        F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("h").isNull(), F.col("i")).otherwise(F.col("name")).alias("component_id")
    ))
    forget(docs.sparkSession, *spent)
    return result


def representatives(docs: DataFrame, *, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id (then smallest text); same columns.

    Texts without shingles are components of their own and all stay.
    """
    placed, spent = classes(docs, width=width, num=num, den=den, id_col=id_col, text_col=text_col)
    sets = placed.where("h is not null").groupBy("label").agg(F.min(F.struct(F.col("i").isNull().alias("no"), "i", "h")).alias("m"))
    keepers, path = written(sets.select(F.col("m.h").alias("keep"), F.col("m.i").alias("keep_i")))
    forget(docs.sparkSession, *spent)
    own, row, order, h, keep, keep_i = (fresh(docs, c) for c in ("sig_", "row_", "order_", "h_", "keep_", "keep_i_"))
    signed = docs.withColumn(own, signature_hash(F.col(text_col), width))
    alone = signed.where(F.col(own).isNull()).select(*docs.columns)
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col).cast("bigint"), F.col(text_col))
    packed = signed.where(F.col(own).isNotNull()).select(F.col(own).alias(h), rank.alias(order), F.struct(*docs.columns).alias(row))
    # Rows of one set meet here, merged in part before they travel.
    first = packed.groupBy(h).agg(F.min_by(row, order).alias(row))
    kept = first.join(keepers.select(F.col("keep").alias(keep), F.col("keep_i").alias(keep_i)), F.col(h) == F.col(keep), "left_semi")
    return kept.select(f"{row}.*").unionByName(alone)


def signature_hash(text: Column, width: int) -> Column:
    """The hash of a text's set, null for an empty one.

    Spark works it out once a row: a filter on a deterministic function is moved to the scan with a copy
    of the function, and a task with two of them takes two Python workers, which then stay.
    """

    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in give_back(batches):
            yield pd.Series([set_hash(s) if len(s) else None for chunk in _chunks(texts) for s in shingle_sets(chunk, width)], dtype="Int64")

    return hashed.asNondeterministic()(text)
