"""Quality of texts by compression (operator 7).

Two zstandard dictionaries are built, one from texts labelled good and one from texts
labelled bad.  A text is compressed with each; the difference of the two sizes over their sum
says which kind it resembles, and a logistic curve, fitted on labelled texts that the
dictionaries have not seen, turns it into a probability.  The same difference says more in a long
text, so its slope may grow with the logarithm of the length; length itself does not count.

Fitting takes at most ``TRAIN_ROWS`` labels of each kind, the first in order of a hash of
their id, and of their whole texts, in the same order, those before which less than
``TRAIN_BYTES`` are taken; texts longer than a 64th of that come behind all others.  So the
driver holds a bounded sample (and one text), the same one in any layout of the rows; scoring
covers all rows.

Defined cases: null counts as empty text and gets the probability of the fitted curve at
difference 0; without both labels every score is the share of good labels (0.5 without any);
labels other than 0 and 1, null ids and null labels do not train; a document with several
labels trains with each; repeated rows get equal scores; other columns pass through.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.common import forget, fresh, is_held_out, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS, TRAIN_BYTES = 3000, 48 << 20
DICTIONARY_BYTES, LEVEL = 112 << 10, 3


class Compressors:
    """The two dictionaries and the curve; compressors are made where they are used."""

    def __init__(self, dictionaries: tuple[bytes, bytes] | None, curve: np.ndarray, level: int = LEVEL):
        self.dictionaries, self.curve, self.level = dictionaries, curve, level

    def features(self, texts: list[bytes]) -> np.ndarray:
        import zstandard

        if self.dictionaries is None:
            return np.zeros((len(texts), len(self.curve)))
        sizes = []
        for data in self.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=self.level)
            pack = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_dict_id=False, write_content_size=False)
            sizes.append([len(pack.compress(t)) for t in texts])
        bad, good = np.array(sizes, float)
        length = np.log1p(np.fromiter(map(len, texts), float, len(texts)))
        apart = (bad - good) / (bad + good)
        return np.stack([np.ones(len(texts)), apart, apart * length], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic curve, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
        if np.abs(slope).max() < 1e-6:
            break
    return w


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality",
    rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES,
) -> Compressors:
    """Dictionaries and curve from the labelled rows that are not held out."""
    import zstandard

    known = labels.select(F.col(label_id_col).alias("li"), F.col(label_col).cast("int").alias("q")).where(F.col("li").isNotNull() & ~is_held_out(F.col("li")))
    order = F.xxhash64(F.lit("train"), F.col("li").cast("string"))
    chosen = [known.where(F.col("q") == q).orderBy(order, "li").limit(rows) for q in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 x rows pairs of numbers
    text = F.coalesce(F.col(text_col), F.lit(""))
    found, path = written(docs.join(sample, F.col(id_col) == F.col("li")).select(
        "q", order.alias("o"), "li", F.octet_length(text).cast("bigint").alias("b"), F.xxhash64(text).alias("x"), text.alias("t")
    ))
    # The byte bound is cut on narrow rows, equal ones as one with their number.
    same = ["q", "o", "li", "b", "x"]
    in_order = Window.partitionBy("q").orderBy(F.col("b") > most_bytes // 64, "o", "li", "b", "x")
    taken = found.groupBy(same).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum(F.col("b") * F.col("n")).over(in_order) - F.col("b") * F.col("n"))
    fits = taken.where(F.col("before") < most_bytes).select(*same, F.least("n", F.ceil((F.lit(most_bytes) - F.col("before")) / F.greatest("b", F.lit(1)))).alias("n"))
    texts: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for row in found.dropDuplicates(same).join(fits, same).toLocalIterator():
        texts[row["q"]] += [(row["o"], row["t"].encode())] * row["n"]
    forget(docs.sparkSession, path)
    ordered = {q: [t for _, t in sorted(texts[q])] for q in texts}
    n_bad, n_good = (known.where(F.col("q") == q).count() for q in (0, 1))
    share = (n_good + 0.5) / (n_bad + n_good + 1) if n_bad + n_good else 0.5
    flat = Compressors(None, np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if min(len(v) for v in ordered.values()) < 20:
        return Constant(share)
    try:
        dictionaries = tuple(zstandard.train_dictionary(DICTIONARY_BYTES, ordered[q][len(ordered[q]) // 3:]).as_bytes() for q in (0, 1))
    except zstandard.ZstdError:  # too little text for a dictionary of its own making
        dictionaries = tuple(b"\n".join(ordered[q][len(ordered[q]) // 3:])[-DICTIONARY_BYTES:] for q in (0, 1))
    unfitted = Compressors(dictionaries, flat.curve)
    unseen = [ordered[q][:len(ordered[q]) // 3] for q in (0, 1)]
    y = np.repeat([0.0, 1.0], [len(u) for u in unseen])
    curve = logistic(unfitted.features([*unseen[0], *unseen[1]]), y)
    # The sample has its own share of good texts; move the curve to that of all labels.
    drawn = len(unseen[1]) / (len(unseen[0]) + len(unseen[1]))
    curve[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Compressors(dictionaries, curve)


class Constant(Compressors):
    """Without enough labels, the share of good ones is the score of all texts."""

    def __init__(self, share: float):
        super().__init__(None, np.zeros(3))
        self.share = share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def score(text: Column, model: Compressors) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([(t or "").encode() for t in texts]))

    return scored(F.coalesce(text, F.lit("")))


def with_quality(docs: DataFrame, model: Compressors, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the score as its last column (``score``, or longer if that is taken)."""
    return docs.withColumn(fresh(docs, "score"), score(F.col(text_col), model))
