"""Language of texts and of spans inside them (operator 10).

Every language is a table of log probabilities of hashed letter pairs and triples of words.
The script of a word (by ranges of code points) narrows its candidates to the languages that
were seen in that script.  Viterbi over the per-word scores, with a penalty for every switch,
labels each word; equal neighbours form spans, and the language with most letters is the
prediction.

The tables come from at most about ``TRAIN_ROWS`` whole labelled texts per language, chosen
by a hash of the row; their counts are summed in Spark, and only the sums (languages x
buckets) reach the driver.  Long texts are cut into blocks that are solved side by side for
every state in front of them and then joined, which gives the exact best path.  Texts longer
than a chunk go forward piece by piece, keep the path values in front of each piece, and work
the pieces out again on the way back, so a worker holds one piece however long the text and
however many languages there are.

Defined cases: null or letterless text is ``und`` with score 0; without any labelled row all
rows are ``und``; equal scores go to the first language in order; repeated rows get equal
results; other columns pass through.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import bound_batches, fresh, give_back, is_held_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS = 1500
BITS = 16
PENALTY, WEIGHT = 6.0, 1.0
BLOCK = 128
#: Words x labels x labels that are solved at once, and words at most; bytes of the scored words that are kept.
CELLS, PIECE_WORDS, KEPT_BYTES = 1 << 24, 1 << 18, 64 << 20
#: Words whose letter pairs and triples are held at once: some 100 bytes a letter.
GRAM_WORDS = 1 << 13
WORD = re.compile(r"[^\W\d_]+")
NONE = "und"

# First code point of each script range, in order, with its script.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"), (0x31F0, "Kana"),
    (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "other"),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFDD, "other"), (0x20000, "Han"), (0x323B0, "other"),
)
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
SCRIPT_OF = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


def words_of(text: str) -> list[str]:
    """The runs of letters, in lower case."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # Superscripts, fractions, circled and Roman numbers fit the pattern, but are no letters.
    return [w for f in found for w in ([f] if f.isalpha() else "".join(c if c.isalpha() else " " for c in f).split())]


def words_from(text: str, at: int) -> Iterator[tuple[int, str]]:
    """The same words one by one, with their places, from ``at`` on in a text in lower case."""
    for found in WORD.finditer(text, at):
        here = found.start()
        for letters, run in groupby(found.group(), str.isalpha) if not found.group().isalpha() else [(True, found.group())]:
            word = "".join(run)
            if letters:
                yield here, word
            here += len(word)


def pieces_of(text: str, size: int, at: int = 0) -> Iterator[tuple[int, list[str]]]:
    """The words from ``at`` on in pieces of ``size`` words, each with the place where it starts."""
    while piece := list(islice(words_from(text, at), size)):
        yield at, [w for _, w in piece]
        at = piece[-1][0] + len(piece[-1][1])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all pairs and triples of letters, the word each belongs to, word scripts."""
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    pairs = points[:-1] * np.uint64(0x9E3779B1) + points[1:] * np.uint64(0x85EBCA77)
    triples = pairs[:-1] + points[2:] * np.uint64(0xC2B2AE3D) + np.uint64(0x165667B1)
    two, three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    code = np.concatenate([pairs[two], triples[three]]) * np.uint64(0x9E3779B97F4A7C15)
    firsts = points[np.cumsum(sizes) - sizes + 1]
    return (code >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([owner[:-1][two], owner[:-2][three]]), SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, firsts, "right") - 1]


def forward(scores: np.ndarray, sizes: np.ndarray, penalty: float, reach: np.ndarray) -> tuple[np.ndarray, Callable]:
    """The values of the best paths at the end of each text, and the way back.

    ``scores`` holds texts of ``sizes`` words one by one, ``reach`` the values in front of each
    text (texts x labels).  The way back takes the label at the end of each text and gives the
    labels of all words and the label in front of each text.
    """
    n, states = scores.shape
    # Blocks of at most BLOCK words; the lanes of a block are the labels in front of it.
    per_text = -(-sizes // BLOCK)
    first_block = np.cumsum(per_text) - per_text
    text_of = np.repeat(np.arange(len(sizes)), per_text)
    nth = np.arange(len(text_of)) - first_block[text_of]
    start = (np.cumsum(sizes) - sizes)[text_of] + nth * BLOCK
    length = np.minimum(BLOCK, sizes[text_of] - nth * BLOCK)
    order = np.argsort(-length, kind="stable")
    begin, size = start[order], length[order]
    value = np.full((len(order), states, states), -1e9)
    value[:, np.arange(states), np.arange(states)] = 0.0
    switched = np.zeros((n, states, states), bool)
    source = np.zeros((n, states), np.int8 if states < 128 else np.int16)
    ends = np.empty_like(value)
    for t in range(int(size[0])):
        active = int(np.searchsorted(-size, -t, "left"))  # blocks longer than t
        if active < len(value):
            ends[active:len(value)] = value[active:]
            value = value[:active]
        at = begin[:active] + t
        top = value.argmax(axis=2)
        left = np.take_along_axis(value, top[:, :, None], 2) - penalty
        moved = value < left
        value = np.where(moved, left, value) + scores[at][:, None, :]
        switched[at], source[at] = moved, top
    ends[:len(value)] = value
    matrix = np.empty_like(ends)
    matrix[order] = ends
    # Join the blocks of each text.
    entry = np.zeros((len(text_of), states), np.int64)
    reach = reach.copy()
    for j in range(int(per_text.max(initial=0))):
        texts = np.flatnonzero(per_text > j)
        through = reach[texts][:, :, None] + matrix[first_block[texts] + j]
        entry[first_block[texts] + j] = through.argmax(axis=1)
        reach[texts] = through.max(axis=1)

    def back(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Over blocks first, then inside all blocks at once.
        label = label.copy()
        last, before = np.zeros(len(text_of), np.int64), np.zeros(len(text_of), np.int64)
        for j in range(int(per_text.max(initial=0)) - 1, -1, -1):
            texts = np.flatnonzero(per_text > j)
            block = first_block[texts] + j
            last[block] = label[texts]
            before[block] = entry[block, label[texts]]
            label[texts] = before[block]
        out = np.zeros(n, np.int64)
        current, lane = last[order], before[order]
        for t in range(int(size[0]) - 1, -1, -1):
            active = int(np.searchsorted(-size, -t, "left"))
            at, now, k = begin[:active] + t, current[:active], lane[:active]
            out[at] = now
            current[:active] = np.where(switched[at, k, now], source[at, k], now)
        return out, label

    return reach, back


def best_path(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; ``scores`` holds texts of ``sizes`` words one by one.

    A path gains the score of each word's label and loses ``penalty`` at each change of label.
    """
    n, states = scores.shape
    if n == 0 or states == 1:
        return np.zeros(n, np.int64)
    reach, back = forward(scores, sizes, penalty, np.zeros((len(sizes), states)))
    return back(reach.argmax(axis=1))[0]


class LanguageModel:
    """Log probabilities of the languages and what a worker has scored so far."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, penalty: float = PENALTY):
        self.languages, self.penalty = languages, penalty
        smooth = counts + 0.3
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else np.zeros(counts.shape)
        self.logs = WEIGHT * (logs - logs.mean(axis=0)) if len(languages) else logs
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.writes = share >= 0.01
        k = max(1, len(languages))
        #: Words solved at once: whole blocks where they fit.
        self.piece = max(1, min(PIECE_WORDS, CELLS // k ** 2))
        self.piece -= self.piece % BLOCK if self.piece > BLOCK else 0
        self.kept = KEPT_BYTES // (160 + 16 * k)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)), np.float64)

    def rows(self, words: list[str]) -> np.ndarray:
        """The scores of words, a row each; new ones are worked out together."""
        if len(self.index) > self.kept:
            self.clear()
        unknown = [w for w in set(words) if w not in self.index]
        for new in (unknown[k:k + GRAM_WORDS] for k in range(0, len(unknown), GRAM_WORDS)):
            bucket, owner, script = grams(new)
            scored = np.stack([np.bincount(owner, row[bucket], len(new)) for row in self.logs], axis=1)
            allowed = self.writes[:, script].T
            scored = np.where(allowed | ~allowed.any(axis=1, keepdims=True), scored * allowed, -1e4)
            start = len(self.index)
            while len(self.table) < start + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[start:start + len(new)] = scored
            self.index.update(zip(new, range(start, start + len(new))))
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def label_all(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """``label`` of each text, short ones together in chunks, long ones in pieces."""
        out, held, size, most = [], [], 0, 2 * self.piece  # a word and its gap have two letters or more
        for text in texts:
            if len(text) > most or size + len(text) > most:
                out += self.label(held)
                held, size = [], 0
            if len(text) > most:
                out.append(self.label_long(text))
            else:
                held.append(text)
                size += len(text)
        return out + self.label(held)

    def label_long(self, text: str) -> tuple[str, float, list[tuple[int, int, str]]]:
        """(language, score, spans of words) of a text that is solved piece by piece."""
        k, text = len(self.languages), text.lower()
        if not k:
            return NONE, 0.0, []
        starts, fronts, reach, total = [], [], np.zeros((1, k)), np.zeros(k)
        for start, words in pieces_of(text, self.piece):
            starts.append(start)
            fronts.append(reach)
            scores = self.rows(words)
            total += scores.sum(axis=0)
            reach = forward(scores, np.array([len(words)]), self.penalty, reach)[0]
        if not starts:
            return NONE, 0.0, []
        label, parts, letters = reach.argmax(axis=1), [], np.zeros(k)
        for start, front in zip(reversed(starts), reversed(fronts)):
            words = next(pieces_of(text, self.piece, start))[1]
            labels, label = forward(self.rows(words), np.array([len(words)]), self.penalty, front)[1](label)
            letters += np.bincount(labels, np.fromiter(map(len, words), np.float64, len(words)), k)
            parts.append(labels.astype(np.int16))
        labels = np.concatenate(parts[::-1])
        chosen = int(letters.argmax())
        score = letters[chosen] / max(1.0, letters.sum()) / max(1.0, np.exp(np.clip(total - total[chosen], -60, 60)).sum())
        change = np.flatnonzero(np.diff(labels, prepend=-1))
        spans = [(a, b, self.languages[labels[a]]) for a, b in zip(change.tolist(), [*change[1:].tolist(), len(labels)])]
        return self.languages[chosen], float(score), spans

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans of words) of each text; all of them are solved at once."""
        found = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        words = [w for f in found for w in f]
        if not words or not self.languages:
            return [(NONE, 0.0, [])] * len(texts)
        scores = self.rows(words)
        labels = best_path(scores, sizes, self.penalty)
        owner = np.repeat(np.arange(len(texts)), sizes)
        k = len(self.languages)
        letters = np.bincount(owner * k + labels, np.fromiter(map(len, words), np.float64, len(words)), len(texts) * k).reshape(-1, k)
        total = np.stack([np.bincount(owner, scores[:, j], len(texts)) for j in range(k)], axis=1)
        chosen = letters.argmax(axis=1)
        share = letters[np.arange(len(texts)), chosen] / np.maximum(1, letters.sum(axis=1))
        odds = np.exp(np.clip(total - total[np.arange(len(texts)), chosen][:, None], -60, 60))
        score = share / np.maximum(1.0, odds.sum(axis=1))
        change = np.flatnonzero(np.diff(labels, prepend=-1) | np.diff(owner, prepend=-1))
        stops = np.append(change[1:], len(labels))
        first = np.cumsum(sizes) - sizes
        spans: list[list] = [[] for _ in texts]
        for a, b in zip(change.tolist(), stops.tolist()):
            d = int(owner[a])
            spans[d].append((a - int(first[d]), b - int(first[d]), self.languages[labels[a]]))
        return [(self.languages[c], float(s), p) if n else (NONE, 0.0, []) for c, s, p, n in zip(chosen, score, spans, sizes)]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> LanguageModel:
    """The model of the labelled rows that are not held out."""
    bound_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(F.col(id_col)))
    counted = known.groupBy(F.col(lang_col).alias("l")).count().collect()  # one row per language
    languages = sorted(r["l"] for r in counted)
    if not languages:
        return LanguageModel([], np.zeros((0, 1 << BITS)), np.zeros((0, len(SCRIPT_NAMES))), penalty)
    # Expected numbers: `rows` texts of each language, the same ones in every run.
    rates = F.create_map(*[F.lit(x) for r in counted for x in (r["l"], min(1.0, rows / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("train"), F.col(id_col).cast("string"), F.col(text_col)), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where(draw < rates[F.col("l")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in give_back(batches):
            for language, texts in batch.groupby("l")["t"]:
                for text in texts:
                    for _, words in pieces_of(text.lower(), GRAM_WORDS):
                        bucket, _, script = grams(words)
                        held = sums.setdefault(language, np.zeros((1 << BITS) + len(SCRIPT_NAMES)))
                        held[:1 << BITS] += np.bincount(bucket, minlength=1 << BITS)
                        held[1 << BITS:] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for language, held in sums.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"l": language, "bucket": at, "n": held[at].astype(np.int64)})

    sums = sample.mapInPandas(count, "l string, bucket bigint, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), (1 << BITS) + len(SCRIPT_NAMES)))
    got = sums.toPandas()  # at most languages x (buckets + scripts) rows
    counts[got["l"].map({l: k for k, l in enumerate(languages)}).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy()
    return LanguageModel(languages, counts[:, :1 << BITS], counts[:, 1 << BITS:], penalty)


def language(text: Column, model: LanguageModel) -> Column:
    """struct(lang, score, spans): spans are ranges of words (runs of letters), ends exclusive."""

    @F.pandas_udf("lang string, score double, spans array<struct<first:int,last:int,lang:string>>")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in give_back(batches, done=model.clear):
            rows = model.label_all(texts)
            yield pd.DataFrame({
                "lang": [r[0] for r in rows], "score": [r[1] for r in rows],
                "spans": [[dict(zip(("first", "last", "lang"), s)) for s in r[2]] for r in rows],
            })

    return labelled(F.coalesce(text, F.lit("")))


def with_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the prediction as its last column (``language``, or longer if taken)."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, "language"), language(F.col(text_col), model))


def accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language, same columns."""
    found = with_language(docs, model, text_col=text_col)
    return found.where(F.col(f"{found.columns[-1]}.lang") != NONE).select(*docs.columns)
