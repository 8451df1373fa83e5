"""Quality rules that clean lines first (operator 11), in DataFrame functions only.

Each line of a text is judged by its words: boilerplate (license and consent phrases in a
short line), navigation (separators that stand alone, or a short menu phrase), punctuation
(decorated words, shouting, or no word that ends a sentence).  Lines that fail are removed,
blank ones stay.  A document is rejected if it fails the base measures, or if more than half
of the characters of its words are gone with its lines.

Everything is one projection of array functions over the row: nothing is shuffled, and a hot
source or long document is no different from others.  Words in windows that occur twice are
found by hashes of the windows; where two hashes agree, the windows themselves are compared.

Defined cases: a null text has no words (all measures 0, rejected, cleaned text empty), so
have an empty one and one of blanks; rows that repeat are judged each for itself; other
columns pass through, and the added column takes another name where one has it; an empty
table gives an empty table.  A very long text is judged whole: its words and hashes, about 20
times its bytes, stand in one task, which bounds a text by the memory of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.llm.common import SPACE, fresh

# Fixed values of the base measures.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

# Fixed values of the line rules.
SEPARATORS = ["|", "»", "›", ">", "•", "·", "/", "::"]
BOILERPLATE_WORDS, MENU_WORDS = 25, 5
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|copyright (©|\(c\)|[0-9]{4})|© ?[0-9]{4}|terms of (use|service)|privacy policy"
    r"|cookie (policy|settings)|(use|uses|accept) cookies|enable javascript|subscribe to our newsletter|lorem ipsum|powered by"
)
MENU = r"(?i)^\W*(home|menu|next|previous|next page|previous page|log ?in|sign (in|up)|register|skip to (main )?content|back to top|read more|click here|share this|contact us|about us|site ?map)\W*$"
SENTENCE_END = r"[.!?…。！？।][\"'»”’)\]]*$"
SHOUT = r"[!?]{2,}"
#: A document may lose this part of the characters of its words.
MAX_LOST_PERCENT = 50

RULES = ["boilerplate", "navigation", "punctuation"]


def _strip(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(_strip(text, SYMBOLS))


def _failed_rule(line: Column, words: Column) -> Column:
    """The first rule that a line fails, null for a good or blank one."""
    n = F.size(words)
    separators = F.size(F.filter(words, lambda w: w.isin(SEPARATORS)))
    shouts = F.size(F.filter(words, lambda w: w.rlike(SHOUT)))
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE), RULES[0])
        .when((separators >= 3) & (separators * 4 >= n), RULES[1])
        .when((n <= MENU_WORDS) & line.rlike(MENU), RULES[1])
        .when((_symbols(line) * 2 > n) | (shouts * 3 > n) | ~F.exists(words, lambda w: w.rlike(SENTENCE_END)), RULES[2])
    )


def judged_lines(text: Column) -> Column:
    """Per line of a text: line, words, rule (the one it fails, or null)."""
    return F.transform(F.split(text, "\n"), lambda line: T.let(
        F.filter(F.split(line, SPACE + "+"), lambda w: w != ""),
        lambda words: F.struct(line.alias("line"), words.alias("words"), _failed_rule(line, words).alias("rule")),
    ))


def _in_twins(keyed: Column) -> Column:
    """The places (second field) of the structs whose key (first field) another one has, in order."""
    def place(sorted_: Column) -> Column:
        def twin(x: Column, at: Column) -> Column:
            return F.coalesce(F.get(sorted_, at)["key"] == x["key"], F.lit(False))

        return F.filter(F.transform(sorted_, lambda x, k: F.when(twin(x, k - 1) | twin(x, k + 1), x["at"])), lambda at: at.isNotNull())

    return F.sort_array(T.let(F.sort_array(keyed), place))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many of the words lie in windows of ``width`` words that occur twice or more."""
    def window(of: Column, at: Column) -> list[Column]:
        return [F.get(of, at + k) for k in range(width)]

    def hashes(word_hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(word_hashes) - width)
        return F.transform(starts, lambda at: F.xxhash64(*window(word_hashes, at)))

    def verified(hashed: Column) -> Column:
        likely = _in_twins(F.transform(hashed, lambda h, at: F.struct(h.alias("key"), at.alias("at"))))
        return _in_twins(F.transform(likely, lambda at: F.struct(F.concat_ws(" ", *window(words, at)).alias("key"), at.alias("at"))))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda at, k: F.least(F.coalesce(F.get(places, k + 1) - at, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    found = T.let(T.let(F.transform(words, lambda w: F.xxhash64(w)), hashes), lambda hashed: F.when(
        F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0)
    ).otherwise(T.let(verified(hashed), covered)))
    return F.when(F.size(words) > width, found).otherwise(F.lit(0)).cast("bigint")


def with_cleaning(docs: DataFrame, *, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """``docs`` with a struct column ``cleaning``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines that
    failed each rule (n_boilerplate, n_navigation, n_punctuation), lost_chars, kept, cleaned_text.
    """
    name = fresh(docs, "cleaning")
    lines, words, n_words, repeats = (fresh(docs, f"_{c}") for c in ("lines", "words", "n_words", "repeats"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    judged = docs.withColumn(lines, judged_lines(text))
    counted = judged.withColumn(words, F.flatten(F.transform(lines, lambda l: l["words"])))
    counted = counted.withColumns({n_words: F.size(words).cast("bigint"), repeats: repeated_words(F.col(words))})
    n_chars = lambda t: F.length(_strip(t, BLANKS)).cast("bigint")
    filled = F.transform(F.filter(lines, lambda l: F.size(l["words"]) > 0), lambda l: l["line"])
    failed = F.filter(lines, lambda l: l["rule"].isNotNull())
    lost = n_chars(F.array_join(F.transform(failed, lambda l: l["line"]), ""))
    base_failed = (F.col(n_words) < MIN_WORDS) | (100 * F.col(repeats) > MAX_REPEAT_PERCENT * F.col(n_words))
    fields = [
        F.col(n_words).alias("n_words"), n_chars(text).alias("word_chars"), _symbols(text).cast("bigint").alias("n_symbols"),
        T.let(filled, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("bigint").alias("n_dup_lines"),
        F.col(repeats).alias("n_repeat_words"), base_failed.alias("base_failed"),
        *[F.size(F.filter(lines, lambda l: l["rule"] == rule)).cast("bigint").alias(f"n_{rule}") for rule in RULES],
        lost.alias("lost_chars"), (~base_failed & (100 * lost <= max_lost_percent * n_chars(text))).alias("kept"),
        F.array_join(F.transform(F.filter(lines, lambda l: l["rule"].isNull()), lambda l: l["line"]), "\n").alias("cleaned_text"),
    ]
    return counted.withColumn(name, F.struct(*fields)).drop(lines, words, n_words, repeats)


def cleaned(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents that are kept, with their cleaned texts; same columns."""
    report = with_cleaning(docs, text_col=text_col, **how)
    name = next(c for c in report.columns if c not in docs.columns)
    return report.where(F.col(f"{name}.kept")).withColumn(text_col, F.col(f"{name}.cleaned_text")).select(*docs.columns)
