"""Patterns that run only where they can match give what they gave everywhere."""

import random

from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.operators import segment

PIECES = [*T.WS_CHARS, "\r\n", "\n\n\n", "  ", " \n", *"ab.A-`'", "’", "—", "​", "﻿", "\xe9", "Terms of Service", "terKs"]


def _texts(spark, n=4000):
    dice = random.Random(7)
    texts = ["".join(dice.choice(PIECES if dice.random() < 0.5 else "ab. \n") for _ in range(dice.randrange(9))) for _ in range(n)]
    texts += [*T.WS_CHARS, *(f"a{c}" for c in T.WS_CHARS), *(f"{c}a" for c in T.WS_CHARS), *(f"a{c}\nb" for c in T.WS_CHARS), *(f"a{c}b" for c in T.WS_CHARS), "", None]
    return spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).cache()


def _plain_space(t):
    t = F.regexp_replace(F.translate(t, "\t", " "), r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)|( ) +", "$1")
    return F.regexp_replace(t, rf"(?U)\A{T.WS}+|{T.WS}+\z|(\n\n)\n+", "$1")


def _plain_encoding(t):
    t = F.translate(F.regexp_replace(t, "\r\n|\r", "\n"), T._MAP_FROM, T._MAP_TO)
    return F.regexp_replace(t, rf"(?U){T.WS}*[{rules.LONG_DASHES}]{T.WS}*", " - ")


def _plain_lines(t):
    return T.let(F.split(t, T.LINE_BREAK), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def test_cleaning_and_lines(spark):
    t = F.col("t")
    plain_clean = F.coalesce(_plain_space(T.reconnect_hyphenated(_plain_encoding(t))), F.lit(""))
    pairs = [
        (T.normalize_whitespace(t), _plain_space(t)), (T.normalize_encoding(t), _plain_encoding(t)), (T.clean_text(t), plain_clean),
        (T.lines(t), _plain_lines(t)), (T.lines(T.clean_text(t)), _plain_lines(plain_clean)), (T.strip_ends(t), T.strip(t)),
        (T.is_blank(t), F.coalesce(T.strip(t), F.lit("")) == ""),
    ]
    rows = _texts(spark).select("t", *[F.struct(a.alias("now"), b.alias("plain")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    for k in range(len(pairs)):
        assert rows.where(~F.col(f"p{k}.now").eqNullSafe(F.col(f"p{k}.plain"))).take(3) == [], k


def test_short_paragraphs_are_not_counted(spark):
    # 250 words of one letter and their spaces: whole; one word more: two chunks at a sentence.
    body = lambda n: " ".join(["A."] + ["b"] * (n - 1))
    rows = spark.createDataFrame([(250, body(250)), (251, body(251)), (3, "A. b c"), (0, "")], "n int, body string")
    got = {r["n"]: list(r["c"]) for r in rows.select("n", segment.split_long(F.col("body")).alias("c")).collect()}
    assert got[250] == [body(250)] and len(got[251]) == 1 and got[3] == ["A. b c"] and got[0] == [""]
    found = spark.range(1).select(segment.split_long(F.lit("A b. C d."), 2).alias("c")).first()["c"]
    assert list(found) == ["A b.", "C d."]
