"""Attention levels (T1-T4): one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.functions.needles import anchors, may_match

PATTERNS = [p for p, _ in rules.STRONG_INDICATORS + rules.WEAK_INDICATORS]


def _reasons(text: Column, indicators, marks: Column | None) -> Column:
    may = lambda p: None if marks is None else may_match(marks, PATTERNS, p)
    hits = F.array(*[F.when(T.matches(text, p, may=may(p)), F.lit(reason)) for p, reason in indicators])
    return F.filter(hits, lambda r: r.isNotNull())


def strong_reasons(text: Column, marks: Column | None = None) -> Column:
    """Reasons of the strong indicators that match, in rule order; ``marks`` are the ``anchors`` of all."""
    return _reasons(text, rules.STRONG_INDICATORS, marks)


def weak_reasons(text: Column, marks: Column | None = None) -> Column:
    """Reasons of the weak indicators that match, in rule order."""
    return _reasons(text, rules.WEAK_INDICATORS, marks)


def level(n_strong: Column, n_weak: Column, high: int = rules.HIGH_MIN_STRONG, medium: int = rules.MEDIUM_MIN_STRONG) -> Column:
    """The level that the numbers of matching indicators stand for."""
    return (
        F.when(n_strong >= high, rules.HIGH).when(n_strong >= medium, rules.MEDIUM)
        .when(n_weak > 0, rules.LOW).otherwise(rules.INFORMATIONAL)
    )


def assign_levels(clauses: DataFrame, high: int = rules.HIGH_MIN_STRONG, medium: int = rules.MEDIUM_MIN_STRONG) -> DataFrame:
    """T4: adds ``attention_level`` and ``attention_reasons``."""
    no_text = F.array().cast("array<string>")
    text, marks = F.col("text"), F.col("_marks")
    rows = clauses.withColumn("_marks", anchors(text, PATTERNS)).withColumn("_strong", strong_reasons(text, marks))
    rows = rows.withColumn("_weak", F.when(F.size("_strong") == 0, weak_reasons(text, marks)).otherwise(no_text))
    named = level(F.size("_strong"), F.size("_weak"), high, medium)
    reasons = (
        F.when(named.isin(rules.HIGH, rules.MEDIUM), F.col("_strong"))
        .when(named == rules.LOW, F.col("_weak"))
        .otherwise(F.array(F.lit(rules.NO_INDICATOR_REASON)))
    )
    return T.settle(rows, {"attention_level": named, "attention_reasons": reasons}).drop("_marks", "_strong", "_weak")
