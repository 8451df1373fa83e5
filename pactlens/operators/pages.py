"""Repeated headers and footers of paged documents.

All pages of a document meet once, as one array; the vote on running lines and the cutting are
expressions over that array.  It holds the text of one document, as the row made of it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T


def gathered_pages(pages: DataFrame) -> DataFrame:
    """One row per document: its ``pages``, structs of all columns, by number and text."""
    others = [c for c in pages.columns if c not in ("document_id", "page_number", "text")]
    return pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text", *others))).alias("pages"))


def _more_than_half(lines: Column, n_pages: Column) -> Column:
    """The value, in an array of one or none, that stands on more than half of the pages.

    Such a value holds the middle of the sorted lines, so only that one is counted.
    """
    def counted(in_order: Column) -> Column:
        middle = F.get(in_order, F.floor(F.size(in_order) / 2).cast("int"))
        return F.filter(F.array(middle), lambda m: F.size(F.filter(in_order, lambda x: x == m)) > F.floor(n_pages / 2))

    return T.let(F.array_sort(lines), counted)


def running_lines(texts: Column) -> Column:
    """The lines that open or close more than half of the page texts of one document.

    There is at most one running header and one running footer; a single page has none.
    """
    filled = F.filter(F.transform(texts, lambda t: F.filter(F.transform(T.lines(t), T.strip), lambda x: x != "")), lambda p: F.size(p) > 0)
    repeated = T.let(filled, lambda ps: F.array_union(
        _more_than_half(F.transform(ps, lambda p: F.element_at(p, 1)), F.size(texts)),
        _more_than_half(F.transform(ps, lambda p: F.element_at(p, -1)), F.size(texts)),
    ))
    return F.when(F.size(texts) >= 2, repeated).otherwise(F.array().cast("array<string>"))


def cut_texts(texts: Column) -> Column:
    """The page texts of one document without running lines and page numbers."""
    def cut(running: Column) -> Column:
        kept = lambda line: T.let(T.strip(line), lambda bare: ~F.array_contains(running, bare) & ~T.matches(bare, rules.PAGE_NUMBER_LINE))
        return F.transform(texts, lambda t: F.array_join(F.filter(T.lines(t), kept), "\n"))

    return F.when(F.size(texts) >= 2, T.let(running_lines(texts), cut)).otherwise(texts)


def remove_running_lines(pages: DataFrame) -> DataFrame:
    """The pages without running headers, footers and page numbers; one exchange."""
    cut = gathered_pages(pages).withColumn("cut", cut_texts(F.transform("pages", lambda p: p["text"])))
    rows = cut.select("document_id", F.explode(F.arrays_zip(F.col("pages").alias("page"), F.col("cut").alias("cut"))).alias("z"))
    column = lambda c: F.col(c) if c == "document_id" else F.col("z.cut").alias(c) if c == "text" else F.col("z.page")[c].alias(c)
    return rows.select(*[column(c) for c in pages.columns])
