"""Segmentation of cleaned texts into clauses.

The rows are the lines of the documents.  All carry-forward state is expressed as
windows over one document in line order.  They share one partitioning and one sort,
and the later grouping by (document, block) needs no further exchange because the
rows are already clustered by document.  A window partition is the text of one input
row, so its size is bounded by what a single row can hold.  The raw text rides on the
first line of its document, so locating the clauses needs no join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens import rules
from pactlens.functions import text as T
from pactlens.functions.positions import locate

def _running():
    return Window.partitionBy("document_id").orderBy("pos")


def _up_to_here():
    return _running().rowsBetween(Window.unboundedPreceding, 0)


def _before():
    return _running().rowsBetween(Window.unboundedPreceding, -1)


_MAJOR_KINDS = ["major", "longmajor", "lettered", "upper"]


def document_lines(documents: DataFrame) -> DataFrame:
    """G1: one row per line of the cleaned text, stripped, with its position.

    The first line of a document also carries the ``payload`` struct of the document
    when there is one, so that later steps get it back without a join.
    """
    rows = documents.select(
        *documents.columns, F.posexplode(T.lines(F.col("cleaned_text"))).alias("pos", "raw_line")
    )
    return rows.select(
        "document_id", "pos", T.strip_ends(F.col("raw_line")).alias("line"),
        *([F.when(F.col("pos") == 0, F.col("payload")).alias("payload")] if "payload" in documents.columns else []),
    )


def _group(pattern: str, n: int, ignore_case: bool = False) -> Column:
    return F.regexp_extract("line", T.java(pattern, ignore_case), n)


def line_kinds(lines: DataFrame) -> DataFrame:
    """Kind of every line and the parts that its kind needs."""
    line = F.col("line")
    parts = lines.select(
        *lines.columns,
        line.rlike(T.java(rules.PAREN_LINE)).alias("is_paren"),
        line.rlike(T.java(rules.SUBSECTION_LINE)).alias("is_sub"),
        line.rlike(T.java(rules.MAJOR_LINE)).alias("is_major"),
        line.rlike(T.java(rules.LETTERED_LINE)).alias("is_lettered"),
        line.rlike(T.java(rules.UPPERCASE_LINE)).alias("is_upper"),
        (F.coalesce(F.lag("line").over(_running()), F.lit("")) == "").alias("prev_blank"),
        (F.coalesce(F.lead("line").over(_running()), F.lit("")) == "").alias("next_blank"),
    )
    rest = (
        F.when(F.col("is_paren"), T.strip(_group(rules.PAREN_LINE, 2)))
        .when(F.col("is_sub"), T.strip(_group(rules.SUBSECTION_LINE, 2)))
        .when(F.col("is_major"), T.strip(_group(rules.MAJOR_LINE, 2)))
        .when(F.col("is_lettered"), _group(rules.LETTERED_LINE, 2))
    )
    mark = (
        F.when(F.col("is_paren"), _group(rules.PAREN_LINE, 1))
        .when(F.col("is_sub"), _group(rules.SUBSECTION_LINE, 1))
        .when(F.col("is_major"), _group(rules.MAJOR_LINE, 1))
        .when(F.col("is_lettered"), _group(rules.LETTERED_LINE, 1))
    )
    parts = parts.withColumns({"mark": mark, "rest": rest}).withColumn("n_words", T.words(F.col("rest")))
    upper = F.col("is_upper") & F.col("prev_blank") & F.col("next_blank")
    kind = (
        F.when(line == "", "blank")
        .when(F.col("is_paren"), "paren")
        .when(F.col("is_sub"), "sub")
        .when(F.col("is_major") & (F.col("n_words") <= rules.MAX_MAJOR_WORDS), "major")
        .when(F.col("is_major"), "long")
        .when(F.col("is_lettered") & (F.col("n_words") <= rules.MAX_LETTERED_WORDS), "lettered")
        .when(upper, "upper")
        .otherwise("body")
    )
    is_title = (
        ~F.col("is_major")
        & T.let(T.folded(line), lambda lower: T.may_match(lower, rules.DOCUMENT_TITLE))
        & (T.words(line) <= rules.MAX_TITLE_WORDS)
        & T.matches(line, rules.DOCUMENT_TITLE)
    )
    return parts.select(
        *lines.columns, "mark", "rest", "n_words",
        kind.alias("kind"), upper.alias("as_upper"), is_title.alias("is_title"),
    )


def mark_title_prefix(kinds: DataFrame) -> DataFrame:
    """``in_prefix`` for the title lines (and blanks) that open a document."""
    skippable = F.col("is_title") | (F.col("kind") == "blank")
    return kinds.withColumn("in_prefix", F.min(skippable).over(_up_to_here()))


def document_titles(documents: DataFrame) -> DataFrame:
    """The last title line of the opening prefix, per document that has one."""
    marked = mark_title_prefix(line_kinds(document_lines(documents)))
    return (
        marked.where(F.col("in_prefix") & F.col("is_title"))
        .groupBy("document_id").agg(F.max_by("line", "pos").alias("document_title"))
    )


def resolve_long_headings(marked: DataFrame) -> DataFrame:
    """The first long numbered line without heading and open body becomes one."""
    kind = F.when(F.col("in_prefix"), "skip").otherwise(F.col("kind"))
    rows = marked.withColumn("kind", kind)
    bearing = F.col("kind").isin("body", "long") | (
        (F.col("kind") == "paren") & (F.col("rest") != "")
    ) | ((F.col("kind") == "sub") & (F.col("n_words") > rules.MAX_SUB_WORDS))
    rows = rows.withColumns({
        "heading_before": F.coalesce(F.max(F.col("kind").isin(_MAJOR_KINDS)).over(_before()), F.lit(False)),
        "body_open": F.coalesce(F.lag(bearing).over(_running()), F.lit(False)),
    })
    eligible = (F.col("kind") == "long") & ~F.col("heading_before") & ~F.col("body_open")
    rows = rows.withColumn("eligible", eligible)
    rows = rows.withColumn("eligible_before", F.coalesce(F.max("eligible").over(_before()), F.lit(False)))
    resolved = (
        F.when(F.col("eligible") & ~F.col("eligible_before"), "longmajor")
        .when((F.col("kind") == "long") & F.col("as_upper"), "upper")
        .when(F.col("kind") == "long", "body")
        .otherwise(F.col("kind"))
    )
    return rows.withColumn("kind", resolved).drop(
        "as_upper", "is_title", "in_prefix", "heading_before", "body_open", "eligible", "eligible_before"
    )


def _heading(text: Column) -> Column:
    return F.rtrim(T.strip(text), F.lit(".:- "))


def carry_headings(resolved: DataFrame) -> DataFrame:
    """Body text (null for other lines), block number and headings in force."""
    kind, mark, rest = F.col("kind"), F.col("mark"), F.col("rest")
    split_long = F.split(rest, r"(?U)(?<=[.:])\s+", 2)
    body = (
        F.when(kind == "body", F.col("line"))
        .when((kind == "paren") & (rest != ""), rest)
        .when((kind == "sub") & (F.col("n_words") > rules.MAX_SUB_WORDS), rest)
        .when((kind == "longmajor") & (F.size(split_long) > 1), split_long[1])
    )
    major = (
        F.when(kind.isin("major", "lettered"), _heading(F.concat(mark, F.lit(". "), rest)))
        .when(kind == "longmajor", _heading(F.concat(mark, F.lit(". "), split_long[0])))
        .when(kind == "upper", F.col("line"))
    )
    sub = F.when(F.col("n_words") > rules.MAX_SUB_WORDS, mark).otherwise(
        T.strip(F.concat_ws(" ", mark, rest))
    )
    rows = resolved.withColumns({"body": body, "major_here": major})
    # A reset is a non-null struct around a null, so that ignoring nulls keeps it.
    text = lambda value: F.struct(value.alias("v"))
    null = F.lit(None).cast("string")
    is_major = F.col("major_here").isNotNull()
    bearing = F.col("body").isNotNull()
    rows = rows.withColumns({
        "sub_event": F.when(is_major, text(null)).when(kind == "sub", text(sub)),
        "paren_event": (
            F.when(bearing | is_major | (kind == "sub"), text(null))
            .when(kind == "paren", text(mark))
        ),
        "starts": bearing & ((kind != "body") | ~F.coalesce(F.lag(bearing).over(_running()), F.lit(False))),
    })
    rows = rows.withColumns({
        "block": F.sum(F.col("starts").cast("int")).over(_up_to_here()),
        "major": F.last("major_here", ignorenulls=True).over(_up_to_here()),
        "sub": F.last("sub_event", ignorenulls=True).over(_up_to_here())["v"],
        "open_paren": F.last("paren_event", ignorenulls=True).over(_before())["v"],
    })
    paren = F.when(kind == "paren", mark).when(kind == "body", F.col("open_paren"))
    return rows.select(
        "document_id", "pos", "block", "body", "major", "sub", paren.alias("paren"),
        *(["payload"] if "payload" in resolved.columns else []),
    )


def section_title(major: Column, sub: Column, paren: Column, body: Column) -> Column:
    """Headings in force, else a short inline title, else ``General``."""
    headings = F.concat_ws(" - ", major, sub, F.concat(F.lit("("), paren, F.lit(")")))
    return F.when(headings != "", headings).otherwise(inline_title(body))


def inline_title(body: Column) -> Column:
    lead = F.regexp_extract(body, "(?s)" + T.java(rules.INLINE_TITLE), 1)
    short = (lead != "") & (T.words(lead) <= rules.MAX_INLINE_TITLE_WORDS)
    return F.when(short, T.strip(lead)).otherwise(rules.GENERAL)


def _blocks(carried: DataFrame) -> DataFrame:
    bearing = F.col("body").isNotNull()
    keep = [F.first("payload", ignorenulls=True).alias("payload")] if "payload" in carried.columns else []
    return carried.groupBy("document_id", "block").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(bearing, F.struct("pos", "body")))), lambda x: x["body"]
        ), " ").alias("body"),
        F.min_by(
            F.when(bearing, F.struct("major", "sub", "paren")), F.when(bearing, F.col("pos"))
        ).alias("at"),
        *keep,
    ).withColumn("body", T.strip(F.col("body")))


def assemble_blocks(carried: DataFrame) -> DataFrame:
    """Contiguous body lines joined by spaces, with their title."""
    return _blocks(carried).where("body <> ''").select(
        "document_id", "block",
        section_title(F.col("at.major"), F.col("at.sub"), F.col("at.paren"), F.col("body")).alias("section_title"),
        "body",
    )


def split_long(body: Column, max_words: int = rules.MAX_WORDS_PER_CLAUSE) -> Column:
    """Greedy packing of sentences into chunks of at most ``max_words`` words."""
    empty = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).alias("n"),
    )

    def pack(acc: Column, s: Column) -> Column:
        full = acc["open"].isNotNull() & (acc["n"] + s["n"] > max_words)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full, s["text"]).otherwise(F.concat_ws(" ", acc["open"], s["text"])).alias("open"),
            F.when(full, s["n"]).otherwise(acc["n"] + s["n"]).alias("n"),
        )

    sentences = F.transform(
        F.split(body, r"(?U)(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.struct(s.alias("text"), T.words(s).alias("n"))
    )
    packed = F.aggregate(sentences, empty, pack, lambda acc: F.array_append(acc["done"], acc["open"]))
    stripped = F.filter(F.transform(packed, T.strip), lambda c: c != "")
    # So short a text has no more words, with a space between two.
    short = (F.length(body) < 2 * max_words) | (T.words(body) <= max_words)
    return F.when(short, F.array(body)).otherwise(stripped)


def paragraphs(cleaned: Column) -> Column:
    """(title, text) of the paragraphs of a text in which no line carried body."""
    found = F.filter(F.transform(F.split(cleaned, "\n\n"), T.strip), lambda p: p != "")
    return F.transform(found, lambda p: F.struct(inline_title(p).alias("section_title"), p.alias("text")))


def _carry(documents: DataFrame) -> DataFrame:
    return carry_headings(resolve_long_headings(mark_title_prefix(line_kinds(document_lines(documents)))))


def blocks_of(documents: DataFrame) -> DataFrame:
    """The titled blocks of ``documents(document_id, cleaned_text)``."""
    return assemble_blocks(_carry(documents.select("document_id", "cleaned_text")))


def locate_all(raw: Column, texts: Column) -> Column:
    """(start_char, end_char, found) of every clause text of one document, in order.

    Each probe (first 40 characters) is searched from where the previous clause ended,
    then from the start; a probe that is nowhere takes the running position.
    """
    return locate(raw, F.transform(texts, lambda t: T.strip(F.substring(t, 1, 40))), F.transform(texts, F.length))


def segment(documents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Located clauses of ``documents(document_id, source_type, raw_text, cleaned_text)``.

    One exchange by ``document_id`` serves the whole chain: windows, both groupings and
    the optional join with ``pages(document_id, page_number, char_start, char_end)``,
    which documents with ``source_type = 'pdf'`` need for page numbers.
    """
    carried = _carry(documents.select(
        "document_id", "cleaned_text", F.struct("raw_text", "cleaned_text", "source_type").alias("payload")
    ))
    per_document = _blocks(carried).groupBy("document_id").agg(
        F.array_sort(F.collect_list(
            F.when(F.col("body") != "", F.struct("block", "at", "body"))
        )).alias("blocks"),
        F.first("payload", ignorenulls=True).alias("payload"),
    ).where(~T.is_blank(F.col("payload.cleaned_text")))
    titled = F.flatten(F.transform("blocks", lambda b: F.transform(
        split_long(b["body"]),
        lambda t: F.struct(
            section_title(b["at"]["major"], b["at"]["sub"], b["at"]["paren"], b["body"]).alias("section_title"),
            t.alias("text"),
        ),
    )))
    chunks = per_document.select(
        "document_id", "payload",
        F.when(F.size("blocks") > 0, titled).otherwise(paragraphs(F.col("payload.cleaned_text"))).alias("clauses"),
    )
    spots = locate_all(F.col("payload.raw_text"), F.transform("clauses", lambda c: c["text"]))
    rows = chunks.select(
        "document_id", F.col("payload.source_type").alias("source_type"),
        F.posexplode(F.arrays_zip(F.col("clauses").alias("c"), spots.alias("s"))).alias("i", "z"),
    ).select(
        "document_id", (F.col("i") + 1).alias("clause_index"), "source_type",
        F.col("z.c.section_title").alias("section_title"), F.col("z.c.text").alias("text"),
        F.col("z.s.start_char").alias("start_char"), F.col("z.s.end_char").alias("end_char"),
        F.col("z.s.found").alias("found"),
    )
    rows = _with_pages(rows, pages)
    return rows.select(
        F.format_string("%s_clause_%03d", "document_id", "clause_index").alias("clause_id"),  # G10
        "document_id", "clause_index", "section_title", "text", "source_location",
    )


def page_of(ranges: Column, offset: Column) -> Column:
    """The page whose range holds an offset, null if none does.

    ``ranges`` (char_start, char_end, page_number) in order of their starts; they do not overlap, so
    it is the last one that starts at or before the offset, which halving finds.
    """
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ranges) + 1)).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"] + 1) / 2).cast("int")
        before = F.get(ranges, middle)["char_start"] <= offset
        done = at["low"] >= at["high"]
        return F.struct(
            F.when(~done & before, middle).otherwise(at["low"]).alias("low"),
            F.when(~done & ~before, middle - 1).otherwise(at["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), (F.size(ranges) - 1).alias("high"))
    last = F.aggregate(halvings, start, halve, lambda at: F.get(ranges, at["low"]))
    found = T.let(last, lambda r: F.when((r["char_start"] <= offset) & (offset <= r["char_end"]), r["page_number"]))
    return F.when(F.size(ranges) > 0, found)


def _with_pages(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    no_page = F.lit(None).cast("int")
    if pages is None:
        return rows.withColumn("source_location", F.struct(
            F.when(F.col("source_type") == "pdf", 1).alias("page_number"),
            F.when((F.col("source_type") == "pdf") & F.col("found"), 1).alias("end_page_number"),
            "start_char", "end_char", "source_type",
        ))
    ranges = pages.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("char_start", "char_end", "page_number"))).alias("ranges")
    )
    rows = rows.join(ranges, "document_id", "left")
    page_at = lambda offset: F.coalesce(page_of(F.col("ranges"), offset), F.lit(1))
    paged, found = F.col("source_type") == "pdf", F.col("found")
    return rows.withColumn("source_location", F.struct(
        F.when(paged & found, page_at(F.col("start_char"))).when(paged, 1).otherwise(no_page).alias("page_number"),
        F.when(paged & found, page_at(F.col("end_char"))).otherwise(no_page).alias("end_page_number"),
        "start_char", "end_char", "source_type",
    ))


def location_display(loc: Column) -> Column:
    """A source location as text."""
    first, last = loc["page_number"], loc["end_page_number"]
    start, end = loc["start_char"], loc["end_char"]
    page = F.when(
        last.isNotNull() & (last != 0) & (last != first), F.format_string("Pages %d-%d", first, last)
    ).otherwise(F.format_string("Page %d", first))
    ranged = start.isNotNull() & end.isNotNull()
    return (
        F.when(first.isNotNull() & ranged, F.concat(page, F.format_string(" (chars %d-%d)", start, end)))
        .when(first.isNotNull(), page)
        .when(ranged, F.format_string("Offset %d-%d", start, end))
        .otherwise("Pasted Text")
    )
