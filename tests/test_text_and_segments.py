from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.operators import pages, segment
from pactlens.sources import documents as sources
from pactlens.sources.store import DocumentStore


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def segments(spark, raw):
    docs = sources.from_texts(spark.createDataFrame([("d", raw)], "document_id string, raw_text string"))
    return segment.segment(docs).orderBy("clause_index").collect()


def test_cleaning(spark):
    raw = "  Part 1.   Use \t of   the site.  \n\n\n\nLast line.   "
    assert one(spark, raw, T.clean_text) == "Part 1. Use of the site.\n\nLast line."
    assert one(spark, "“free” ‘of’ charge now​", T.clean_text) == "\"free\" 'of' charge now"
    assert one(spark, "on termi-\nnation and sub-\nLevel", T.clean_text) == "on termination and sub-\nLevel"
    assert one(spark, "a —\n b\r\nc\rd", T.clean_text) == "a - b\nc\nd"
    assert one(spark, " \t\n ", T.clean_text) == "" and one(spark, None, T.clean_text) == ""


def test_matching_form(spark):
    assert one(spark, " It’s‑so \n\t HERE ", T.matching_form) == "it's-so here"


def test_lines_and_words(spark):
    assert one(spark, "a b\x0bc\n", T.lines) == ["a", "b", "c"]
    assert one(spark, "\x1cone two  three ", T.words) == 3
    assert one(spark, "\x1f　x y\x85", T.strip) == "x y"


def test_shown_rounds_the_binary_value(spark):
    rows = spark.createDataFrame([(2.675,), (0.5075,), (0.125,), (1234567.125,), (-1000.005,), (None,)], "x double")
    assert [r[0] for r in rows.select(T.shown(F.col("x"), 2)).collect()] == [round(v, 2) for v in (2.675, 0.5075, 0.125, 1234567.125, -1000.005)] + [None]


def test_running_lines(spark):
    rows = [("d", n, f"ACME TERMS\nBody text number {n} stays.\nPage {n} of 3") for n in (1, 2, 3)] + [("e", 1, "Page 1\nkept")]
    out = pages.remove_running_lines(spark.createDataFrame(rows, "document_id string, page_number int, text string"))
    got = {(r["document_id"], r["page_number"]): r["text"] for r in out.collect()}
    assert got == {("d", n): f"Body text number {n} stays." for n in (1, 2, 3)} | {("e", 1): "Page 1\nkept"}


def test_numbered_sections(spark):
    rows = segments(spark, "Acme - Terms of Service\n\n1. Start\nFirst body.\nmore of it\n\n2. Fees\nSecond body.\n\n3. End\nThird body.")
    assert [(r["section_title"], r["text"]) for r in rows] == [
        ("1. Start", "First body. more of it"), ("2. Fees", "Second body."), ("3. End", "Third body.")]
    assert rows[0]["clause_id"] == "d_clause_001"


def test_hierarchy_and_letters(spark):
    rows = segments(spark, "SECTION 1: Use\n1.1 Allowed\nYou may read.\n(a) You may print.\n(b)\nYou may not sell.\n\nRest of it.\n\nA. Letters\nx y z\n\nLIMITS OF USE\n\nNone.")
    assert [(r["section_title"], r["text"]) for r in rows] == [
        ("1. Use - 1.1 Allowed", "You may read."), ("1. Use - 1.1 Allowed - (a)", "You may print."),
        ("1. Use - 1.1 Allowed - (b)", "You may not sell."), ("1. Use - 1.1 Allowed", "Rest of it."),
        ("A. Letters", "x y z"), ("LIMITS OF USE", "None.")]


def test_long_numbered_line_becomes_heading_once(spark):
    tail = "we speak here of many more things than a heading would ever want to hold in it"
    rows = segments(spark, f"1. Scope: {tail}\n\n2. Other: {tail}")
    assert [(r["section_title"], r["text"]) for r in rows] == [("1. Scope", tail), ("1. Scope", f"2. Other: {tail}")]


def test_unnumbered_text_and_fallback(spark):
    rows = segments(spark, "Privacy notes: we keep little.\n\nplain words only")
    assert [r["section_title"] for r in rows] == ["Privacy notes", "General"]
    only_headings = segments(spark, "1. First\n\n2. Second")
    assert [(r["section_title"], r["text"]) for r in only_headings] == [("General", "1. First"), ("General", "2. Second")]


def test_long_paragraph_is_packed(spark):
    sentence = "Word " * 99 + "end."
    rows = segments(spark, " ".join([sentence] * 6))
    assert [len(r["text"].split()) for r in rows] == [200, 200, 200]


def test_locations(spark):
    raw = "1. A\nSame words here.\n\n2. B\nSame words here.\n\n3. C\nun-\nbroken text"
    rows = segments(spark, raw)
    spots = [(r["source_location"]["start_char"], r["source_location"]["end_char"]) for r in rows]
    first = raw.index("Same")
    second = raw.index("Same", first + 1)
    # The third text was changed by cleaning, so it takes the running position.
    assert spots == [(first, first + 16), (second, second + 16), (second + 16, second + 16 + len("unbroken text"))]


def test_many_clauses_keep_their_order_and_place(spark):
    raw = "\n\n".join(f"{n}. Title\nBody number {n} of many." for n in range(1, 701))
    rows = segments(spark, raw)
    assert len(rows) == 700 and rows[699]["clause_id"] == "d_clause_700"
    assert all(raw[r["source_location"]["start_char"]:r["source_location"]["end_char"]] == r["text"] for r in rows)


def test_page_numbers(spark):
    rows = [("d", 1, "Head\n1. One\nalpha body\nPage 1"), ("d", 2, "Head\n2. Two\nbeta body\nPage 2")]
    paged = spark.createDataFrame(rows, "document_id string, page_number int, text string")
    found = segment.segment(sources.from_pages(paged), sources.page_ranges(paged)).orderBy("clause_index")
    shown = [r[0] for r in found.select(segment.location_display(F.col("source_location"))).collect()]
    raw = "\n".join(r[2] for r in rows)
    a, b = raw.index("alpha"), raw.index("beta")
    assert shown == [f"Page 1 (chars {a}-{a + 10})", f"Page 2 (chars {b}-{b + 9})"]


def test_validity(spark):
    rows = [("a", "   "), ("b", "short"), ("c", "long enough text")]
    checked = sources.check_texts(spark.createDataFrame(rows, "document_id string, raw_text string"))
    assert [r["document_id"] for r in sources.accepted(checked).collect()] == ["c"]
    assert {r["document_id"]: r["reject_reason"] for r in sources.quarantined(checked).collect()} == {
        "a": sources.NO_TEXT, "b": sources.TOO_SHORT}


def test_files_labels_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "terms.txt").write_text("Line one.\nLine two.")
    row = sources.read_text_files(spark, str(tmp_path / "in")).first()
    assert (row["document_id"], row["title"], row["raw_text"]) == ("terms", "terms.txt", "Line one.\nLine two.")
    (tmp_path / "labels.json").write_text('{"note": 1, "queries": [\n {"query": "q", "document_id": "d", "relevant_clause_ids": ["x", "y"]}]}')
    assert sources.read_labels(spark, str(tmp_path / "labels.json"), "queries").first()["relevant_clause_ids"] == ["x", "y"]
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.save(spark.createDataFrame([("a", "1"), ("b", "1")], "document_id string, raw_text string"), 1)
    store.save(spark.createDataFrame([("a", "2")], "document_id string, raw_text string"), 2)
    assert {r["document_id"]: r["raw_text"] for r in store.list().collect()} == {"a": "2", "b": "1"}
    assert store.get("a").first()["raw_text"] == "2" and store.get("zzz").count() == 0
