"""The corpus operators on small tables: odd rows, empty tables, the whole small data set."""

import random
import zlib

import duckdb
import pytest

from check import compare, connect
from pactlens.llm import decontaminate, exact_dedup, language_id, mixing, parity_join, personal_data, quality, queries, token_counts, token_output, url_filter

FOLDER = "/root/testdata/sf0.001"
LONG = "long text of words " * 20000
ROWS = [(1, None, "en", None), (2, "", None, "a"), (3, "one two three four five six", "en", "a"), (3, "one two three four five six", "en", "a"),
        (None, "one two three four five six", "en", "b"), (5, "One  two three four\tfive six", "en", None), (6, LONG, "en", "b"), (7, "...", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns whose names clash with those the operators add.
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as n_tokens", "2 as spans", "3 as mix", "4 as language", "5 as contamination", "6 as score")


def test_token_shards(spark, odd, tmp_path):
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        path = f"{tmp_path}/{name}"
        token_output.write_token_shards(docs, path, "byte_bpe_50k.json", 2, shard_tokens=50)
        rows = sorted(token_output.read_token_shards(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
        assert len(rows) == docs.count()
        at = 0
        for r in rows:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
            at += r["n_tokens"]


def test_columns_and_rows_stay(odd):
    model = language_id.train(odd)
    for make in (
        personal_data.with_spans, personal_data.masked, lambda d: decontaminate.with_hits(d, odd.selectExpr("doc_id as item_id", "text")),
        mixing.copies, lambda d: token_counts.with_token_counts(d, "piece_bpe_32k.model", 10), lambda d: language_id.with_language(d, model),
        lambda d: quality.with_quality(d, quality.train(d, d.selectExpr("doc_id", "1 as quality"))),
    ):
        out = make(odd)
        assert set(odd.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns)) and len(out.collect()) == len(ROWS)
        assert make(odd.limit(0)).collect() == []


def test_filters_keep_columns(odd):
    kept = language_id.accepted(odd, language_id.train(odd))
    assert kept.columns == odd.columns and kept.count() == 5
    reps = parity_join.representatives(odd, width=5, num=80, den=100)
    assert sorted(r["doc_id"] for r in reps.collect()) == [1, 2, 3, 6, 7] and reps.columns == odd.columns
    clean = decontaminate.clean(odd, odd.where("doc_id = 3").selectExpr("doc_id as item_id", "text"))
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 6, 7]
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd.limit(0)).count() == 0


def test_groups(odd):
    dup = exact_dedup.exact_duplicates(odd).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in dup if r["group_size"] > 1) == [
        ("1", 1, 2, True), ("2", 1, 2, False), ("3", 3, 3, True), ("3", 3, 3, True), ("None", 3, 3, False)]
    joined = parity_join.linked(odd, width=3, num=90, den=100).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in joined) == [("1", 1), ("2", 2), ("3", 3), ("3", 3), ("5", 3), ("6", 6), ("7", 7), ("None", 3)]
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == parity_join.linked(odd.limit(0), width=3, num=90, den=100).count() == 0


@pytest.mark.parametrize("width, num", [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, width, num):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "a"]
    for size, copies in [(3, 2), (6, 3), (12, 4), (40, 6), (90, 6), (120, 60)]:
        base = rng.choices(words, k=size)
        for _ in range(copies):
            copy = base[:]
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(copy))
    split = [(t or "").split() for t in texts]
    sets = [{tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()) for w in split]
    component = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x & y and 100 * len(x & y) >= num * len(x | y) and component[i] != component[j]:
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.linked(docs, width=width, num=num, den=100).collect()}
    assert got == {i: (len(s), component[i]) for i, s in enumerate(sets)}


def test_url_filter_propagates(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = spark.createDataFrame([
        (1, "http://good.com/a", link("friend.org")), (2, "http://friend.org/", None), (3, "http://bad.net/es/1", None), (4, "http://farm.org/?q", link("bad.net", "bad.net")),
        (5, None, None), (6, "no url", link("bad.net")), (7, "HTTP://WWW.Example.com/en/a?b#c", ""), (8, "https://x.example.com/en/", ""), (9, "http://plain.org#f", ""),
    ], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["judged"] for r in url_filter.judged(pages).collect()}
    assert {k: v["verdict"] for k, v in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow"}
    assert (got[7]["host"], got[7]["path"], got[7]["rule"]) == ("www.example.com", "/en/a", "www.example.com/en/") and got[5]["host"] == got[6]["path"] == ""
    assert got[2]["trust"] > 0 and url_filter.judged(pages.limit(0)).count() == 0


def test_url_filter_propagates_to_the_end(spark):
    # A chain of 20 hosts behind one blocked host, and a ring whose distrust never stops moving.
    links = {f"c{i}.org": [f"c{i - 1}.org" if i > 1 else "bad.net"] for i in range(1, 20)}
    links |= {"ring-a.org": ["bad.net", "ring-b.org"], "ring-b.org": ["ring-a.org"]}
    rows = [("http://bad.net/es/1", "")] + [(f"http://{h}/", "".join(f'<a href="http://{t}/">' for t in to)) for h, to in links.items()]
    into = {h: [s for s, to in links.items() if h in to] for h in ["bad.net", *links]}
    want = dict.fromkeys(into, 0.0)
    for _ in range(1000):
        new = {h: 0.15 * (h == "bad.net") for h in into}
        for h, sources in into.items():
            for s in sources:
                new[s] += 0.85 * want[h] / len(sources)
        want = new
    got = {r["judged"]["host"]: r["judged"] for r in url_filter.judged(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert set(got) == set(want) and all(abs(got[h]["distrust"] - want[h]) * len(want) <= 1e-6 for h in want)
    assert {h for h in got if got[h]["verdict"] == "block"} == {h for h in want if want[h] / 0.15 > url_filter.THRESHOLD} > {"bad.net"}
    assert want["c13.org"] > 0 < got["c19.org"]["distrust"]


def test_url_verdicts_do_not_depend_on_hosts_without_a_path(spark):
    links = {"a.org": ["bad.net"], "b.org": ["a.org"], "good.com": ["both.org"], "both.org": ["worse.net"], "c.org": ["d.org"]}
    links |= {f"many{k}.org": ["hub.net"] for k in range(20)}
    rows = [(f"http://{h}/es/x", "") for h in ("bad.net", "worse.net", "hub.net")] + [(f"http://{h}/", "".join(f'<a href="http://{t}/">' for t in to)) for h, to in links.items()]
    others = [(f"http://alone{k}.org/", "") for k in range(300)] + [(f"http://far{k}.net/es/", "") for k in range(5)] + [(f"http://far{k}.com/", "") for k in range(7)]
    read = lambda rows: {r["judged"]["host"]: r["judged"] for r in url_filter.judged(spark.createDataFrame(rows, "url string, html string")).collect()}
    few, many = read(rows), read(rows + others)
    assert {h: r["verdict"] for h, r in few.items()} == {h: many[h]["verdict"] for h in few}
    assert {h for h in few if few[h]["verdict"] == "block"} == {"bad.net", "worse.net", "hub.net", "a.org", "b.org"}
    # Trust along the links, distrust against them, by plain iteration.
    seeds = {"t": {"good.com"}, "d": {"bad.net", "worse.net", "hub.net"}}
    hosts = {*links, *(t for to in links.values() for t in to)}
    edges = [(s, t) for s, to in links.items() for t in to]
    for name, moves in (("t", edges), ("d", [(t, s) for s, t in edges])):
        out = {h: sum(a == h for a, _ in moves) for h in hosts}
        rank = dict.fromkeys(hosts, 0.0)
        for _ in range(300):
            rank = {h: 0.15 * (h in seeds[name]) / len(seeds[name]) + 0.85 * sum(rank[a] / out[a] for a, b in moves if b == h) for h in hosts}
        assert all(abs(few[h]["trust" if name == "t" else "distrust"] - rank[h]) < 1e-6 for h in few)


def test_hits_of_benchmark_blocks_joined_by_salted_keys(spark, monkeypatch):
    item = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    benchmark = spark.createDataFrame([(f"q{k}", item(k)) for k in range(6)], "item_id string, text string")
    docs = spark.createDataFrame([(k, item(k % 6) + (" and " + item(2) if k % 2 else ""), k % 5) for k in range(40)] + [(40, None, 1), (41, "", 1)], "k int, text string, contamination int")
    read = lambda: sorted((r["k"], r["contamination"], tuple(r[-1]["hits"]), tuple(r[-1]["items"])) for r in decontaminate.with_hits(docs, benchmark, block_bytes=150).collect())
    usual = read()
    monkeypatch.setattr(decontaminate._with_known, "__defaults__", (0,))
    assert read() == usual and len(usual) == 42 and sum(bool(h) for _, _, h, _ in usual) == 40
    assert all(i == tuple(sorted({f"q{k % 6}", *(["q2"] if k % 2 else [])})) for k, _, _, i in usual if k < 40)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLES[name]).startswith("ok")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    truth = dict(con.execute(f"select doc_id, lang from '{folder}/documents.parquet'").fetchall())
    found = [r for r in queries.op10_language_id(spark, folder).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 0.97 * len(found)
    label = dict(con.execute(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    scored = [(r["score"], label[r["doc_id"]]) for r in queries.op7_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for s, q in scored if q], [s for s, q in scored if not q]
    assert sum(g > b for g in good for b in bad) >= 0.8 * len(good) * len(bad)
