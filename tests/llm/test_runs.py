"""The pipeline and queries without SQL, run whole on a small folder of tables, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pactlens.llm import queries

RNG = random.Random(5)
WORDS = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("n", "st", "rm", "ll")]
ITEMS = [(f"q{k}", " ".join(RNG.choices(WORDS, k=25))) for k in range(3)] + [("q3", None)]
FRESH = [(k, " ".join(RNG.choices(WORDS, k=60)), "en" if k % 2 else "de", (None, "a", "b")[k % 3]) for k in range(20)]
# A near copy, a benchmark passage, two texts without letters, an exact copy.
LEFT_OUT = [(20, FRESH[0][1] + " more", "de", "a"), (21, "see " + ITEMS[1][1] + " end", "en", "a"), (22, "½ 12", "en", "a"), (23, None, "en", "b"), (24, FRESH[1][1], "en", "b")]
DOCS = FRESH + LEFT_OUT
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def tokens(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
    return len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_pipeline(spark, folder):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", FRESH)
    taken = {r[0]: r[4] // r[1] for r in con.execute(queries.ORACLES["op4_mixing"]).fetchall()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter({(k, *tokens(t)): taken[k] for k, t, _, _ in FRESH if taken[k]})


def test_token_output(spark, folder):
    got = sorted(queries.op1_token_output(spark, folder).collect(), key=lambda r: r["start"])
    want, at = [], 0
    for k, t, _, _ in DOCS:
        n, crc = tokens(t)
        want.append((k, at, n, crc))
        at += n
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want


def test_decontamination(spark, folder):
    for r in queries.op3_decontamination(spark, folder).collect():
        text, hit = DOCS[r["doc_id"]][1] or "", r["doc_id"] == 21
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(text.split()), 25 * hit, int(hit), hit)
        assert r["items_sha256"] == hashlib.sha256(b"q1" if hit else b"").hexdigest()


def test_jaccard_join(spark, folder):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_jaccard_join(spark, folder).collect()}
    sets = {k: {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for k, t, _, _ in DOCS for w in [(t or "").split()]}
    assert got == {k: (len(s), {20: 0, 24: 1}.get(k, k)) for k, s in sets.items()}


def test_pipeline_with_clashing_columns_a_long_text_and_nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd_tables"))
    long_text = " ".join(f"{w}{k % 977}x{k}" for k in range(60_000) for w in ("word",))
    docs = [(k, t, l, s, "a", 1, "b", 2, "c") for k, t, l, s in [*FRESH, (30, long_text, "en", "a"), (31, "", "en", "a")]]
    schema = "doc_id bigint, text string, lang string, source string, language string, contamination int, score string, h int, component_id string"
    table = spark.createDataFrame(docs, schema)
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    seen = []
    for k, df in enumerate((table, table.limit(0))):
        for _, stage in corpus_pipeline.STAGES:
            out = f"{path}/stage{k}-{len(seen)}"
            stage(spark, df, path).write.parquet(out)
            df = spark.read.parquet(out)
            seen.append(df.columns)
        if k == 0:
            got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in df.collect()}
            assert got and 31 not in got and all(v == tokens(long_text if i == 30 else dict((d[0], d[1]) for d in FRESH)[i]) for i, v in got.items())
    assert df.count() == 0 and all(c == table.columns for c in seen[:4] + seen[5:9])
