"""Decontamination with a benchmark of several blocks, against plain Python."""

import random

from pactlens.llm import decontaminate


def test_benchmark_in_blocks(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = [(f"q{k}", " ".join(rng.choices(words, k=30))) for k in range(12)] + [(None, " ".join(rng.choices(words, k=14))), ("short", "one Two"), ("void", None)]
    docs = []
    for k in range(30):
        parts = [" ".join(rng.choices(words, k=8))]
        for _, text in rng.sample(items, rng.randrange(0, 4)):
            split = (text or "").split()
            at = rng.randrange(0, max(1, len(split) - 12))
            parts += [" ".join(split[at:at + rng.randrange(8, 16)]), "x"]
        docs.append((k, ", ".join(parts)))
    docs += [(30, None), (31, ""), (32, items[0][1] + " " + items[1][1])]
    windows = [(i, tuple(w[k:k + 10])) for i, t in items for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 9) if w else 0)]
    want = {}
    for k, text in docs:
        w = (text or "").lower().replace(",", "").split()
        hit = [(a, i, len(p)) for i, p in windows for a in range(len(w)) if tuple(w[a:a + len(p)]) == p]
        want[k] = len(w), {x for a, _, n in hit for x in range(a, a + n)}, sorted({i for _, i, _ in hit if i})
    table, benchmark = spark.createDataFrame(docs, "k int, text string"), spark.createDataFrame(items, "item_id string, text string")
    for how in ({}, {"block_bytes": 300}, {"block_windows": 40}):
        found = decontaminate.with_hits(table, benchmark, **how)
        # One pass per plan: a task holds one block.
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        got = {r["k"]: r["contamination"] for r in found.collect()}
        assert {k: (c["n_words"], {x for a, b in zip(c["hits"][::2], c["hits"][1::2]) for x in range(a, b)}, c["items"]) for k, c in got.items()} == want
