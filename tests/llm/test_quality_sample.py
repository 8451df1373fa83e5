"""The training sample of the quality operator."""

import random

from pactlens.llm import quality


def test_quality_sample_is_the_same_in_any_layout(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["good", "fine", "text"] if k % 2 else ["bad", "spam", "junk"], k=rng.randrange(20, 200))) + f" {k}") for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, quality int")
    rows += rows[:40] + [(1, "good " * 100_000)]
    models = []
    for layout in (sorted(rows), sorted(rows, reverse=True)):
        docs = spark.createDataFrame(layout, "doc_id bigint, text string").coalesce(1)
        models.append(quality.train(docs, labels, most_bytes=60_000))
    assert models[0].dictionaries and models[0].dictionaries == models[1].dictionaries and list(models[0].curve) == list(models[1].curve)
