"""Exact quantiles by ranges against sorted lists."""

import random

import pytest

from pactlens.operators import metrics, quantiles


def interpolated(values, share):
    values, place = sorted(values), share * (len(values) - 1)
    low, part = int(place), place - int(place)
    return values[low] if not part else (1 - part) * values[low] + part * values[low + 1]


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(2)
    groups = {
        "one": [4.0], "same": [7.5] * 500, "two": [1.0, 2.0], "wide": [10.0 ** rng.randrange(-20, 20) for _ in range(700)],
        "plain": [rng.random() for _ in range(2000)], "hot": [3.0] * 3000 + [rng.gauss(3, 1) for _ in range(999)], None: [-1.0, 5.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("plain", None)]
    rng.shuffle(rows)
    got = {r["stage"]: r for r in metrics.latency_summary(spark.createDataFrame(rows, "stage string, ms double"), "stage").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = (interpolated(vs, 0.5), min(vs), max(vs), interpolated(vs, 0.95))
        assert (got[g]["median_ms"], got[g]["min_ms"], got[g]["max_ms"], got[g]["p95_ms"]) == pytest.approx(want, rel=1e-12), g


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([("a", None)], "stage string, ms double")
    assert metrics.latency_summary(none.limit(0), "stage").collect() == []
    assert metrics.latency_summary(none, "stage").first()["median_ms"] is None
