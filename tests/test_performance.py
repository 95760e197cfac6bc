"""Deviations of long, nearly equal durations against exact arithmetic."""

import random
from fractions import Fraction

import pytest

from batchlens.operators import performance as p


def deviation(values):
    if len(values) < 2:
        return 0.0
    mean = Fraction(sum(values), len(values))
    return float(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5


def test_deviation_keeps_its_digits(spark):
    rng = random.Random(6)
    runs = {"near": [10**12 + rng.randrange(3) for _ in range(400)], "same": [10**12 + 7] * 50, "one": [5], "wide": [rng.randrange(10**9) for _ in range(90)],
            "far": [10**15 + rng.randrange(2) for _ in range(64)], "small": [1, 2, 2, 3]}
    rows = [(f"{k}{i}", k, v, "COMPLETED") for k, vs in runs.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "id string, sic_id string, duration_ms long, status string").selectExpr("*", "DATE '2024-03-01' AS business_date")
    sics = spark.createDataFrame([(k,) for k in [*runs, "none"]], "id string")
    got = {r.sic_id: r for r in p.anomaly_baseline(df, sics, "2024-03-05").collect()}
    for k, values in runs.items():
        assert got[k].hist_std_ms == pytest.approx(deviation(values), rel=1e-9, abs=1e-12)
        assert got[k].hist_avg_ms == pytest.approx(sum(values) / len(values)) and got[k].hist_sample_count == len(values)
    assert got["none"].hist_std_ms is None and got["none"].hist_avg_ms is None and got["none"].hist_sample_count == 0
