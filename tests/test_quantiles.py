import math
import random

import numpy as np
import pytest

from jobledger.operators.boxplot import box_points, box_statistics
from jobledger.operators.quantiles import grouped_quantiles

PROBABILITIES = {"p0": 0.0, "p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p100": 1.0}
METHODS = {"linear": "linear", "hazen": "hazen"}


def groups():
    rng = random.Random(7)
    return {
        "hot": [rng.lognormvariate(3, 2) for _ in range(3000)],
        "ties": [5.0] * 400 + [7.0] * 3 + [0.0] * 397,
        "whole": [float(rng.randrange(100000)) for _ in range(999)],
        "signed": [rng.gauss(0, 1e6) for _ in range(500)],
        "narrow": [50 + rng.random() * 1e-9 for _ in range(300)],
        "tiny": [rng.random() * 1e-12 for _ in range(101)],
        "one": [3.25],
        "two": [1.0, 2.0],
        None: [4.0, 1.0, 2.0],
    }


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, v) for k, vs in groups().items() for v in vs] + [("hot", None), ("empty", None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("method", METHODS)
def test_against_numpy(values, method):
    got = {r["k"]: r for r in grouped_quantiles(values, ["k"], "v", PROBABILITIES, method).collect()}
    assert set(got) == set(groups())
    for key, numbers in groups().items():
        assert got[key]["count"] == len(numbers)
        for name, p in PROBABILITIES.items():
            want = np.quantile(numbers, p, method=METHODS[method])
            assert got[key][name] == pytest.approx(want, rel=1e-12, abs=1e-300), (key, name)


def test_nan_and_infinities(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, math.inf, -math.inf, math.nan, 2.0)] + [("b", math.inf), ("b", math.inf)], "k string, v double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).collect()}
    assert got["a"]["low"] == -math.inf and got["a"]["mid"] == 2.0 and math.isnan(got["a"]["high"])
    assert got["b"]["mid"] == math.inf


def test_unknown_method(values):
    with pytest.raises(ValueError):
        grouped_quantiles(values, ["k"], "v", {"m": 0.5}, "other")


def brute_box(numbers, method):
    q1, med, q3 = (np.quantile(numbers, p, method=method) for p in (0.25, 0.5, 0.75))
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [x for x in numbers if low <= x <= high]
    out = [x for x in numbers if not low <= x <= high]
    suspected = [x for x in out if x < 4 * q1 - 3 * q3 or x > 4 * q3 - 3 * q1]
    return q1, med, q3, min(q1, min(inside)), max(q3, max(inside)), out, suspected


@pytest.mark.parametrize("method", METHODS)
def test_boxes_against_brute_force(values, method):
    boxes = {r["k"]: r for r in box_statistics(values, ["k"], "v", method).collect()}
    points = {}
    for r in box_points(values, ["k"], "v", method).collect():
        points.setdefault(r["k"], []).extend([(r["value"], r["suspected"])] * r["n"])
    for key, numbers in groups().items():
        q1, med, q3, low, high, out, suspected = brute_box(numbers, METHODS[method])
        box = boxes[key]
        assert (box["q1"], box["median"], box["q3"], box["whisker_low"], box["whisker_high"]) == pytest.approx((q1, med, q3, low, high), rel=1e-9)
        assert (box["min"], box["max"], box["count"]) == (min(numbers), max(numbers), len(numbers))
        assert (box["outliers"], box["suspected_outliers"]) == (len(out), len(suspected))
        assert sorted(v for v, _ in points.get(key, [])) == sorted(out)
        assert sorted(v for v, s in points.get(key, []) if s) == sorted(suspected)


def test_no_task_holds_a_group(values):
    """The plan has no aggregation buffer that grows with a group, and counts values before the first shuffle."""
    plan = grouped_quantiles(values, ["k"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    for growing in ("collect_list", "percentile", "collect_set", "ObjectHashAggregate"):
        assert growing not in plan
    assert "partial_count" in plan
