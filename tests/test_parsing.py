import math

import pytest
from pyspark.sql import functions as F

from jobledger.functions import arithmetic, display, parsing


def column(spark, values, text, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(F.expr(text)).collect()]


def test_job_root_and_kind(spark):
    ids = ["12345", "12345.batch", "12345.extern", "12345.0", "12345.17", "12345.x", "12345_7", "12345_7.batch", "12345.", "x", None]
    assert column(spark, ids, parsing.job_root("v")) == ["12345"] * 9 + [None, None]
    assert column(spark, ids, parsing.job_kind("v")) == [
        "allocation", "batch", "extern", "step", "step", "unknown", "allocation", "allocation", "allocation", "allocation", "allocation",
    ]


def test_sizes(spark):
    texts = ["12K", "3M", "2G", "1.5G", "2T", "0", "", None, "7Gn", "K"]
    assert column(spark, texts, parsing.size_digits("v")) == ["12", "3", "2", "5", "2", None, None, None, "7", None]
    assert column(spark, texts, parsing.size_unit("v")) == ["K", "M", "G", "G", "T", None, None, None, "G", None]
    assert column(spark, texts, parsing.size_bytes("v")) == [
        12 * 1024, 3 * 1024**2, 2 * 1024**3, 5 * 1024**3, None, None, None, None, 7 * 1024**3, None,
    ]
    assert column(spark, ["2G"], parsing.gigabytes(parsing.size_bytes("v"))) == [2.0]


def test_cpu_seconds(spark):
    texts = ["1-02:03:04", "02:03:04", "03:04.567", "03:04", "", None, "x", "10-00:00:00", "02:03:04\n"]
    assert column(spark, texts, parsing.cpu_seconds("v")) == [93784, 7384, 184, 0, 0, 0, 0, 864000, 0]


def test_rule_names(spark):
    texts = ["rule_a_wildcards_s=1", "rule_a", "rule_a_b_wildcards_x_wildcards_y", "rule_x_wildcards_", "rule_", "other", None]
    assert column(spark, texts, parsing.rule_name("v")) == ["a", "a", "a_b", "x_wildcards_", None, None, None]
    assert column(spark, texts, parsing.wildcards("v")) == ["s=1", None, "x_wildcards_y", None, None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_timestamps_ignore_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2026-03-29T02:30:00", "Unknown", "None", "2026", "2026-03-29", None, "2026-13-01T00:00:00"]
        times = column(spark, texts, f"CAST({parsing.timestamp('v')} AS string)")
        assert times == ["2026-03-29 02:30:00"] + [None] * 6
        # The night the clocks change has six hours of wall time all the same.
        across = parsing.seconds_between("timestamp_ntz'2026-03-29 00:00:00'", parsing.timestamp("v"))
        assert column(spark, ["2026-03-29T06:00:00", "2026-03-28T23:59:59"], across) == [21600, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ieee_division(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (math.nan, 0.0)], "a double, b double"
    )
    got = [r[0] for r in df.select(F.expr(arithmetic.ieee_divide("a", "b"))).collect()]
    assert got[:3] == [0.5, math.inf, -math.inf]
    assert math.isnan(got[3]) and got[4:6] == [None, None] and math.isnan(got[6])


def test_extremes_skip_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", 3.0), ("b", math.nan), ("c", None)], "k string, v double")
    got = df.groupBy("k").agg(F.expr(arithmetic.min_number("v")), F.expr(arithmetic.max_number("v"))).collect()
    rows = {r[0]: tuple(r[1:]) for r in got}
    assert rows["a"] == (1.0, 3.0) and rows["c"] == (None, None)
    assert all(math.isnan(x) for x in rows["b"])


def test_bands(spark):
    values = [None, 0.0, 0.5, 20.0, 20.5, 21.0, 60.0, 61.0, 75.0, 76.0, 100.0, 110.0, 130.0, 151.0, -1.0, math.nan, math.inf]
    assert column(spark, values, display.band_colour("v"), "double") == [
        None, None, "#ff0000", "#ff0000", None, "#d4a500", "#d4a500", "#ffa500", "#ffa500", "#008000", "#008000", "#ffa500",
        "#ff0000", "#ff0000", "#ff0000", None, "#ff0000",
    ]


def test_duration_labels(spark):
    seconds = [3723.9, 123.0, 3.0, 0.0, None, 3600.0, 90000.0]
    assert column(spark, seconds, display.duration_label("v"), "double") == [
        "1h 2m 3s", "2m 3s", "3s", "0s", "N/A", "1h 0m 0s", "25h 0m 0s",
    ]
    assert column(spark, [1.005, None, 2.0], display.two_decimals("v"), "double")[1:] == ["0.00", "2.00"]


def test_numbers_beyond_64_bits_are_null(spark):
    rows = spark.createDataFrame([("99999999999G", "99999999999999999999-01:00:00"), ("1K", "9999999999999999-01:00:00"), (None, None)], "a string, b string")
    found = rows.selectExpr(parsing.size_bytes("a"), parsing.cpu_seconds("b")).collect()
    assert [tuple(r) for r in found] == [(None, None), (1024, None), (None, 0)]
