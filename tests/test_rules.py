"""Column rules: safe numbers, half-up rounding, thresholds, number text, strip."""

from pyspark.sql import functions as F

from tuneshelf.functions import rules as R


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).collect()[0]["o"]


def test_safe_parses_text(spark):
    assert one(spark, R.safe("v"), " 1.5 ") == 1.5
    assert one(spark, R.safe("v"), "abc") is None
    assert one(spark, R.safe("v"), "") is None
    assert one(spark, R.safe("v"), None) is None
    assert one(spark, R.safe("v"), "NaN") is None          # NaN becomes null
    assert one(spark, R.safe("v"), "0.704") == 0.7


def test_only_decimal_numbers_parse(spark):
    for text in ("1.5d", "2f", "0x1p3", "1__0", "_1", "1e", "1,5", "--1"):
        assert one(spark, R.safe("v"), text) is None, text
    for text, value in (("1_000", 1000.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("\u3000 7 \u00a0", 7.0), ("+3", 3.0)):
        assert one(spark, R.safe("v"), text) == value, text
    assert one(spark, R.to_double("v"), "-Infinity") == float("-inf")


def test_number_text_is_plain(spark):
    for x in (12345678.0, 0.0005, 1e16, 5e-05, 1.5e-07, 123456789012.25, 0.001, 9999999.0, 100.0, -0.00025, 2.5e+20):
        assert one(spark, R.number_text("v"), x, "v double") == repr(x)


def test_round_half_up_and_negative_zero(spark):
    assert one(spark, R.round_half_up("v", 2), 2.675, "v double") == 2.68
    assert one(spark, R.round_half_up("v", 2), 0.125, "v double") == 0.13
    z = one(spark, R.round_half_up("v", 2), -0.001, "v double")
    assert z == 0.0 and str(z) == "0.0"
    assert one(spark, R.round_half_up("v", 2), float("inf"), "v double") == float("inf")


def test_threshold_compares_rounded_value(spark):
    # 0.704 rounds to 0.7, which is not > 0.7
    assert one(spark, R.safe_gt("v", 0.7), "0.704") is False
    assert one(spark, R.safe_gt("v", 0.7), "0.706") is True
    assert one(spark, R.safe_gt("v", 0.7), None) is False
    assert one(spark, R.energy_bucket("v"), "0.704") == "mid-energy"
    assert one(spark, R.energy_bucket("v"), "0.4") == "low-energy"
    assert one(spark, R.energy_bucket("v"), "abc") == "low-energy"
    assert one(spark, R.track_mood("v"), "0.61") == "happy and upbeat"


def test_number_text(spark):
    assert one(spark, R.safe_display("v"), "85") == "85.0"
    assert one(spark, R.safe_display("v"), "0.456") == "0.46"
    assert one(spark, R.safe_display("v"), None) == "N/A"
    assert one(spark, R.meta_number_text("v"), 0.0, "v double") == "0"
    assert one(spark, R.meta_number_text("v"), None, "v double") == "0"
    assert one(spark, R.fixed_decimals("v", 3), 0.0625, "v double") == "0.063"


def test_strip_all_whitespace(spark):
    assert one(spark, R.strip_ws("v"), "\t  hello world \n") == "hello world"
    assert one(spark, R.strip_ws("v"), "   ") == ""
    assert one(spark, R.strip_ws("v"), "\u3000\u00a0\u2009") == ""
    assert one(spark, R.strip_ws("v"), "\u2028a\u00a0b\x1f") == "a\u00a0b"


def test_routing_is_substring_match(spark):
    rows = [("top pop songs",), ("non-stop dance",), ("MOST PLAYED rock",), ("zzz",), ("laptop beats",)]
    df = spark.createDataFrame(rows, "q string").select(R.routes_to_tfidf("q").alias("t"))
    assert [r["t"] for r in df.collect()] == [True, True, True, False, True]
