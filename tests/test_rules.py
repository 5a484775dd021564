from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallyhouse.functions import kpi_text, rules
from tallyhouse.functions.money import capped_change_pct, ratio, rounded, weighted_mean
from tallyhouse.functions.periods import Periods, days_in_month
from tallyhouse.functions.stable import bucket
from tallyhouse.operators.filters import active_filters, axis_filter, compound_key, slice_of, snapshot_filter


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_time_type_and_null(spark):
    got = one(spark, [("bill",), ("Internal",), ("sick",), (None,), ("x",)], "t string", rules.clean_time_type("t"))
    assert [g[0] for g in got] == ["Billable", "Non-Billable", "Time Off", "Other", "Other"]


def test_aging_edges(spark):
    got = one(spark, [(d,) for d in (-1, 30, 31, 60, 61, 90, 91)], "d int", rules.aging_bucket(F.col("d")))
    assert [g[0] for g in got] == ["0-30 days", "0-30 days", "31-60 days", "31-60 days", "61-90 days", "61-90 days", "90+ days"]


def test_open_means_not_settled(spark):
    got = one(spark, [("Paid",), ("closed",), (None,), ("Open",)], "payment_status string", rules.is_open())
    assert [g[0] for g in got] == [False, False, True, True]


def test_receivable_age_defaults_to_45_days(spark):
    rows = [("Paid", date(2001, 1, 1), None), ("Paid", date(2001, 1, 1), date(2001, 1, 11)), ("Open", date(2001, 1, 1), None)]
    got = one(spark, rows, "payment_status string, invoice_date date, payment_date date", rules.receivable_age(F.lit(date(2001, 3, 1))))
    assert [g[0] for g in got] == [45, 10, 59]


def test_capped_change(spark):
    rows = [(Decimal("900"), Decimal("100")), (Decimal("110"), Decimal("100")), (Decimal("5"), Decimal("1")), (Decimal("5"), None), (Decimal("0"), Decimal("100"))]
    got = one(spark, rows, "c decimal(18,4), b decimal(18,4)", capped_change_pct(F.col("c"), F.col("b"), 100))
    assert [g[0] for g in got] == [500.0, 10.0, None, None, -100.0]


def test_ratio_and_weighted_mean_guard_zero(spark):
    df = spark.createDataFrame([(Decimal("0"), Decimal("0"))], "a decimal(18,4), b decimal(18,4)")
    assert df.select(ratio("a", "b")).first()[0] is None
    assert df.agg(weighted_mean("a", "b")).first()[0] is None


def test_rounding_is_half_up_in_decimal(spark):
    assert one(spark, [(2.675,), (0.125,), (-0.125,)], "v double", rounded(F.col("v"), 2)) == [(2.68,), (0.13,), (-0.13,)]


def test_bucket_is_stable(spark):
    a = one(spark, [(k,) for k in range(50)], "k long", bucket("k", 7))
    assert a == one(spark, [(str(k),) for k in range(50)], "k string", bucket("k", 7)) and {x[0] for x in a} <= set(range(7))


def test_employment_states(spark):
    rows = [(date(2000, 1, 1), None), (date(2000, 1, 1), date(2001, 1, 31)), (date(2001, 3, 1), None)]
    got = one(spark, rows, "hire_date date, termination_date date", rules.employment_status(F.lit(date(2001, 1, 31))), rules.in_force(F.lit(date(2001, 1, 31))))
    assert got == [("Active", True), ("Terminated", False), ("Pre-Hire", False)]


def test_periods_cross_year_and_leap_day(spark):
    p = Periods(date(2004, 1, 15))
    assert (p.month(1), p.month(13), p.month(-1), p.month_end(1), p.quarter(1), p.year_start()) == (
        date(2003, 12, 1), date(2002, 12, 1), date(2004, 2, 1), date(2003, 12, 31), date(2003, 10, 1), date(2004, 1, 1))
    assert one(spark, [(date(2004, 2, 10),), (date(2003, 2, 10),)], "d date", days_in_month("d")) == [(29,), (28,)]


def test_text_values_and_unit_shift(spark):
    rows = [(1234567890.0,), (730000.0,), (12.0,)]
    assert [r[0] for r in one(spark, rows, "v double", kpi_text.money_text(F.col("v")))] == ["$1.23B", "$730.00K", "$12"]
    texts = [("up $0.73B, down $0.04M",), ("$1.20B stays, $0.5K",), ("no amounts",)]
    assert [r[0] for r in one(spark, texts, "t string", kpi_text.shift_units(F.col("t")))] == ["up $730.00M, down $40.00K", "$1.20B stays, $500", "no amounts"]


def test_filters_ignore_blank_unknown_and_quotes(spark):
    df = spark.createDataFrame([("O'Hare", "a"), ("ASIA", "b")], "region string, location string")
    assert active_filters({"region": " All ", "location": "", "colour": "red", "customer": None}) == {}
    assert axis_filter(df, {"region": "O'Hare", "colour": "x"}).count() == 1
    assert axis_filter(df, {"industry": "none here"}).count() == 2
    snap = spark.createDataFrame([("ASIA", "c1"), ("EUROPE", "c2")], "region string, customer_name string")
    assert snapshot_filter(snap, {"customer": "c1"}).count() == 1
    assert snapshot_filter(snap, {"customer": "c1", "industry": "X"}).count() == 2


def test_slice_and_compound_key(spark):
    df = spark.createDataFrame([("All", "Paris", None), (None, None, "all"), ("ASIA", "Rome", "Tax")], "region string, location string, practice string")
    axis, value = slice_of({c: F.col(c) for c in ("region", "location", "practice")})
    assert [tuple(r) for r in df.select(axis, value).collect()] == [("location", "Paris"), ("firmwide", "all"), ("region", "ASIA")]
    keys = [r[0] for r in df.select(compound_key({c: F.col(c) for c in ("region", "location", "practice")})).collect()]
    assert keys == ["location=Paris", "practice=all", "location=Rome|practice=Tax|region=ASIA"]
