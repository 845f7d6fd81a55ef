"""Native columns against plain Python."""

import datetime as dt
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import ids, periods, text, values


def one(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_uuid5_and_digests(spark):
    names = ["", "abc", "é#ü", "https://x/y#z" * 20]
    got = one(spark, [(n,) for n in names], "n string", u=ids.uuid5(ids.GRAPH_NAMESPACE, F.col("n")), m=ids.md5_slug(F.col("n")), s=ids.sha_id(F.col("n")))
    for n, r in zip(names, got, strict=True):
        assert r.u == str(uuid.uuid5(ids.GRAPH_NAMESPACE, n)) and r.m == hashlib.md5(n.encode()).hexdigest()[:16] and r.s == hashlib.sha256(n.encode()).hexdigest()[:24]


def test_cik(spark):
    got = one(spark, [("320193",), ("0000320193",), ("LEI123",), (None,), ("12345678901",)], "c string", c=ids.normalize_cik(F.col("c")))
    assert [r.c for r in got] == ["0000320193", "0000320193", "LEI123", None, "12345678901"]


@pytest.mark.parametrize("days,kind", [(79, "other"), (80, "quarterly"), (100, "quarterly"), (101, "other"), (170, "semi_annual"), (190, "semi_annual"), (191, "other"), (260, "nine_months"), (281, "other"), (350, "annual"), (380, "annual"), (381, "other")])
def test_duration_buckets(spark, days, kind):
    start = dt.date(2023, 1, 1)
    r = one(spark, [(start, start + dt.timedelta(days - 1))], "s date, e date", k=periods.duration_type(F.col("s"), F.col("e")))[0]
    assert r.k == kind


def test_period_literals_round_trip(spark):
    rows = [("instant", None, dt.date(2024, 12, 31)), ("duration", dt.date(2024, 1, 1), dt.date(2024, 12, 31)), ("forever", None, None)]
    got = spark.createDataFrame(rows, "k string, s date, e date").withColumn("l", periods.format_interval(F.col("k"), F.col("s"), F.col("e"))).withColumn("p", periods.parse_interval(F.col("l"))).collect()
    assert got[0].l == "2025-01-01T00:00:00" and got[1].l == "2024-01-01T00:00:00/2025-01-01T00:00:00"
    assert [(r.p.period_type, r.p.start, r.p.end) for r in got] == rows
    bare = one(spark, [("2024-12-31",), ("2024-01-01/2024-12-31",), ("junk",), ("",), ("junk/2024-12-31",)], "l string", p=periods.parse_interval(F.col("l")))
    assert bare[0].p.end == dt.date(2024, 12, 31) and bare[1].p.end == dt.date(2024, 12, 31) and bare[2].p is bare[3].p is bare[4].p is None


def test_dates(spark):
    got = one(spark, [("2025-01-01T00:00:00",), ("2024-12-31",), ("1700-01-01",), ("x",)], "t string", d=periods.inclusive_date(F.col("t")))
    assert [r.d for r in got] == [dt.date(2024, 12, 31), dt.date(2024, 12, 31), None, None]
    got = one(spark, [("20240229", "--12-31"), ("2024", "1231"), (None, None)], "a string, b string", a=periods.edgar_date(F.col("a")), b=periods.fiscal_year_end(F.col("b")), m=periods.fiscal_month(F.col("b")))
    assert [(r.a, r.b, r.m) for r in got] == [(dt.date(2024, 2, 29), "1231", 12), (None, "1231", None), (None, None, None)]


def test_precision_and_tolerance(spark):
    got = one(spark, [("2",), ("-3",), ("INF",), (None,), ("x",)], "d string", p=values.precision(F.col("d")), t=values.tolerance(F.col("d")), w=values.whole_decimals(F.col("d")))
    inf = float("inf")
    assert [(r.p, r.t, r.w) for r in got] == [(2.0, 0.005, 2), (-3.0, 500.0, -3), (inf, 0.0, None), (-inf, 0.5, None), (-inf, 0.5, None)]
    got = one(spark, [("1.500",), ("100",), ("-0.0",), ("0.10",), ("abc",), ("1e3",)], "d string", c=values.canonical_number(F.col("d")))
    assert [r.c for r in got] == ["1.5", "100", "0", "0.1", None, "1000"]


def test_text_functions(spark):
    got = one(spark, [("a  b \n\n\n\n c ", "us-gaap:RevenuePolicyTextBlock", "Operating Lease, Liability")], "t string, q string, l string", t=text.normalize_whitespace(F.col("t")), q=text.label_from_name(F.col("q")), s=text.squash(F.col("l")), c=text.split_camel(F.lit("EPSBasicAndDiluted")))[0]
    assert (got.t, got.s, got.c) == ("a b\n\nc", "operatingleaseliability", "EPS Basic And Diluted") and got.q.startswith("Revenue Policy")
    got = one(spark, [("2.02, 9.01; 2.02", "8-K"), (None, "10-K")], "i string, f string", i=text.parse_items(F.col("i")), e=text.is_earnings_release(text.parse_items(F.col("i"))))
    assert [(list(r.i), r.e) for r in got] == [(["2.02", "9.01"], True), ([], False)]
    got = one(spark, [('{"@graph": []}',), ('{"documentInfo": 1, "facts": 2}',), ("{}",)], "j string", k=text.json_kind(F.col("j")))
    assert [r.k for r in got] == ["json-ld", "oim", None]
