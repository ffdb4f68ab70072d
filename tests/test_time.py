"""Wall clocks, calendars, codes and publication rules on hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knownwhen.functions import calendar as C
from knownwhen.functions import numeric as N
from knownwhen.functions import text as X
from knownwhen.functions import timeaxis as T
from knownwhen.operators import grid as G
from knownwhen.plans import publication as U

TZ = "Europe/Zurich"
D = dt.datetime.fromisoformat


def one(df, col):
    return df.select(col.alias("v")).first().v


@pytest.mark.parametrize("wall,policy,expected", [
    ("2025-10-26 02:30", dict(ambiguous="first"), "2025-10-26 00:30"),
    ("2025-10-26 02:30", dict(ambiguous="second"), "2025-10-26 01:30"),
    ("2025-10-26 02:30", dict(ambiguous="null"), None),
    ("2025-10-26 03:30", dict(ambiguous="second"), "2025-10-26 02:30"),
    ("2025-10-26 01:30", dict(ambiguous="second"), "2025-10-25 23:30"),
    ("2025-03-30 02:30", dict(nonexistent="shift"), "2025-03-30 01:30"),
    ("2025-03-30 02:30", dict(nonexistent="gap_end"), "2025-03-30 01:00"),
    ("2025-03-30 02:30", dict(nonexistent="null"), None),
    ("2025-07-01 12:00", {}, "2025-07-01 10:00"),
])
def test_local_to_utc(frame, wall, policy, expected):
    got = one(frame([(wall,)], "w timestamp_ntz"), T.local_to_utc("w", TZ, **policy))
    assert got == (None if expected is None else D(expected))


def test_switch_days_have_92_and_100_quarter_hours(spark):
    rows = G.expected_rows(spark, "2025-03-28 23:00:00", "2025-10-27 23:00:00", "15 minutes", TZ, "day").collect()
    n = {r.day.date().isoformat(): r.expected for r in rows}
    assert (n["2025-03-30"], n["2025-10-26"], n["2025-06-01"]) == (92, 100, 96)


def test_four_hour_blocks_last_three_and_five_hours(spark):
    for day, hours in (("2025-03-29 23:00:00", 3), ("2025-10-25 22:00:00", 5)):
        g = G.grid(spark, day, str(D(day) + dt.timedelta(hours=6)), "15 minutes")
        first = g.groupBy(T.local_bucket("ts_utc", TZ, 4).alias("b")).count().orderBy("b").first()
        assert first["count"] == hours * 4


def test_upsample_repeat_and_split(frame):
    df = frame([("s", "2025-01-01 10:00", 8.0), ("s", "2025-01-01 11:00", 8.0)], "k string, ts timestamp_ntz, v double")
    rep = G.upsample(df, ["k"], "ts", ["v"], "15 minutes").collect()
    assert len(rep) == 8 and {r.v for r in rep} == {8.0} and max(r.ts for r in rep) == D("2025-01-01 11:45")
    assert {r.v for r in G.upsample(df, ["k"], "ts", ["v"], "15 minutes", "split").collect()} == {2.0}
    more = df.union(frame([("s", "2025-01-01 11:15", 3.0)], "k string, ts timestamp_ntz, v double"))
    got = {r.ts: r.v for r in G.upsample(more, ["k"], "ts", ["v"], "15 minutes", "split").collect()}
    assert got[D("2025-01-01 11:00")] == 8.0 and got[D("2025-01-01 12:00")] == 0.75 and D("2025-01-01 12:15") not in got


def test_easter_and_holidays(frame):
    df = frame([(2024,), (2025,), (2038,)], "y int")
    assert [r.v for r in df.select(C.easter("y").alias("v")).collect()] == [dt.date(2024, 3, 31), dt.date(2025, 4, 20), dt.date(2038, 4, 25)]
    days = frame([("2025-05-29",), ("2025-05-30",), ("2025-05-28",), ("2025-08-01",)], "d date")
    flags = {r.d.isoformat(): r for r in days.withColumns(C.day_flags("d")).collect()}
    assert flags["2025-05-29"].holiday and flags["2025-05-30"].bridge_day and flags["2025-05-28"].day_before_holiday and flags["2025-08-01"].holiday


def test_iso_week_53_falls_back(frame):
    df = frame([(2020, 53, 0), (2021, 53, 0), (2026, 1, 0)], "y int, w int, d int")
    got = [r.v for r in df.select(C.iso_week_date(F.col("y"), F.col("w"), F.col("d")).alias("v")).collect()]
    assert got == [dt.date(2020, 12, 28), dt.date(2021, 12, 27), dt.date(2025, 12, 29)]


@pytest.mark.parametrize("code,day,start,end", [
    ("7", "2025-06-01", "2025-06-01 04:00", "2025-06-01 05:00"),
    ("3A", "2025-10-26", "2025-10-26 00:00", "2025-10-26 01:00"),
    ("3B", "2025-10-26", "2025-10-26 01:00", "2025-10-26 02:00"),
    ("14qh2", "2025-01-10", "2025-01-10 12:15", "2025-01-10 12:30"),
    ("20hh1", "2025-01-10", "2025-01-10 18:00", "2025-01-10 18:30"),
    ("POS_04_08", "2025-01-10", "2025-01-10 03:00", "2025-01-10 07:00"),
    ("00:00 bis 04:00", "2025-03-30", "2025-03-29 23:00", "2025-03-30 02:00"),
])
def test_delivery_window(frame, code, day, start, end):
    df = frame([(code, day)], "c string, d timestamp_ntz")
    w = X.delivery_window("c", "d", TZ)
    r = df.select(w["start"].alias("s"), w["end"].alias("e")).first()
    assert (r.s, r.e) == (D(start), D(end))


def test_delivery_day(frame):
    df = frame([("TRL_25_03_09_x",), ("PRL_19_KW27",), ("none",)], "c string")
    got = [r.v for r in df.select(X.delivery_day("c").alias("v")).collect()]
    assert got == [dt.date(2025, 3, 9), dt.date(2019, 7, 1), None]


def test_names_and_numbers(frame):
    p = X.grammar(["ch", "de", "it_nord"], ["mw", "eur_mwh"])
    assert X.check_names(["ch_load_mw", "ch_de_flow_mw", "flag_x", "ts_utc", "load_mw", "ch_price_eur_mwh_xchk_ec"], p) == ["load_mw"]
    assert X.parse_name("ch_de_flow_mw", p) == {"class": "data", "area": "ch_de", "variable": "flow", "unit": "mw"}
    assert X.snake(["Größe (MW)", "Größe MW", "a"]) == ["groesse_mw", "groesse_mw_2", "a"]
    df = frame([("1.234,5",), ("n/a",), ("x1",)], "c string")
    assert [r.v for r in df.select(X.number("c", decimal=",", thousands=".").alias("v")).collect()] == [1234.5, None, None]


def test_gate_closure_by_weekday(frame):
    gates = {"w": U.Gate("week", {None: (6, "13:00")}, "week", "2025-01-01"), "d": U.Gate("table", {0: (3, "14:30"), 1: (4, "15:30")})}
    df = frame([("w", "2025-06-01 22:00"), ("d", "2025-06-01 22:00"), ("d", "2025-06-02 22:00"), ("x", "2025-06-02 22:00")], "p string, b timestamp_ntz")
    got = [(r.gate_closure_utc, r.gate_confidence) for r in U.gate_closure(df, "b", gates, "p", TZ).collect()]
    assert got == [(D("2025-05-27 11:00"), "calendar"), (D("2025-05-30 12:30"), "assumed"), (D("2025-05-30 13:30"), "assumed"), (None, None)]


def test_vwmean_and_close(frame):
    df = frame([(10.0, 1.0), (20.0, None), (None, 5.0)], "p double, v double")
    assert df.agg(N.vwmean("p", "v").alias("x")).first().x == 10.0
    zero = frame([(10.0, 0.0)], "p double, v double")
    assert zero.agg(N.vwmean("p", "v").alias("x")).first().x is None
    nan = frame([(float("nan"),), (1.0,)], "x double")
    assert [r.v for r in nan.select(N.nan_to_null("x").alias("v")).collect()] == [None, 1.0]


def test_normal_p_values(frame):
    import math

    df = frame([(0.0,), (1.96,), (-3.1,)], "z double")
    for r in df.select("z", N.normal_two_sided("z").alias("p")).collect():
        assert abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 2e-7
