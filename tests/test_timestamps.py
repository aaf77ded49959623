from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from dispatchlake.operators.timestamps import fit_mixture, hypotheses, normalise_instants, readings

BERLIN = ZoneInfo("Europe/Berlin")


def us(*at, offset=0):
    return int(datetime(*at, tzinfo=timezone.utc).timestamp()) * 1_000_000 - offset * 60_000_000


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2026-01-03T10:13:02Z", us(2026, 1, 3, 10, 13, 2)),
        (" 2026-01-03t10:13:02z\n", us(2026, 1, 3, 10, 13, 2)),
        ("20260103T101302Z", us(2026, 1, 3, 10, 13, 2)),
        ("2026-01-03T10:13+05:30", us(2026, 1, 3, 10, 13, offset=330)),
        ("2026-01-03 10:13:02 UTC-5", us(2026, 1, 3, 10, 13, 2, offset=-300)),
        ("2026-01-03T10:13:02,1234567Z", us(2026, 1, 3, 10, 13, 2) + 123456),
        ("2026-01-03T10:13:02+01:00[Europe/Berlin]", us(2026, 1, 3, 9, 13, 2)),
        ("Sat, 03 Jan 2026 10:13:02 EST", us(2026, 1, 3, 15, 13, 2)),
        ("Thursday, 19-Feb-26 21:55:32 GMT", us(2026, 2, 19, 21, 55, 32)),
        ("Thu Apr  9 10:17:37 2026", us(2026, 4, 9, 8, 17, 37)),
        ("1767435182", 1767435182_000_000),
        ("1767435182123", 1767435182_123_000),
        ("1767435182.5", 1767435182_500_000),
        ("1er mars 2026 à 05h04", us(2026, 3, 1, 4, 4)),
        ("14 de marzo de 2026, 11:26", us(2026, 3, 14, 10, 26)),
        ("15. März 2026, 05:24 Uhr", us(2026, 3, 15, 4, 24)),
        ("2026年1月24日下午12:08", us(2026, 1, 24, 11, 8)),
        ("2026年1月24日上午12:08", us(2026, 1, 23, 23, 8)),
        ("January 11, 2026 12:19 a.m.", us(2026, 1, 10, 23, 19)),
        ("8 ноември 2025 г., 05:51", us(2025, 11, 8, 4, 51)),
    ],
)
def test_one_reading(value, want):
    assert readings(value, BERLIN) == {"sole": want}


@pytest.mark.parametrize("value", [None, "", "  ", "2026-01-03", "yesterday", "2 hours ago", "2026-02-30T10:00:00Z", "Tue, 41 Mar 2026 10:00:00 GMT", "2026-01-03T25:00:00Z", "2026-03-29 02:30:00", "2025-10-26 02:30:00", "x" * 5000])
def test_no_reading(value):
    assert readings(value, BERLIN) == {}


def test_zone_is_needed_only_without_offset():
    assert readings("2026-01-03 10:13:02", None) == {}
    assert readings("2026-01-03 10:13:02Z", None)


def test_numeric_dates_have_several_readings():
    assert set(readings("03/04/2026 10:00", BERLIN)) == {"dmy", "mdy"}
    assert set(readings("23/04/2026 10:00", BERLIN)) == {"dmy"}


def test_mixture_learns_the_order_of_a_source():
    fit = fit_mixture({"dmy:0|mdy:0": 10, "dmy:0": 40, "sole:0": 5}, None)
    assert fit["dmy:0|mdy:0"][0] == "dmy"
    assert fit["sole:0"][0] == "sole"


def test_mixture_leaves_what_stays_open():
    assert fit_mixture({"dmy:0|mdy:0": 10}, None)["dmy:0|mdy:0"][0] is None
    assert fit_mixture({"dmy:0": 3}, "mdy")["dmy:0"][0] is None


def test_values_overrule_a_wrong_registry():
    """Without the mixture the registry's order would be taken; a few damaged values don't overrule it."""
    fit = fit_mixture({"dmy:0": 300, "dmy:0|mdy:1": 90}, "mdy")
    assert fit["dmy:0"][0] == "dmy" and fit["dmy:0|mdy:1"][0] == "dmy"
    fit = fit_mixture({"dmy:0": 3, "mdy:1": 200, "dmy:0|mdy:1": 90, "dmy:0|mdy:3": 5}, "mdy")
    assert fit["dmy:0"][0] is None and fit["dmy:0|mdy:1"][0] == "mdy" == fit["dmy:0|mdy:3"][0]


def test_what_no_clock_showed():
    assert readings("0000-00-00 00:00:00", BERLIN) == {} and readings("x" * 100_000, BERLIN) == {}
    # Repeated by a clock change if the day comes first, plain if the month does: the order decides, not the gap.
    assert set(hypotheses("10/26/2025 02:30", BERLIN)) == {"mdy"} and hypotheses("10/26/2025 02:30", BERLIN)["mdy"][0] is None
    assert readings("2026-01-03 10:13:02" + " " * 200, None) == {} and readings(" " * 200 + "2026-01-03 10:13:02Z", None)


def test_records(spark):
    values = spark.createDataFrame(
        [(1, "a", "03/04/2026 10:00", 1775300000000000, "x"), (1, "a", "03/04/2026 10:00", 1775300000000000, "x"), (2, None, "03/04/2026 10:00", None, "x"), (3, "a", None, 1, "x"), (4, "b", "2026-01-03T10:13:02Z", 1, "x")],
        "rec_id long, source string, value string, fetched_us long, tz string",
    )
    src = spark.createDataFrame([("a", "Europe/Berlin", "mdy")], "id string, tz string, date_order string")
    got = {(r.rec_id, r.utc_us, r.canonical) for r in normalise_instants(values, src).collect()}
    assert got == {(1, us(2026, 3, 4, 9, 0), False), (2, None, False), (3, None, False), (4, us(2026, 1, 3, 10, 13, 2), True)}
    assert normalise_instants(values.limit(0), src).count() == 0
