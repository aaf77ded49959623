"""Times and ages as Column expressions; the present is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_hours(at: Column, now: Column, missing: float | None = None) -> Column:
    """Hours from ``at`` to ``now``; null counts as ``missing`` (inf for the ranking rule, 0 for the quota rule)."""
    age = (F.unix_micros(now) - F.unix_micros(at)) / 3.6e9
    return age if missing is None else F.coalesce(age, F.lit(missing))


def fresh_or_undated(at: Column, now: Column, hours: Column) -> Column:
    return at.isNull() | (age_hours(at, now) <= hours)


def fresh_and_dated(at: Column, now: Column, hours: Column) -> Column:
    return F.coalesce(age_hours(at, now) <= hours, F.lit(False))


def logical_date(run_id: Column, at: Column, zone: str) -> Column:
    """The date a run id ends with, else the local date of ``at``."""
    d = F.regexp_extract(F.coalesce(run_id, F.lit("")), r"_(\d{8})$", 1)
    run = F.date_format(F.try_to_timestamp(d, F.lit("yyyyMMdd")), "yyyy-MM-dd")
    return F.coalesce(F.when(d != "", run), F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd"))


def parse_iso(text: Column) -> Column:
    """ISO time with Z or offset; null for anything else."""
    return F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))


def stale_material(peak: Column, last_date: Column, zone: str) -> Column:
    """Whether the newest report is from before the local midnight of the last day it was shown."""
    return peak < F.to_utc_timestamp(F.to_timestamp(last_date, "yyyy-MM-dd"), zone)


def daily_rate(value: Column, since: Column, now: Column) -> Column:
    """Value for each day of age, a day at least; 0 without a date."""
    return F.coalesce(value / F.greatest(age_hours(since, now) / 24, F.lit(1.0)), F.lit(0.0))
