"""Time stamps of many formats and zones, brought to UTC instants.

Every value is parsed under each reading that fits its text; the readings of one source form a mixture whose
weights are found by expectation-maximisation. A value counts towards the readings that are possible for it,
weighted by how plausible the resulting lag to the fetch time is; the posterior then chooses a reading or marks
the value as unresolved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.tables import table

# Month names of the languages that occur, by month.
MONTHS = {
    1: "january jan januar jän janvier janv enero ene януари яну",
    2: "february feb februar février févr fevrier febrero февруари фев",
    3: "march mar märz mär maerz mars marzo март мар",
    4: "april apr avril avr abril abr април апр",
    5: "may mai mayo май",
    6: "june jun juni juin junio юни",
    7: "july jul juli juillet juil julio юли",
    8: "august aug août aout agosto ago август авг",
    9: "september sep sept septembre septiembre setiembre септември сеп",
    10: "october oct oktober okt octobre octubre октомври окт",
    11: "november nov novembre noviembre ноември ное",
    12: "december dec dezember dez décembre déc decembre diciembre dic декември дек",
}
MONTH = {name: n for n, names in MONTHS.items() for name in names.split()}

# Named offsets in minutes.
OFFSETS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "jst": 540, "kst": 540, "aest": 600, "aedt": 660,
    "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "sast": 120, "hkt": 480, "sgt": 480,
}

_CLOCK = r"(?P<H>\d{1,2})[:hH](?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
_HALF = r"(?:\s*(?P<half>[ap])\.?m\.?)?"
_OFF = r"(?:\s*(?P<off>(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})(?:\s*\[[\w/+-]+\])?)?"
_WORD = r"[^\W\d_]+"

_SHAPES = [
    (name, re.compile(pattern + r"\Z", re.IGNORECASE))
    for name, pattern in (
        ("iso", rf"(?P<Y>\d{{4}})[-/](?P<m>\d{{1,2}})[-/](?P<d>\d{{1,2}})(?:[t ]\s*|\s+){_CLOCK}{_HALF}{_OFF}"),
        ("compact", r"(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})t(?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?" + _OFF),
        ("epoch", r"(?P<e>\d{9,17})(?:\.(?P<ef>\d+))?"),
        ("numeric", rf"(?P<a>\d{{1,2}})[/.-](?P<b>\d{{1,2}})[/.-](?P<c>\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_HALF}{_OFF}"),
        ("cjk", r"(?P<Y>\d{4})年\s*(?P<m>\d{1,2})月\s*(?P<d>\d{1,2})日\s*(?P<cj>上午|下午|凌晨|晚上|中午)?\s*(?P<H>\d{1,2})[:：时](?P<M>\d{2})分?(?:[:：]?(?P<S>\d{2})秒?)?" + _OFF),
        ("worded", rf"(?:{_WORD}\.?,\s*)?(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?(?:\s+|-)(?:de\s+)?(?P<mon>{_WORD})\.?(?:\s+|-)(?:de\s+)?(?P<Y>\d{{4}}|\d{{2}})(?:\s*г\.)?(?:,|\s+à|\s+um|\s+at|\s+a las)?\s+{_CLOCK}(?:\s*uhr)?{_HALF}{_OFF}"),
        ("american", rf"(?:{_WORD}\.?,\s*)?(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<Y>\d{{4}}),?(?:\s+at)?\s+{_CLOCK}{_HALF}{_OFF}"),
        ("asctime", rf"{_WORD}\s+(?P<mon>{_WORD})\s+(?P<d>\d{{1,2}})\s+(?P<H>\d{{1,2}}):(?P<M>\d{{2}}):(?P<S>\d{{2}})(?:\s+(?P<off>utc|gmt))?\s+(?P<Y>\d{{4}})"),
    )
]
_CANONICAL = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\Z", re.ASCII)
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_MICRO = timedelta(microseconds=1)

#: Weight of a reading by how long before the fetch it lies: under 3 days, 45 days, 2 years, more, in the future.
LAG_WEIGHT = (1.0, 0.3, 0.05, 0.005, 0.001)
CERTAIN = 0.95
#: Values that the registry's order of dates counts as, and the share of them that each other order gets.
PRIOR, DOUBT = 50.0, 1e-5
#: Share of a source's all-numeric dates that are damaged, so that what they can only be read as means nothing.
DAMAGED = 0.02
#: A source writes mostly one order: the counts are raised to this power before they are weights.
SHARPEN = 2
READINGS = ("sole", "dmy", "mdy", "ymd")


@lru_cache(maxsize=512)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:  # an unknown zone leaves the value without one
        return None


def _offset(text: str | None) -> int | None:
    """Minutes east of UTC, or None for what is no offset."""
    if (known := OFFSETS.get(text.lower())) is not None:
        return known
    if not (m := re.match(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?\Z", text, re.IGNORECASE)):
        return None
    hours, minutes = int(m[2]), int(m[3] or 0)
    return None if hours > 18 or minutes > 59 else (hours * 60 + minutes) * (-1 if m[1] == "-" else 1)


def _naive(y: int, mo: int, d: int, h: int, mi: int, s: int, us: int) -> int | None:
    """As if it were UTC; None for an impossible date or time."""
    try:
        return (datetime(y, mo, d, h, mi, s, us, tzinfo=UTC) - _EPOCH) // _MICRO
    except ValueError:
        return None


def _instant(y: int, mo: int, d: int, h: int, mi: int, s: int, us: int, off: int | None, zone: ZoneInfo | None) -> int | None:
    """Microseconds since 1970 UTC; None for an impossible, repeated or skipped local time and where the zone is unknown."""
    try:
        at = datetime(y, mo, d, h, mi, s, us)
    except ValueError:
        return None
    if off is not None:
        return (at.replace(tzinfo=UTC) - _EPOCH) // _MICRO - off * 60_000_000
    if zone is None:
        return None
    first, second = at.replace(tzinfo=zone).utcoffset(), at.replace(tzinfo=zone, fold=1).utcoffset()
    return None if first != second else (at.replace(tzinfo=UTC) - _EPOCH - first) // _MICRO


def readings(value: str | None, zone: ZoneInfo | None) -> dict[str, int]:
    """Every reading of ``value`` that has an instant: {"sole": us}, or some of dmy, mdy, ymd for all-numeric dates."""
    return {k: us for k, (us, _) in hypotheses(value, zone).items() if us is not None}


def hypotheses(value: str | None, zone: ZoneInfo | None) -> dict[str, tuple[int | None, int]]:
    """Every way to read ``value`` with its instant, None where the local time has none or two, and roughly when it was."""
    if value is None or not (text := value.strip()):
        return {}
    for name, shape in _SHAPES:
        if not (m := shape.match(text)):
            continue
        g = m.groupdict()
        if name == "epoch":
            digits = len(g["e"])
            scale = 1_000_000 if digits <= 11 else 1000 if digits <= 14 else 1
            cut = int((g["ef"] or "0").ljust(6, "0")[:6]) * scale // 1_000_000
            at = int(g["e"]) * scale + cut
            return {"sole": (at, at)}
        h, mi, s = int(g["H"]), int(g["M"]), int(g.get("S") or 0)
        us = int((g.get("f") or "0").ljust(6, "0")[:6])
        if half := g.get("half"):
            if not 1 <= h <= 12:
                return {}
            h = h % 12 + 12 * (half in "pP")
        if cj := g.get("cj"):
            if h <= 12:
                h = h % 12 + 12 * (cj in ("下午", "晚上") or cj == "中午" and h in (12, 1, 2))
        off = None
        if g.get("off") and (off := _offset(g["off"])) is None:
            return {}
        if name == "numeric":
            a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
            year = c if c > 99 else 2000 + c
            dates = {"dmy": (year, b, a), "mdy": (year, a, b)} | ({"ymd": (2000 + a, b, c)} if c <= 31 else {})
        else:
            month = int(g["m"]) if g.get("m") else MONTH.get(g["mon"].lower())
            year = int(g["Y"])
            dates = {"sole": (year if year > 99 else 2000 + year, month, int(g["d"]))} if month else {}
        about = {k: _naive(*at, h, mi, s, us) for k, at in dates.items()}
        return {k: (_instant(*at, h, mi, s, us, off, zone), about[k]) for k, at in dates.items() if about[k] is not None}
    return {}


def _lag(us: int, fetched: float) -> int:
    days = (fetched - us) / 86_400e6
    return 2 if days != days else 4 if days < -1 else int(np.searchsorted((3, 45, 730), days))


def _signature(ways: dict[str, tuple[int | None, int]], fetched: float) -> str:
    """The possible readings with the class of their lag; a bounded number of different strings."""
    return "|".join(f"{k}:{_lag(about if us is None else us, fetched)}" for k, (us, about) in sorted(ways.items()))


def _read(batches: Iterator[pd.DataFrame], full: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        fetched = b["fetched_us"].astype("float64").to_numpy()
        found = [hypotheses(v, _zone(z)) for v, z in zip(b["value"], b["tz"])]
        out = pd.DataFrame({"source": b["source"], "signature": [_signature(f, t) for f, t in zip(found, fetched)]})
        if full:
            out["rec_id"] = b["rec_id"]
            out["canonical"] = [bool(_CANONICAL.match(v.strip())) if v else False for v in b["value"]]
            for k in READINGS:
                out[k] = pd.array([f[k][0] if k in f else None for f in found], dtype="Int64")
        else:
            out["date_order"] = b["date_order"]
        yield out


def fit_mixture(counts: dict[str, float], declared: str | None, rounds: int = 30) -> dict[str, tuple[str | None, float]]:
    """EM over one source's signatures: for each the chosen reading (None: unresolved) and its posterior.

    ``declared`` is the order the source is said to write its numeric dates in: a prior of PRIOR values, nearly all of
    them in that order. It settles what the values leave open and gives way where enough of them can only be read in
    another order. A reading whose local time has no single instant takes part like any other; chosen, it stays unresolved.
    """
    parsed = {s: [(k, int(c)) for k, c in (x.split(":") for x in s.split("|"))] for s in counts if s}
    numeric = READINGS[1:]
    prior = {k: PRIOR * (1 - 2 * DOUBT if k == declared else DOUBT) if declared in numeric else 1.0 for k in numeric}

    def weights(total: dict[str, float]) -> dict[str, float]:
        z = sum(n**SHARPEN for n in total.values())
        return {"sole": 1.0} | {k: n**SHARPEN / z for k, n in total.items()}

    # The first guess counts the values that can be read in one order only.
    weight = weights({k: n + sum(c for s, c in counts.items() if [k] == [o for o, _ in parsed.get(s, ())]) for k, n in prior.items()})

    def likelihoods(cs: list[tuple[str, int]]) -> dict[str, float]:
        lik = {k: weight[k] * LAG_WEIGHT[c] for k, c in cs}
        # A value that the source's own order can't explain may be damaged instead.
        return lik if "sole" in lik else lik | {"": DAMAGED * max(LAG_WEIGHT[c] for _, c in cs) * (1 - max(weight[k] for k, _ in cs))}

    for _ in range(rounds):
        total = dict(prior)
        for s, cs in parsed.items():
            lik = likelihoods(cs)
            z = sum(lik.values())
            for k in numeric:
                if k in lik and z:
                    total[k] += counts[s] * lik[k] / z
        new = weights(total)
        if max(abs(new[k] - weight[k]) for k in READINGS) < 1e-9:
            break
        weight = new
    out: dict[str, tuple[str | None, float]] = {}
    for s, cs in parsed.items():
        lik = likelihoods(cs)
        z, best = sum(lik.values()), max(lik, key=lambda k: (lik[k], k))
        p = lik[best] / z if z else 0.0
        out[s] = (best if best and p >= CERTAIN else None, p)
    return out


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    order = rows["date_order"].dropna()
    fit = fit_mixture(dict(zip(rows["signature"], rows["n"])), order.iloc[0] if len(order) else None)
    source = rows["source"].iloc[0]
    return pd.DataFrame([(source, s, r, p) for s, (r, p) in fit.items()], columns=["source", "signature", "reading", "posterior"])


def normalise_instants(values: DataFrame, sources: DataFrame) -> DataFrame:
    """UTC instants of ``values`` (rec_id, source, value, fetched_us; other columns are ignored).

    ``sources`` has id, tz and date_order, where a null order is estimated. Result: rec_id, canonical (already in the plain UTC form), utc_us, reading,
    posterior; one row per distinct record and reading. Null, blank and unusable values, local times that are skipped
    or repeated by a clock change, and values whose readings stay undecided have a null utc_us. A null or unknown
    source has no zone; its values resolve only where they carry one. Empty input gives no rows.
    """
    known = sources.select(F.col("id").alias("source"), "tz", "date_order").dropDuplicates(["source"])
    rows = values.select("rec_id", F.coalesce("source", F.lit("")).alias("source"), "value", "fetched_us").join(known, "source", "left")
    counts = (
        rows.mapInPandas(lambda b: _read(b, False), "source string, signature string, date_order string")
        .where("signature <> ''")
        .groupBy("source", "signature")
        .agg(F.count("*").alias("n"), F.first("date_order", True).alias("date_order"))
    )
    chosen = counts.groupBy("source").applyInPandas(_fit, "source string, signature string, reading string, posterior double")
    full = rows.mapInPandas(
        lambda b: _read(b, True),
        "source string, signature string, rec_id long, canonical boolean, sole long, dmy long, mdy long, ymd long",
    )
    pick = F.coalesce(*[F.when(F.col("reading") == k, F.col(k)) for k in READINGS])
    return (
        full.join(chosen, ["source", "signature"], "left")
        .select("rec_id", "canonical", pick.alias("utc_us"), "reading", "posterior")
        .distinct()
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found of TESTDATA.md."""
    src = table(spark, sf_dir, "sources")
    us = F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us")
    raw = table(spark, sf_dir, "raw_items").select(F.col("raw_id").alias("rec_id"), "source", F.col("published_at").alias("value"), us)
    # A header without zone is GMT whatever the source, known or not.
    responses = table(spark, sf_dir, "fetch_responses").select(F.col("resp_id").alias("rec_id"), F.coalesce("source", F.lit("")).alias("source"), F.col("last_modified").alias("value"), us)
    res, http = responses, responses.select(F.col("source").alias("id"), F.lit("UTC").alias("tz"), F.lit(None).cast("string").alias("date_order")).distinct()
    parts = [("published_at", normalise_instants(raw, src)), ("last_modified", normalise_instants(res, http))]
    out = [d.where("utc_us is not null and not canonical").select(F.lit(f).alias("field"), "rec_id", "utc_us") for f, d in parts]
    return out[0].unionByName(out[1])
