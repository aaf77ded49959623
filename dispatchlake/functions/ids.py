"""Deterministic identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and the beginnings of others.
TRACKING_KEYS = (
    "fbclid gclid gbraid wbraid dclid msclkid ref ref_src ref_url source spm scm mc_cid mc_eid igshid yclid _hsenc _hsmi".split()
)
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_")

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalized_url(url: Column) -> Column:
    """One form of an address: small scheme and host, no default port, tracking parameters, fragment or closing slash, sorted query."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, _URL, 1))
    place = F.regexp_replace(F.regexp_extract(u, _URL, 2), "^.*@", "")
    host = F.lower(F.regexp_replace(place, r":\d*$", ""))
    port = F.regexp_extract(place, r":0*(\d+)$", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    raw = F.regexp_extract(u, _URL, 3)
    path = F.when(F.length(raw) > 1, F.regexp_replace(raw, "/+$", "")).otherwise(raw)
    pair = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v"))
    pairs = F.transform(F.filter(F.split(F.regexp_extract(u, _URL, 4), "&"), lambda p: p != ""), pair)
    tracks = lambda p: F.lower(p["k"]).isin(TRACKING_KEYS) | F.lower(p["k"]).rlike("^(?:%s)" % "|".join(TRACKING_PREFIXES))
    query = F.array_join(F.transform(F.array_sort(F.filter(pairs, lambda p: ~tracks(p))), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))).otherwise(""),
        F.when((host != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.lit("/")).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def content_fingerprint(title: Column, content: Column) -> Column:
    """sha256 of title and content with white space folded, in small letters; nulls count as empty."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, _SPACE, " "))), 256)


def item_id(url: Column, title: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(normalized_url(url), F.lit("\x1f"), content_fingerprint(title, content)), 256), 1, 32)


def cluster_id(first_item_id: Column) -> Column:
    return F.concat(F.lit("clt_"), F.substring(first_item_id, 1, 16))


def source_id(item: Column, fact_type: Column, field: Column, seq: Column | None = None) -> Column:
    """Parts joined by colons; a null sequence number is left out."""
    return F.concat_ws(":", item, fact_type, field, *([seq.cast("string")] if seq is not None else []))


def interest_key(interest: Column, tags: Column) -> Column:
    """int_ and twelve hex digits of the interest with its sorted tags."""
    low = F.array_sort(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower))
    return F.concat(F.lit("int_"), F.substring(F.sha2(F.concat(F.lower(F.trim(interest)), F.lit("|"), F.array_join(low, ",")), 256), 1, 12))


def archive_cluster_id(date: Column, url: Column, headline: Column) -> Column:
    seed = F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(headline)
    return F.concat(F.lit("arch_"), date, F.lit("_"), F.substring(F.sha1(seed), 1, 16))
