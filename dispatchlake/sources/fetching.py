"""Polling addresses behind a small protocol; the network itself is given by the caller."""

from __future__ import annotations

import ipaddress
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (url, etag, last_modified) -> (status, body, etag, last_modified)
Fetcher = Callable[[str, str | None, str | None], tuple[int, str | None, str | None, str | None]]
RETRIED = frozenset({429, 500, 502, 503, 504})
OUT = "source string, url string, status int, body string, etag string, last_modified string, not_modified boolean, error string"


def refused(url: str, resolve: Callable[[str], list[str]] | None = None) -> str | None:
    """Why an address must not be asked: its scheme, or a host that is or resolves to one inside."""
    try:
        p = urlsplit(url)
        host = p.hostname
    except ValueError:
        return "not an address"
    if p.scheme not in ("http", "https"):
        return "scheme"
    if not host or host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return "host"
    try:
        found = [host] if ipaddress.ip_address(host) else []
    except ValueError:
        found = resolve(host) if resolve else []
    return "inside address" if any(not ipaddress.ip_address(a).is_global for a in found) else None


def poll(requests: DataFrame, fetcher: Fetcher, tries: int = 3, wait: float = 0.5, resolve: Callable[[str], list[str]] | None = None) -> DataFrame:
    """One row for each request (source, url, etag, last_modified). A host's requests go one after another, in one place.

    429 and 5xx are tried again with doubled waits; 304 is no change; a failure is a row with ``error``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for source, url, etag, modified in zip(f["source"], f["url"], f["etag"], f["last_modified"]):
                if why := refused(url or "", resolve):
                    rows.append((source, url, None, None, etag, modified, False, f"refused: {why}"))
                    continue
                for n in range(tries):
                    try:
                        status, body, tag, mod = fetcher(url, etag, modified)
                        error = None if status < 400 else f"status {status}"
                    except Exception as e:  # one address must not stop the others
                        status, body, tag, mod, error = None, None, None, None, f"{type(e).__name__}: {e}"
                    if status not in RETRIED or n == tries - 1:
                        break
                    time.sleep(wait * 2**n)
                rows.append((source, url, status, body if error is None else None, tag or etag, mod or modified, status == 304, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"status": "Int32"})

    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    return requests.select("source", "url", "etag", "last_modified").repartition(host).mapInPandas(run, OUT)
