"""OData sources: requests for a VALUE expression, and their answers as long rows. The caller gives the function that
fetches, so nothing here needs a network."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.sexpr import Value

Fetch = Callable[[str, float], tuple[int, dict]]


class Busy(Exception):
    """Too many requests, or no answer in time."""


def trusted(url: str, hosts: Sequence[str]) -> bool:
    """Whether a url's host is one of hosts or below one."""
    host = urlsplit(url).hostname or ""
    return any(host == h or host.endswith("." + h) for h in hosts)


def v3_url(base: str, v: Value) -> str:
    """A typed data set: codes by substringof in OR groups, dimensions joined by AND, columns selected."""
    groups = [" or ".join(f"substringof('{c}',{g})" for c in codes) for g, codes in v.dims if codes]
    where = " and ".join(f"({g})" for g in groups)
    columns = ",".join([*v.groups, *v.measures])
    return f"{base}/{v.table}/TypedDataSet?" + (f"$filter={quote(where)}&" if where else "") + f"$select={quote(columns, safe=',')}"


def v4_url(base: str, v: Value) -> str:
    """Observations: measure and codes by in lists."""
    listed = lambda codes: "(" + ",".join(f"'{c}'" for c in codes) + ")"
    where = " and ".join([f"Measure in {listed(v.measures)}", *(f"{g} in {listed(c)}" for g, c in v.dims if c)])
    return f"{base}/{v.table}/Observations?$filter={quote(where)}"


def get(url: str, fetch: Fetch, hosts: Sequence[str], tries: int = 9, wait: float = 3.0, timeout: float = 8.0) -> dict | None:
    """A page; None for other states than 200. Busy servers are asked again, `tries` times at most."""
    if not trusted(url, hosts):
        raise PermissionError(f"not a trusted host: {url}")
    for _ in range(tries):
        try:
            status, page = fetch(url, timeout)
        except (Busy, TimeoutError):
            time.sleep(wait)
            continue
        if status == 429:
            time.sleep(wait)
            continue
        return page if status == 200 else None
    raise Busy(url)


def rows(url: str, fetch: Fetch, hosts: Sequence[str], **given) -> list[dict]:
    """The rows of all pages."""
    out: list[dict] = []
    seen = set()
    while url and url not in seen:
        seen.add(url)
        page = get(url, fetch, hosts, **given)
        if page is None:
            break
        out += page.get("value", [])
        url = page.get("@odata.nextLink") or page.get("odata.nextLink") or ""
    return out


def long_rows(spark: SparkSession, v: Value, got: list[dict]) -> DataFrame:
    """(*dims, Measure, Value) of either form's rows. Rows of wide ones that hold a code only as part of another are left
    out, which substringof lets through."""
    out = []
    for r in got:
        if any(c and str(r.get(g)).strip() not in {x.strip() for x in c} for g, c in v.dims):
            continue
        dims = [r.get(g) for g in v.groups]
        cells = {r["Measure"]: r.get("Value")} if "Measure" in r else {m: r.get(m) for m in v.measures}
        out += [(*dims, m, float(x)) for m, x in cells.items() if m in v.measures and x is not None]
    schema = ", ".join([*(f"`{g}` string" for g in v.groups), "Measure string", "Value double"])
    return spark.createDataFrame(out, schema)


def code_parts(code: str) -> tuple[str, str, str]:
    """(year, kind, number) of a period code: kind JJ (year), KW (quarter) or MM (month)."""
    m = re.fullmatch(r"(\d{4})(JJ|KW|MM)(\d{2})", code)
    if not m:
        raise ValueError(f"not a period: {code}")
    return m[1], m[2], m[3]
