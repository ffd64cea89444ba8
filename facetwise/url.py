"""Queries as URL query strings: read and written.

Keys (fixed values): d dimension values, ff field filters, srch keyword, po page, rpp page size, fs sorts, fsel fields,
gf groups, ul users, skipd skipped dimensions, _ir _id _iad _ied what to include, _ec _edc what not to count.
Aggregates have no key. Other keys are kept as extras.
"""

from __future__ import annotations

from urllib.parse import quote, unquote_plus

from .errors import QueryError
from .query import Comparer, Filter, GeoFilter, Query, Sort

FLAGS = {"_ir": "include_records", "_id": "include_dimensions", "_iad": "include_all_dimensions", "_ied": "include_empty_dimensions", "_ec": "exclude_count", "_edc": "exclude_dimension_count"}
_COMPARERS = {c.value.lower(): c for c in Comparer}


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(dict.fromkeys(int(x) for x in text.replace("+", " ").replace(",", " ").split() if x.lstrip("-").isdigit()))


def _escape(text: str) -> str:
    return quote(str(text), safe="")


def _filter(text: str) -> Filter | GeoFilter | None:
    parts = [unquote_plus(p) for p in text.split(",")]
    if len(parts) < 3 or parts[1].lower() not in _COMPARERS:
        return None
    comparer = _COMPARERS[parts[1].lower()]
    if len(parts) == 5:
        try:
            return GeoFilter(parts[0], comparer, *map(float, parts[2:]))
        except ValueError:
            return None
    return Filter(parts[0], comparer, parts[2]) if len(parts) == 3 else None


def parse(url: str) -> Query:
    """The query of a URL, or of the part after its question mark; what can't be read is left out."""
    q: dict = {}
    extras = []
    for pair in filter(None, url.rpartition("?")[2].split("&")):
        key, eq, raw = pair.partition("=")
        key, flag = unquote_plus(key), FLAGS.get(key.lower())
        k, text = key.lower(), unquote_plus(raw)
        if k == "d":
            q["dimension_values"] = _numbers(raw)
        elif k == "ff":
            q["filters"] = tuple(f for f in map(_filter, raw.split("|")) if f is not None)
        elif k == "srch":
            q["keyword"] = text
        elif k in ("po", "rpp"):
            if text.lstrip("-").isdigit():
                q["page" if k == "po" else "per_page"] = int(text)
        elif k == "fs":
            q["sorts"] = tuple(Sort(unquote_plus(n), d == "0") for n, _, d in (x.partition(",") for x in raw.split("|")) if n)
        elif k in ("fsel", "gf"):
            q["fields" if k == "fsel" else "groups"] = tuple(unquote_plus(x) for x in raw.split("|") if x)
        elif k in ("ul", "skipd"):
            q["users" if k == "ul" else "skip_dimensions"] = _numbers(raw)
        elif flag:
            q[flag] = text.lower() in ("1", "true")
        elif eq:
            extras.append((key, text))
    return Query(**q, extras=tuple(extras))


def _filter_text(f: Filter | GeoFilter) -> str:
    if isinstance(f, GeoFilter):
        return ",".join([_escape(f.name), f.comparer.value, *(repr(float(x)) for x in (f.lat, f.lon, f.miles))])
    if f.value is None:
        raise QueryError(f"{f.name}: a URL has no NULL")
    value = "^".join(map(str, f.value)) if isinstance(f.value, (list, tuple)) else str(f.value)
    return ",".join([_escape(f.name), f.comparer.value, _escape(value)])


def to_url(query: Query) -> str:
    """The query as a query string; parse() of it is the query again, with text for the filters' values."""
    default, out = Query(), []
    if query.dimension_values:
        out.append("d=" + "+".join(map(str, query.dimension_values)))
    if query.filters:
        out.append("ff=" + "|".join(map(_filter_text, query.filters)))
    if query.keyword:
        out.append("srch=" + _escape(query.keyword))
    if query.page != default.page:
        out.append(f"po={query.page}")
    if query.per_page != default.per_page:
        out.append(f"rpp={query.per_page}")
    if query.sorts:
        out.append("fs=" + "|".join(_escape(s.name) + ",0" * s.descending for s in query.sorts))
    for key, names in (("fsel", query.fields), ("gf", query.groups)):
        if names:
            out.append(f"{key}=" + "|".join(map(_escape, names)))
    for key, numbers in (("ul", query.users), ("skipd", query.skip_dimensions)):
        if numbers:
            out.append(f"{key}=" + ",".join(map(str, numbers)))
    out += [f"{key}={int(getattr(query, name))}" for key, name in FLAGS.items() if getattr(query, name) != getattr(default, name)]
    out += [f"{_escape(k)}={_escape(v)}" for k, v in query.extras]
    return "&".join(out)
