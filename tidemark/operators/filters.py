"""Filter trees, projections, sorting and pages as column expressions."""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets
import time
from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import overlaps
from tidemark.plans.context import QueryError

MAX_DEPTH, MAX_TESTS = 32, 256


def compile_filter(tree) -> Column:
    """("all" | "any", ...), ("not", x), ("match_all",) or a test -> a column that is never null: what is absent satisfies nothing.

    Tests: ("is", field, value), ("in", field, values), ("range", field, low, high, low_open, high_open),
    ("exists", field), ("overlaps", start, end, window_start, window_end), ("instant_within", field, window_start, window_end),
    ("equals", kind field, field, kind, value).  A span that has no start or end is open there.
    """
    tests = 0

    def walk(node, depth: int) -> Column:
        nonlocal tests
        if depth > MAX_DEPTH:
            raise QueryError("the filter is too deep")
        kind, *rest = node
        if kind == "match_all":
            return F.lit(True)
        if kind in ("all", "any"):
            parts = [walk(x, depth + 1) for x in dict.fromkeys(rest)]
            if not parts:
                raise QueryError("all and any have parts")
            out = parts[0]
            for p in parts[1:]:
                out = out & p if kind == "all" else out | p
            return out
        if kind == "not":
            return ~walk(rest[0], depth + 1)
        tests += 1
        if tests > MAX_TESTS:
            raise QueryError("the filter has too many tests")
        if kind == "is":
            leaf = F.col(rest[0]) == rest[1]
        elif kind == "in":
            leaf = F.col(rest[0]).isin(list(rest[1]))
        elif kind == "exists":
            leaf = F.col(rest[0]).isNotNull()
        elif kind == "range":
            field, low, high, *open_ = rest
            if low is None and high is None:
                raise QueryError("a range has a bound")
            low_open, high_open = [*open_, False, False][:2]
            leaf = F.lit(True)
            if low is not None:
                leaf = leaf & (F.col(field) > low if low_open else F.col(field) >= low)
            if high is not None:
                leaf = leaf & (F.col(field) < high if high_open else F.col(field) <= high)
        elif kind == "overlaps":
            start, end, a, b = rest
            leaf = overlaps(start, end, a, b)
        elif kind == "instant_within":  # an instant overlaps a window that holds it
            field, a, b = rest
            leaf = (F.col(field) >= a) & (F.col(field) < b)
        elif kind == "equals":  # of the same kind, and the same canonical form
            kind_field, field, value_kind, value = rest
            leaf = (F.col(kind_field) == value_kind) & (F.col(field) == value)
        else:
            raise QueryError(f"unknown test {kind}")
        return F.coalesce(leaf, F.lit(False))

    return walk(tree, 1)


def among(rows: DataFrame, key: str, refs: DataFrame) -> DataFrame:
    """Rows whose key a table of references names; the table may be of any size."""
    return rows.join(refs.select(F.col(refs.columns[0]).alias(key)).distinct(), key, "left_semi")


def calendar_window(anchor: str, years: int = 0, months: int = 0, days: int = 0) -> tuple[int, int]:
    """Days since 1970 of the window between an explicit anchor date and its calendar shift, in order; never "now"."""
    day = date.fromisoformat(anchor)

    def moved(d: date, n: int) -> date:
        y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
        return date(y, m + 1, min(d.day, monthrange(y, m + 1)[1]))

    other = moved(moved(day, 12 * years), months) + timedelta(days=days)
    if other == day:
        raise QueryError("the window is empty")
    first, last = sorted(((d - date(1970, 1, 1)).days for d in (day, other)))
    return first, last


#: Fields that results of an operation can be sorted by.
SORTABLE = {
    "raw_history": ("tag", "id", "revision"),
    "resolution": ("subject_id", "predicate_id", "outcome"),
    "candidates": ("assertion_id", "subject_id", "predicate_id", "revision", "valid_start", "valid_end"),
    "events": ("event_id", "kind", "start_us", "end_us", "revision"),
    "search": ("result_key",),
}


def check_sort(operation: str, terms: list[tuple[str, str, str]]) -> None:
    """Refuses sort terms that the results of an operation don't have."""
    if operation not in SORTABLE or any(f not in SORTABLE[operation] for f, _, _ in terms):
        raise QueryError(f"{operation} can't be sorted by that")


def project(rows: DataFrame, fields: list[str], readable: dict[str, Column]) -> DataFrame:
    """Fields, each null with a redacted flag where it may not be read; rows stay."""
    out = []
    for f in fields:
        right = readable.get(f, F.lit(True))
        out += [F.when(right, F.col(f)).alias(f), (~right).alias(f"{f}_redacted")]
    return rows.select(*out)


def sort(rows: DataFrame, terms: list[tuple[str, str, str]], key: str) -> DataFrame:
    """At most 8 terms (field, asc | desc, first | last for missing), then the key."""
    if len(terms) > 8 or len({t[0] for t in terms}) < len(terms):
        raise QueryError("sort by at most 8 different fields")
    return rows.orderBy(*(getattr(F.col(f), f"{way}_nulls_{missing}")() for f, way, missing in terms), F.col(key).asc())


def page(rows: DataFrame, key: str, limit: int, after=None) -> DataFrame:
    """The next rows by ascending key, and one more that tells whether there is a further page."""
    if limit <= 0:
        raise QueryError("a page has rows")
    ahead = rows if after is None else rows.filter(F.col(key) > after)
    return ahead.orderBy(key).limit(limit + 1)


@dataclass
class _Held:
    state: dict
    expires: float


class Cursors:
    """Opaque page cursors, bound to principal and query; used once, and dropped at any failure."""

    def __init__(self, seconds: float = 60.0, clock=time.monotonic):
        self._secret, self._held, self.seconds, self.clock = secrets.token_bytes(32), {}, seconds, clock

    def _seal(self, handle: str, binding: dict) -> str:
        return hmac.new(self._secret, (handle + json.dumps(binding, sort_keys=True)).encode(), hashlib.sha256).hexdigest()

    def issue(self, binding: dict, last_key, limit: int, results: int = 0) -> str:
        """A cursor for what follows ``last_key``; results: how many rows its query has given out so far."""
        handle = secrets.token_urlsafe(16)
        self._held[handle] = _Held({"last_key": last_key, "limit": limit, "results": results}, self.clock() + self.seconds)
        return f"{handle}.{self._seal(handle, binding)}"

    def redeem(self, cursor: str, binding: dict) -> dict:
        handle, _, seal = cursor.partition(".")
        held = self._held.pop(handle, None)
        if held is None or held.expires < self.clock() or not hmac.compare_digest(seal, self._seal(handle, binding)):
            raise QueryError("the cursor is not valid")
        return held.state


def read_page(rows: DataFrame, key: str, limit: int, cursors: Cursors, binding: dict, cursor: str | None = None, max_results: int | None = None) -> tuple[list, str | None]:
    """Rows of a page, at most ``limit``, and the cursor of the next one.  All pages of a query together stay within ``max_results``, or it fails."""
    state = cursors.redeem(cursor, binding) if cursor else {"last_key": None, "results": 0}
    got = page(rows, key, limit, state["last_key"]).collect()
    results = state["results"] + min(limit, len(got))
    if max_results is not None and results > max_results:
        raise QueryError(f"more than {max_results} results")
    more = len(got) > limit
    return got[:limit], cursors.issue(binding, got[limit - 1][key], limit, results) if more else None
