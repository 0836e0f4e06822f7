"""F1–F9 — row predicates (Column expressions; Catalyst pushes them to the scan)."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.schema import OPEN_STATUSES

ALL = "ALL"


def scope(df: DataFrame, cid, col: str = "company_id") -> DataFrame:
    """tenant filter.  ``ALL`` (or the admin role) keeps everything; an id keeps
    that tenant's rows; ``None`` keeps nothing (a company user without a company)."""
    if cid == ALL:
        return df
    if cid is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(col) == F.lit(cid))


def is_low_stock(qty="quantity_available", thr="minimum_threshold") -> Column:
    """quantity below threshold; NULL on either side is not low."""
    return F.coalesce(F.col(qty) < F.col(thr), F.lit(False))


def as_of_lit(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = datetime.date.fromisoformat(as_of)
    return F.lit(as_of)


def is_overdue(as_of, actual="actual_delivery_date", expected="expected_delivery_date") -> Column:
    """not delivered and expected before ``as_of`` — whatever the status (incl. Cancelled)."""
    return F.coalesce(F.col(actual).isNull() & (F.col(expected) < as_of_lit(as_of)), F.lit(False))


def is_delayed_status(col="shipment_status") -> Column:
    """status 'Delayed' (a different notion from F3)."""
    return F.coalesce(F.col(col) == "Delayed", F.lit(False))


def is_open(col="resolution_status") -> Column:
    """Open or Investigating."""
    return F.coalesce(F.col(col).isin(*OPEN_STATUSES), F.lit(False))


def value_in(col: str, values) -> Column:
    """multi-value filter; an empty selection keeps every row."""
    values = list(values or [])
    if not values:
        return F.lit(True)
    return F.coalesce(F.col(col).isin(*values), F.lit(False))


def search(q: str | None, *cols: str) -> Column:
    """case-insensitive literal substring over any of ``cols``; NULL never matches."""
    if not q:
        return F.lit(True)
    needle = F.lit(q.lower())
    hits = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, hits)


def equals(col: str, value) -> Column:
    """F8: equality filter; an empty choice keeps every row."""
    if value is None or value == "":
        return F.lit(True)
    return F.coalesce(F.col(col) == F.lit(value), F.lit(False))


def row_search(q: str | None, cols) -> Column:
    """substring over the whole rendered row (cells joined by spaces)."""
    if not q:
        return F.lit(True)
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    return F.lower(text).contains(F.lit(q.lower()))
