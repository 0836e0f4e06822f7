"""Scalar column expressions (CASE ladders, bands, labels) — all JVM-side built-ins."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainlens.schema import SEVERITIES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stock_status(qty, thr) -> Column:
    """New stock status after a quantity change."""
    qty, thr = _c(qty), _c(thr)
    return (F.when(qty == 0, "Out of Stock").when(qty < thr, "Low Stock").otherwise("In Stock"))


def stock_severity(qty, thr) -> Column:
    """0 → Critical; below 30 % of threshold → High; else Medium.

    ``qty < 0.3 * thr`` is evaluated as ``10 * qty < 3 * thr`` in integers (no
    binary-fraction rounding)."""
    qty, thr = _c(qty), _c(thr)
    return (F.when(qty == 0, "Critical")
            .when(qty.cast("bigint") * 10 < thr.cast("bigint") * 3, "High")
            .otherwise("Medium"))


def overdue_severity(days) -> Column:
    """More than 10 days → Critical; more than 5 → High; else Medium."""
    days = _c(days)
    return F.when(days > 10, "Critical").when(days > 5, "High").otherwise("Medium")


def severity_rank(sev) -> Column:
    """Explicit Low < Medium < High < Critical rank (never lexical)."""
    m = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i + 1)) for i, s in enumerate(SEVERITIES)))
    return m[_c(sev)]


def days_between(later, earlier) -> Column:
    """Date − date as an integer number of days."""
    return F.date_diff(_c(later), _c(earlier))


def pct_of(cur, thr) -> Column:
    """Stock percentage, capped at 100, half-up rounded; 0 when the threshold is not positive."""
    cur, thr = _c(cur), _c(thr)
    pct = F.floor((cur.cast("bigint") * 200 + thr) / (thr.cast("bigint") * 2))
    return F.when(thr > 0, F.least(F.lit(100), pct.cast("int"))).otherwise(F.lit(0))


def stock_band(cur, thr) -> Column:
    """R8 legacy progress bar: rounded pct ≥ 70 safe, ≥ 40 warning, else critical."""
    pct = pct_of(cur, thr)
    return F.when(pct >= 70, "safe").when(pct >= 40, "warning").otherwise("critical")


def stock_ratio_band(cur, thr) -> Column:
    """R8 chart colour: unrounded ratio ≥ 0.7 / ≥ 0.4 (integers: 10·cur ≥ 7·thr)."""
    cur, thr = _c(cur).cast("bigint"), _c(thr).cast("bigint")
    return (F.when(cur * 10 >= thr * 7, "safe").when(cur * 10 >= thr * 4, "warning")
            .otherwise("critical"))


def stock_danger(cur, thr) -> Column:
    """R8 gauge: below 30 % of the threshold is danger, otherwise warning."""
    cur, thr = _c(cur).cast("bigint"), _c(thr).cast("bigint")
    return F.when(cur * 10 < thr * 3, "danger").otherwise("warning")


def reliability_pct(score) -> Column:
    """Rounded percentage of a 0..1 score (NULL counts as 0)."""
    return F.round(F.coalesce(_c(score), F.lit(0)) * 100, 0).cast("int")


def reliability_band_legacy(score) -> Column:
    pct = reliability_pct(score)
    return F.when(pct >= 90, "safe").when(pct >= 75, "warning").otherwise("critical")


def reliability_band(score) -> Column:
    s = _c(score)
    return F.when(s >= 0.8, "safe").when(s >= 0.6, "warning").otherwise("danger")


def overdue_band(days) -> Column:
    d = _c(days)
    return F.when(d >= 10, "critical").when(d >= 5, "warning").otherwise("info")


def filled(template: str, **values: Column) -> Column:
    """A fixed text with each {name} replaced by its value."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def truncate_label(text, n: int) -> Column:
    """Cut to ``n`` characters plus an ellipsis when longer."""
    t = _c(text)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def display_date(d) -> Column:
    """X10: 'dd Mon yyyy', NULL as an em dash."""
    return F.coalesce(F.date_format(_c(d), "dd MMM yyyy"), F.lit("—"))


def lookup(col, mapping: dict, default: str) -> Column:
    """X11: value → class via a literal map, with a default for unknown / NULL."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(m[_c(col)], F.lit(default))


# Fixed value → class maps of the two user interfaces; the company page has a status map of its own.
LEGACY_STATUS_CLASS = {
    "In Stock": "safe", "Active": "safe", "Delivered": "safe", "Resolved": "safe", "Fulfilled": "safe",
    "Low Stock": "warning", "Pending": "warning", "Investigating": "warning",
    "In Transit": "info", "Processing": "info", "Shipped": "info",
    "Out of Stock": "critical", "Delayed": "critical", "Critical": "critical", "Open": "critical",
    "Cancelled": "critical",
    "High": "warning", "Medium": "info", "Low": "muted",
    "Dismissed": "muted", "Inactive": "muted",
}
LEGACY_PRIORITY_CLASS = {"Critical": "critical", "High": "warning", "Medium": "info", "Low": "muted",
                         "Urgent": "critical"}
STATUS_BADGE = {
    "Delivered": "safe", "Shipped": "safe", "Processing": "info", "In Transit": "info",
    "Pending": "warning", "Delayed": "danger", "Cancelled": "danger",
    "Low Stock": "warning", "Out of Stock": "danger", "In Stock": "safe",
    "Open": "danger", "Investigating": "warning", "Resolved": "safe", "Dismissed": "info",
}
DETAIL_BADGE = {
    "Delivered": "safe", "Shipped": "safe", "In Transit": "info",
    "Pending": "warning", "Delayed": "danger", "Cancelled": "danger",
    "Open": "danger", "Investigating": "warning", "Resolved": "safe", "Dismissed": "info",
}
SEVERITY_BADGE = {"Critical": "danger", "High": "warning", "Medium": "info", "Low": "safe"}
