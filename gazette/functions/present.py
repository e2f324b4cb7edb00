"""What tables show: lists cut short, areas, windows of closing dates, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AVAILABLE = "Not Available"
UNCLEAR_AREA = "Other Pharmaceutical"


def join_top(values: Column, most: int = 3) -> Column:
    """The first values of a list and how many more there are."""
    own = lambda x: F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.trim(v) != "")
    text = lambda v: F.when(F.size(v) == 0, NOT_AVAILABLE).when(F.size(v) > most, F.concat(F.array_join(F.slice(v, 1, most), "; "), F.lit("; (+"), (F.size(v) - most).cast("string"), F.lit(" more)"))).otherwise(F.array_join(v, "; "))
    return F.get(F.transform(F.array(own(values)), text), F.lit(0))


def display_area(item: Column, tender: Column, code_label: Column) -> Column:
    """The item's area, then the notice's, passing over the unclear one; then whatever is filled; then the code's label."""
    clear = lambda c: F.when((c != "") & (c != UNCLEAR_AREA), c)
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(clear(item), clear(tender), filled(item), filled(tender), code_label, F.lit(NOT_AVAILABLE))


def labels_of(labels: dict[str, str], code: Column) -> Column:
    return F.coalesce(*(F.when(code == k, v) for k, v in labels.items())) if labels else F.lit(None).cast("string")


def closing_window(preset: str, as_of: str) -> tuple[Column | None, Column | None]:
    """First and last day of a preset: open, closed, a number of days, or none. Both days belong to it."""
    day = F.to_date(F.lit(as_of))
    if preset == "open":
        return day, None
    if preset == "closed":
        return None, day
    if preset:
        return day, F.date_add(day, int(preset))
    return None, None


def within(c: Column, low: Column | None, high: Column | None) -> Column:
    """True inside a window; NULL is in no window that has a bound."""
    test = F.lit(True)
    for bound, inside in ((low, lambda b: c >= b), (high, lambda b: c <= b)):
        if bound is not None:
            test = test & F.coalesce(inside(bound), F.lit(False))
    return test


def whole_number(c: Column) -> Column:
    return F.format_number(c, 0)


def evidence_json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))
