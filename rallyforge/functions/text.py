"""Formatting of values for reports, as Column expressions. A missing value shows as a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "–"


def mmss(seconds: Column) -> Column:
    whole = F.floor(seconds)
    shown = F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))
    return F.when(seconds.isNotNull() & ~F.isnan(seconds), shown).otherwise(DASH)


def percent(v: Column, digits: int = 0) -> Column:
    return F.when(v.isNotNull() & ~F.isnan(v), F.format_string(f"%.{digits}f %%", v * 100)).otherwise(DASH)


def number(v: Column, digits: int = 1, unit: str = "") -> Column:
    return F.when(v.isNotNull() & ~F.isnan(v), F.format_string(f"%.{digits}f{unit.replace('%', '%%')}", v)).otherwise(DASH)


def joined(*parts: Column, by: str = "; ") -> Column:
    """Parts that are neither NULL nor empty, joined."""
    return F.concat_ws(by, *(F.when(p != "", p) for p in parts))
