"""Calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_years(start: Column, end: Column) -> Column:
    """Signed length of start..end in calendar years, whole and part.

    The part is measured against the year that follows the last anniversary, so
    leap years count 366 days. Works for end before start (negative length).
    """
    years = F.year(end) - F.year(start)
    whole = years - F.when(F.add_months(start, years * 12) > end, 1).otherwise(0)
    low = F.add_months(start, whole * 12)
    high = F.add_months(start, (whole + 1) * 12)
    return whole + F.datediff(end, low) / F.datediff(high, low)


def parse_date(text: Column, pattern: str = "M/d/yyyy") -> Column:
    """Text to date, with or without leading zeros; unparsable text becomes NULL."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")
