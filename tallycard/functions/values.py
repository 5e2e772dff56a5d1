"""Scalar expressions with R-like treatment of missing values."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """NULL test gives NULL; a plain ``otherwise`` would give ``no``."""
    return F.when(test, yes).when(~test, no)


def is_one_of(value: Column, options: Iterable) -> Column:
    """Membership that is never NULL."""
    return F.coalesce(value.isin(list(options)), F.lit(False))


def class_label(test: Column, event: str = "Abnormal", other: str = "Normal") -> Column:
    return if_else(test, F.lit(event), F.lit(other))


def keep_levels(value: Column, levels: list[str]) -> Column:
    """Values outside ``levels`` become NULL."""
    return F.when(value.isin(levels), value)


def level_number(value: Column, levels: list[str]) -> Column:
    """1-based position in an ordered level list, NULL when not listed."""
    position = F.array_position(F.lit(levels), value).cast("int")
    return F.when(position > 0, position)


def any_true(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)


def sign_change(flag: Column) -> Column:
    """Event = +1, other = -1."""
    return if_else(flag, F.lit(1), F.lit(-1))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_text(x: Column, digits: int) -> Column:
    """0.1234 -> '12.34%' with ``digits`` decimals of the percentage."""
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def number_text(x: Column) -> Column:
    """Integer as text, with an en dash for the minus sign."""
    return F.replace(x.cast("string"), F.lit("-"), F.lit("–"))


def joined_text(sep: str, *parts: Column) -> Column:
    """Paste parts together; a missing part is written as NA."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def setting_text(**named: Column) -> Column:
    """'a = 1, b = 2'; settings that are NULL are left out."""
    return F.concat_ws(
        ", ", *[F.concat(F.lit(f"{k} = "), v.cast("string")) for k, v in named.items()]
    )


def hash_key(seed: object, *cols: str) -> Column:
    """Order key for sampling: the same rows always sort the same way."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def replace_first(text: Column, pattern: str, by: str) -> Column:
    """Replace only the first match; the pattern has no capturing groups."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", f"$1{by}")
