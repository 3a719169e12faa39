"""Numbers as text: table cells, answers, literals inside programs; and the conditional texts of statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(x: Column, decimals: int) -> Column:
    """Fixed decimals, half to even on the exact value, no commas."""
    return F.replace(F.format_number(x, decimals), F.lit(","), F.lit(""))


def cell(value: Column, divisor: Column | int) -> Column:
    """A table cell: scaled, whole numbers without decimals, others with one, a triangle for negative ones."""
    x = value / (F.lit(divisor) if isinstance(divisor, int) else divisor)
    a = F.abs(x)
    text = F.when(a == F.floor(a), F.format_number(a, 0)).otherwise(F.format_number(a, 1))
    return F.when(x < 0, F.concat(F.lit("△"), text)).otherwise(text)


def percent(x: Column, decimals: int = 1) -> Column:
    return F.concat(plain(x, decimals), F.lit("%"))


def money(x: Column, unit: Column | str = "") -> Column:
    return F.concat(F.format_number(x, 0), F.lit(unit) if isinstance(unit, str) else unit)


def points(x: Column) -> Column:
    return F.concat(plain(x, 1), F.lit("ポイント"))


def times(x: Column) -> Column:
    return F.concat(plain(x, 2), F.lit("倍"))


def literal(x: Column) -> Column:
    """A double as it is written inside a program: the shortest digits that give it back, at least one decimal, no exponent."""
    s = F.regexp_replace(x.cast("string").cast("decimal(38,18)").cast("string"), r"0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def direction(current: Column, previous: Column, flat: float = 0.005) -> Column:
    """How total assets moved, in words; neutral where a side is missing."""
    change = (current - previous) / F.abs(previous)
    moved = F.when(F.abs(change) < flat, "でほぼ横ばいであった").when(change > 0, "で増加した").otherwise("で減少した")
    from_zero = F.when(current > 0, "で増加した").when(current == 0, "でほぼ横ばいであった").otherwise("で減少した")
    return F.when(current.isNull() | previous.isNull(), "であった").when(previous == 0, from_zero).otherwise(moved)


def period(year: Column) -> Column:
    return F.concat(year, F.lit("年3月期"))


def or_else(a: Column, b: Column) -> Column:
    """``a``, but ``b`` where ``a`` is missing or zero: a zero total counts as missing."""
    return F.coalesce(F.nullif(a, F.lit(0.0)), b)


def truthy(x: Column) -> Column:
    """Present and not zero."""
    return F.coalesce(x != 0, F.lit(False))


# Answers that stand for true and for false, for the validator and for the audit.
VALIDATOR_TRUE = ("はい", "増収", "増益", "改善", "一致", "増加", "true", "yes")
VALIDATOR_FALSE = ("いいえ", "減収", "減益", "悪化", "不一致", "減少", "false", "no")
AUDIT_TRUE = ("はい", "一致する", "True", "true", "増収", "増益", "増加", "上昇", "改善", "存在する", "上回る")
AUDIT_FALSE = ("いいえ", "一致しない", "False", "false", "減収", "減益", "減少", "下落", "悪化", "存在しない", "下回る")


def boolean_answer(normal: Column) -> Column:
    """``true`` / ``false`` for the validator's words, else the normalised answer itself."""
    return F.when(normal.isin(*VALIDATOR_TRUE), "true").when(normal.isin(*VALIDATOR_FALSE), "false").otherwise(normal)
