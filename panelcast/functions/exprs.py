"""Column expressions with one rule for nulls and zero denominators.

Nothing here yields NaN or infinity from finite input: a ratio over zero is NULL
unless a variant says otherwise, and a NULL operand gives a NULL result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: ColumnLike) -> Column:
    """Sum that is NULL as soon as one row of the group is NULL."""
    c = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def ratio(num: ColumnLike, den: ColumnLike, on_zero: str = "null") -> Column:
    """``num / den``; *on_zero* is null, zero, plus_one (den + 1) or floor_one (max(den, 1)).

    ``null`` and ``zero`` only divide by a positive denominator.
    """
    num, den = _col(num), _col(den)
    if on_zero == "null":
        return F.when(den > 0, F.try_divide(num, den))
    if on_zero == "zero":
        return F.when(den > 0, F.try_divide(num, den)).when(den.isNotNull(), F.lit(0.0))
    if on_zero == "plus_one":
        return F.try_divide(num, den + 1)
    if on_zero == "floor_one":
        return F.when(den.isNotNull(), F.try_divide(num, F.greatest(den, F.lit(1.0))))
    raise ValueError(f"unknown on_zero: {on_zero}")


def clip_low(c: ColumnLike, low: float = 0.0) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clamp(c: ColumnLike, low: float, high: float) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def propensity(x: ColumnLike, available: ColumnLike, eps: float = 1e-4) -> Column:
    """Jeffreys-smoothed rate of *x* out of *available*, kept inside (0, 1)."""
    return clamp(F.try_divide(_col(x) + 0.5, _col(available) + 1), eps, 1 - eps)


def logit(p: ColumnLike) -> Column:
    p = _col(p)
    return F.ln(p / (1 - p))


def inv_logit(x: ColumnLike) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def log1p_floor(c: ColumnLike) -> Column:
    return F.log1p(clip_low(c))


def expm1_floor(c: ColumnLike) -> Column:
    return clip_low(F.expm1(_col(c)))


def recode(c: ColumnLike, mapping: Mapping[str, object], default: object = None) -> Column:
    """Exact-match recode; unmatched values keep themselves unless *default* is given."""
    c = _col(c)
    out = F
    for value, label in mapping.items():
        out = out.when(c == value, F.lit(label))
    return out.otherwise(c if default is None else F.lit(default))


def recode_like(
    c: ColumnLike, rules: Sequence[tuple[str, object]], default: object = None
) -> Column:
    """First matching regular expression wins; the rest keep themselves or take *default*."""
    c = _col(c)
    out = F
    for pattern, label in rules:
        out = out.when(c.rlike(pattern), F.lit(label))
    return out.otherwise(c if default is None else F.lit(default))


def indicator(c: ColumnLike, value: object) -> Column:
    """1 where equal, 0 elsewhere (NULL counts as not equal)."""
    return F.coalesce((_col(c) == value).cast("int"), F.lit(0))


def is_finite(c: ColumnLike) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def total_of(columns: Sequence[ColumnLike]) -> Column:
    """Null-strict sum of several columns of one row."""
    return reduce(lambda a, b: a + b, [_col(c) for c in columns])


def tidy(c: ColumnLike, digits: int = 6) -> Column:
    """Round for output and turn -0.0 into 0.0."""
    return F.round(_col(c), digits) + F.lit(0.0)
