"""Column expressions that several analyses share."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNC = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def revenue() -> Column:
    return F.col("price") * F.col("quantity")


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def period_start(c: str, period: str) -> Column:
    """First day of the period (D, W from Monday, M, Q or Y)."""
    return F.to_date(F.date_trunc(TRUNC[period], F.col(c)))


def period_index(later: Column, first: Column, period: str) -> Column:
    """Periods between two period starts."""
    days = F.datediff(later, first)
    if period in ("D", "W"):
        return (days / (1 if period == "D" else 7)).cast("int")
    return (F.months_between(later, first) / (1 if period == "M" else 3)).cast("int")


def iso_week(c: str | Column) -> Column:
    """ISO year times 100 plus ISO week."""
    d = F.col(c) if isinstance(c, str) else c
    return F.extract(F.lit("YEAROFWEEK"), d).cast("int") * 100 + F.weekofyear(d)


def log_or_zero(c: Column) -> Column:
    """Natural logarithm, 0 for 0."""
    return F.when(c == 0, 0.0).otherwise(F.log(c))


def ladder(c: Column, steps: list[tuple[float, str]], default: str, strict: bool = False) -> Column:
    """Label of the first bound that c does not exceed (with strict: stays below)."""
    out = None
    for bound, label in steps:
        hit = c < bound if strict else c <= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)
