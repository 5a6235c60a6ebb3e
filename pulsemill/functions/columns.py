"""Column expressions that more than one operator needs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (the session zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def days_floor(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down: half a day before is day -1."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY_MICROS)).cast("long")


def clean_double(c: str | Column) -> Column:
    """NaN and infinities as null."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def over(keys: Sequence[str], order: Iterable = ()) -> Window:
    w = Window.partitionBy(*keys)
    order = list(order)
    return w.orderBy(*order) if order else w


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: named inside a lambda it would be made anew for each element, and two names are two values there."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together, in as many tasks as ``spark.sql.shuffle.partitions`` says; adaptive execution joins tasks by their bytes, few even where each row takes long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def entropy_of_counts(counts: Sequence[Column], total: Column) -> Column:
    """Natural-log entropy of counts that add up to ``total``; zero counts don't matter."""
    terms = [F.when(c > 0, -(c / total) * F.log(c / total)).otherwise(F.lit(0.0)) for c in counts]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per column of a wide table, nulls included."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), name, value)


def reach_back(keys: Sequence[str], order: Sequence[str], ahead: bool = False, upto: int = 0) -> Window:
    """The frame of all rows before this one (after it, with ``ahead``), with it or, at ``upto`` -1, without.

    Rows after it are those before it in falling order: only a frame that begins
    at the first row is kept up from row to row, all others are made anew for each.
    """
    by = [F.col(c).desc() for c in order] if ahead else order
    return over(keys, by).rowsBetween(Window.unboundedPreceding, upto)


def whole(keys: Sequence[str], order: Sequence[str]) -> Window:
    """The frame of all rows of a key, added up in their order."""
    return over(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
