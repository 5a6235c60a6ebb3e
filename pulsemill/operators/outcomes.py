"""Event incidence, day-level outcome grids and event-free days (inventory 2.5, 3.4)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pre_post(df: DataFrame, onset: str, at: str) -> DataFrame:
    """``t_post`` where the event is after the onset, ``t_pre`` where it is not."""
    return df.withColumn("t_post", F.when(F.col(at) > F.col(onset), F.col(at))).withColumn("t_pre", F.when(F.col(at) <= F.col(onset), F.col(at)))


def ever(df: DataFrame, key: str, flags: Mapping[str, Column]) -> DataFrame:
    """Per key 1 if a flag holds in any of its rows, else 0."""
    return df.groupBy(key).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()])


def incidence(df: DataFrame, key: str, flags: Mapping[str, Column]) -> DataFrame:
    """One row with the percentage of keys that ever have each flag."""
    return ever(df, key, flags).agg(*[(F.avg(n) * 100).alias(f"{n}_pct") for n in flags])


def horizon_flags(name: str, flag: Column, day: str, horizons: Iterable[int], negative_days: bool = False) -> dict[str, Column]:
    """Columns name_h: the flag within day h; days before the onset count only with ``negative_days``."""
    within = lambda h: (F.col(day) <= h) if negative_days else F.col(day).between(0, h)
    return {f"{name}_{h}": F.when(flag & within(h), 1).otherwise(0).cast("int") for h in horizons}


def event_grid(df: DataFrame, key: str, day: str, counted: Mapping[str, Column], final: Mapping[str, Column], horizons: Sequence[int]) -> DataFrame:
    """One row per key and day with any event, and a flag per event and horizon.

    ``counted`` events need a day from 0 on; ``final`` ones (a death) count on
    any day up to the horizon.
    """
    columns: dict[str, Column] = {}
    some = F.lit(False)
    for names, before in ((counted, False), (final, True)):
        for name, flag in names.items():
            columns |= horizon_flags(name, flag, day, horizons, before)
            some = some | F.coalesce(flag, F.lit(False))
    return df.where(some).groupBy(key, day).agg(*[F.max(c).alias(n) for n, c in columns.items()])


def free_days(grid: DataFrame, cohort: DataFrame, key: str, events: Sequence[str], final: str, horizons: Sequence[int], event_free_full: bool = False) -> DataFrame:
    """Days without each event within each horizon, for every key of the cohort.

    A final event within the horizon gives 0.  Keys without any event get 0, or the
    whole horizon with ``event_free_full``.
    """
    names = {f"{e}_free_{h}": (e, h) for e in events for h in horizons}
    value = lambda e, h: F.when(F.max(f"{final}_{h}") == 1, 0).otherwise(F.greatest(F.lit(0), h - F.sum(f"{e}_{h}")))
    per_key = grid.groupBy(key).agg(*[value(e, h).alias(n) for n, (e, h) in names.items()])
    joined = cohort.select(key).join(per_key, key, "left")
    return joined.select(key, *[F.coalesce(F.col(n), F.lit(h if event_free_full else 0)).cast("long").alias(n) for n, (_, h) in names.items()])


def bedside_flags(df: DataFrame, keys: Sequence[str], gcs: str, rr: str, sbp: str) -> DataFrame:
    """The three bedside flags (below 15, from 22, up to 100) and their sum."""
    flags = {"gcs_flag": F.col(gcs) < 15, "rr_flag": F.col(rr) >= 22, "sbp_flag": F.col(sbp) <= 100}
    out = df.withColumns({n: c.cast("int") for n, c in flags.items()})
    return out.select(*keys, *flags, (F.col("gcs_flag") + F.col("rr_flag") + F.col("sbp_flag")).alias("total"))


def by_group(df: DataFrame, group: str, means: Mapping[str, str], medians: Mapping[str, str]) -> DataFrame:
    """Size, means and exact medians by group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in means.items()], *[F.percentile(c, 0.5).alias(n) for n, c in medians.items()])


def timeline(df: DataFrame, period: str, group: str, groups: Sequence[str]) -> DataFrame:
    """Counts and percentages of the groups by period; missing ones are 0."""
    counts = df.groupBy(period).agg(F.count(group).alias("__total"), *[F.count(F.when(F.col(group) == g, 1)).alias(f"n_{g}") for g in groups])
    return counts.select(period, *[f"n_{g}" for g in groups], *[F.round(100 * F.col(f"n_{g}") / F.col("__total"), 4).alias(f"pct_{g}") for g in groups])
