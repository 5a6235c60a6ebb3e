"""Segmentation and ordered operators (inventory 2.7, 2.9 W2, W4-W11; 2.4 J6, J13-J16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over, reach_back


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], latest: bool = False) -> DataFrame:
    """The first (or latest) row of each key; an aggregate, so rows are thinned out before the shuffle."""
    pick = F.max_by if latest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def backward_segments(samples: DataFrame, onset: DataFrame, key: str, t: str, at: str, width: int, segments: int) -> DataFrame:
    """Samples of the ``segments`` windows before the onset, with ``segment`` counted back from it (0 is the last)."""
    joined = samples.join(onset, key).where((F.col(t) < F.col(at)) & (F.col(t) >= F.col(at) - width * segments))
    return joined.withColumn("segment", F.floor((F.col(at) - F.col(t)) / F.lit(width)).cast("long"))


def segment_edges(segment: Column, onset: Column, width: int) -> tuple[Column, Column]:
    """Start and end of a backward segment; its start is open, its end closed."""
    return onset - (segment + 1) * width, onset - segment * width


def sticky_drop(counts: DataFrame, keys: Sequence[str], segment: str, n: str, least: int) -> DataFrame:
    """Once a segment is too short its channel is dropped for all later ones: adds ``valid``."""
    w = reach_back(keys, [segment])
    return counts.withColumn("valid", F.min((F.col(n) >= least).cast("int")).over(w) == 1)


def truncate_at_last_gap(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, low: float, high: float) -> DataFrame:
    """Keeps the samples after the last step whose length lies outside [low, high]."""
    w = over(keys, order)
    step = F.col(t) - F.lag(t).over(w)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__gap", F.when((step < low) | (step > high), F.row_number().over(w)))
    return rows.withColumn("__last", F.coalesce(F.max("__gap").over(over(keys)), F.lit(0))).where("__i >= __last").drop("__i", "__gap", "__last")


def sampling_step(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, first: int = 30_000) -> DataFrame:
    """Median step of the first samples of each series, whose inverse is the sampling rate."""
    w = over(keys, order)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__step", F.col(t) - F.lag(t).over(w)).where(F.col("__i") <= first)
    return rows.groupBy(*keys).agg(F.percentile("__step", 0.5).alias("step"), F.count("__step").alias("steps"))


def align_at_end(df: DataFrame, keys: Sequence[str], channel: str, order: Sequence[str]) -> DataFrame:
    """The last n samples of each channel, n being the size of the shortest one."""
    by = [*keys, channel]
    back = [F.col(c).desc() for c in order]
    rows = df.withColumn("__n", F.count("*").over(over(by))).withColumn("__back", F.row_number().over(over(by, back)))
    return rows.withColumn("__least", F.min("__n").over(over(keys))).where("__back <= __least").drop("__n", "__back", "__least")


def nearest_signed(left: DataFrame, right: DataFrame, key: str, row: Sequence[str], at: str, t: str, tie: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """For each left row, with its time ``at``, the right row of its key whose time ``t`` is nearest before, else nearest at or after.

    ``difference`` is right time less left time; of equal times the first row by
    ``tie`` counts.  Where all ``scores`` of a key's rows are null, the first row by
    ``tie`` is taken.  Both sides are put in order together and looked back and
    ahead from each left row; no row meets all rows of its key.
    """
    rest = [c for c in right.columns if c != key]
    rows = right.select(key, F.col(t).alias("__t"), F.lit(1).alias("__side"), *[F.col(c).alias(f"__{c}") for c in tie], F.struct(*rest).alias("__r"))
    marks = left.select(key, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.struct(*row, F.col(at).alias("__at")).alias("__l"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    ties = [F.desc(f"__{c}") for c in tie]
    before = over([key], ["__t", "__side", *ties]).rowsBetween(Window.unboundedPreceding, -1)
    after = over([key], [F.desc("__t"), F.desc("__side"), *ties]).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumns({"__before": F.last("__r", ignorenulls=True).over(before), "__after": F.last("__r", ignorenulls=True).over(after)}).where("__side = 0")
    blank = F.lit(True)
    for s in scores:
        blank = blank & F.col(s).isNull()
    firsts = right.groupBy(key).agg(F.min(blank.cast("int")).alias("__blank"), F.min_by(F.struct(*rest), F.struct(*tie)).alias("__first")).where("__blank = 1").drop("__blank")
    out = near.join(firsts, key, "left").withColumn("__x", F.coalesce("__first", "__before", "__after")).where("__x is not null")
    return out.select(key, *[F.col(f"__l.{c}") for c in row], "__x.*", (F.col(f"__x.{t}") - F.col("__l.__at")).alias("difference"))


def carried(keys: Sequence[str], order: Sequence[str], value: Column, ahead: bool = False) -> Column:
    """The last value that isn't null up to this row; with ``ahead``, the next one from this row on."""
    return F.last(value, ignorenulls=True).over(reach_back(keys, order, ahead))


def fill_both_ways(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Forward fill, then backward fill, inside each key."""
    return df.withColumns({c: F.coalesce(carried(keys, order, F.col(c)), carried(keys, order, F.col(c), ahead=True)) for c in columns})


def coalesce_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, last: Sequence[str] = ()) -> DataFrame:
    """Joins intervals whose end is the next one's start: the first start, the last end and ``last`` columns of the last row."""
    w = over(keys, [start, end])
    rows = df.withColumn("__new", F.coalesce((F.lag(end).over(w) != F.col(start)).cast("int"), F.lit(1)))
    rows = rows.withColumn("__island", F.sum("__new").over(w)).withColumn("__i", F.row_number().over(w))
    out = rows.groupBy(*keys, "__island").agg(
        F.min(start).alias(start), F.max_by(F.col(end), F.col("__i")).alias(end), F.count("*").alias("parts"), *[F.max_by(F.col(c), F.col("__i")).alias(c) for c in last]
    )
    return out.drop("__island")


def next_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, is_from: Column, is_to: Column) -> DataFrame:
    """For each row of the first kind the delay to the next row of the second kind (null if there is none)."""
    target = F.last(F.when(is_to, F.col(t)), ignorenulls=True).over(reach_back(keys, order, ahead=True, upto=-1))
    return df.withColumn("delay", target - F.col(t)).where(is_from)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, at: Column, before: Column, after: Column) -> DataFrame:
    """For each row of kind ``at`` the time of the last ``before`` and of the first ``after`` row around it."""
    last = F.last(F.when(before, F.col(t)), ignorenulls=True).over(reach_back(keys, order, upto=-1))
    first = F.last(F.when(after, F.col(t)), ignorenulls=True).over(reach_back(keys, order, ahead=True, upto=-1))
    return df.withColumn("previous", last).withColumn("following", first).where(at)


def first_in_cycle(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, boundary: Column, landmark: Column) -> DataFrame:
    """Cycles between successive boundary rows, and the first landmark strictly inside each (a band join by running count)."""
    rows = df.withColumn("cycle", F.sum(boundary.cast("int")).over(over(keys, order)))
    cycles = rows.where("cycle > 0").groupBy(*keys, "cycle").agg(F.min(F.when(boundary, F.col(t))).alias("start"), F.min(F.when(landmark, F.col(t))).alias("landmark"))
    return cycles.withColumn("end", F.lead("start").over(over(keys, ["cycle"]))).where("end is not null")


def zip_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], channel: str, first: str, second: str, t: str) -> DataFrame:
    """Pairs the k-th event of one kind with the k-th of the other, after dropping the second kind's events before the first of the first kind."""
    chosen = df.where(F.col(channel).isin(first, second)).withColumn("__begin", F.min(F.when(F.col(channel) == first, F.col(t))).over(over(keys)))
    later = chosen.where((F.col(channel) == first) | (F.col(t) > F.col("__begin"))).withColumn("k", F.row_number().over(over([*keys, channel], order)))
    paired = later.groupBy(*keys, "k").agg(*[F.max(F.when(F.col(channel) == c, F.col(t))).alias(a) for c, a in ((first, "a"), (second, "b"))])
    return paired.where("a is not null and b is not null")


#: Fixed factors of a second by the name of the resolution, as the timestamps of waves have them.
RESOLUTIONS = {"ns": 1e9, "ms": 1e3, "s": 1.0, "min": 60.0}


def timestamps(df: DataFrame, rate: Column | float, resolution: str = "s", start: float = 0.0, place: str = "i", out: str = "timestamp") -> DataFrame:
    """Adds the time of each sample by its place from 0 on, in the resolution's unit."""
    if start < 0:
        raise ValueError("the start can't be negative")
    if resolution not in RESOLUTIONS:
        raise ValueError(f"the resolution is one of {', '.join(RESOLUTIONS)}")
    return df.withColumn(out, F.col(place) / rate * F.lit(RESOLUTIONS[resolution]) + F.lit(start))


def timestamp_faults(df: DataFrame, keys: Sequence[str], place: str = "i", timestamp: str = "timestamp") -> DataFrame:
    """The samples whose timestamp is before that of the sample before them; none if the timestamps are monotonic."""
    return df.withColumn("__b", F.lag(timestamp).over(over(keys, [place]))).where(F.col(timestamp) < F.col("__b")).drop("__b")
