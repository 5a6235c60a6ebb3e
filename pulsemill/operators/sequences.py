"""Features of state sequences (inventory 2.15): one row per key and state, or per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over

#: Segments of each block.
BLOCKS = {"15min": 3, "30min": 6, "1hr": 12, "3hr": 36, "6hr": 72}


def block(df: DataFrame, segment: str, duration: str) -> DataFrame:
    """The first segments that make up a block, without missing states."""
    return df.where(F.col(segment) < BLOCKS[duration])


def from_wide(df: DataFrame, keys: Sequence[str], prefix: str = "label_seg") -> DataFrame:
    """Rows (keys, segment, state) of a table with a column per segment."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    pairs = F.array(*[F.struct(F.lit(int(c[len(prefix) :])).alias("segment"), F.col(c).cast("int").alias("state")) for c in columns])
    return df.select(*keys, F.inline(pairs))


def _known(df: DataFrame, state: str) -> DataFrame:
    return df.where(F.col(state).isNotNull())


def state_grid(df: DataFrame, keys: Sequence[str], state: str, states: Sequence) -> DataFrame:
    """Every key with every state of a small fixed list."""
    return df.select(*keys).distinct().withColumn(state, F.explode(F.array(*[F.lit(s) for s in states]))).withColumn(state, F.col(state).cast(df.schema[state].dataType))


def _on_grid(found: DataFrame, grid: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row for each place of the grid, with 0 for what wasn't found."""
    kinds = dict(found.dtypes)
    return grid.join(found, list(by), "left").select(*by, *[F.coalesce(v, F.lit(0).cast(kinds[v])).alias(v) for v in values])


def frequency(df: DataFrame, keys: Sequence[str], state: str, states: Sequence | None = None) -> DataFrame:
    """Share of each state among the known ones; of ``states`` also the absent ones, with 0."""
    counts = _known(df, state).groupBy(*keys, state).agg(F.count("*").alias("n"))
    out = counts.withColumn("freq", F.col("n") / F.sum("n").over(over(keys)))
    return out if states is None else _on_grid(out, state_grid(df, keys, state, states), [*keys, state], ["n", "freq"])


def transitions(df: DataFrame, keys: Sequence[str], segment: str, state: str, same: bool, states: Sequence | None = None) -> DataFrame:
    """Share of each change of state among all changes (or of each stay among all stays); a gap is bridged.

    Of ``states`` also the changes (stays) that don't occur, with 0.
    """
    rows = _known(df, state).withColumn("to_state", F.lead(state).over(over(keys, [segment]))).where("to_state is not null")
    rows = rows.where(F.col("to_state") == F.col(state)) if same else rows.where(F.col("to_state") != F.col(state))
    counts = rows.groupBy(*keys, F.col(state).alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(over(keys)))
    if states is None:
        return out
    grid = state_grid(df, keys, state, states).withColumnRenamed(state, "from_state")
    kind = df.schema[state].dataType
    grid = grid.withColumn("to_state", F.explode(F.array(*[F.lit(s).cast(kind) for s in states]))).where((F.col("from_state") == F.col("to_state")) == F.lit(same))
    return _on_grid(out, grid, [*keys, "from_state", "to_state"], ["n", "share"])


def dwell(df: DataFrame, keys: Sequence[str], segment: str, state: str, states: Sequence | None = None) -> DataFrame:
    """Longest run of each state over the number of known states; of ``states`` also the absent ones, with 0."""
    w = over(keys, [segment])
    rows = _known(df, state).withColumn("__new", F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("__run", F.sum("__new").over(w)).withColumn("__n", F.count("*").over(over(keys)))
    runs = rows.groupBy(*keys, state, "__run").agg(F.count("*").alias("__length"), F.max("__n").alias("__n"))
    out = runs.groupBy(*keys, state).agg(F.max("__length").alias("longest"), (F.max("__length") / F.max("__n")).alias("dwell"))
    return out if states is None else _on_grid(out, state_grid(df, keys, state, states), [*keys, state], ["longest", "dwell"])


def entropy(df: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    """Natural-log entropy of the states."""
    return frequency(df, keys, state).groupBy(*keys).agg((-F.sum(F.col("freq") * F.log("freq"))).alias("entropy"))


def first_lag(df: DataFrame, keys: Sequence[str], segment: str, state: str, states: Sequence) -> DataFrame:
    """Position of the first occurrence of each state over the number of known ones; 1 if absent."""
    rows = _known(df, state).withColumn("__i", F.row_number().over(over(keys, [segment])) - 1).withColumn("__n", F.count("*").over(over(keys)))
    firsts = rows.groupBy(*keys, state).agg((F.min("__i") / F.max("__n")).alias("first_lag"))
    return state_grid(df, keys, state, states).join(firsts, [*keys, state], "left").withColumn("first_lag", F.coalesce("first_lag", F.lit(1.0)))
