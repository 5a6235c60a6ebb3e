"""Joins, projections and selections of cohort tables (inventory 2.3, 2.4, 2.7, 2.8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over


def match(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str = "left") -> DataFrame:
    """An equi-join on differently named keys; the right keys go."""
    condition = [left[a] == right[b] for a, b in zip(left_on, right_on, strict=True)]
    return left.join(right, condition, how).drop(*[right[b] for b in right_on])


def suffixed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """A join in which columns of both sides get suffixes."""
    both = set(left.columns) & set(right.columns) - set(on)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return left.join(right, list(on), how)


def aligned_values(df: DataFrame, keys: Sequence[str], kind: str, value: str, names: Mapping[str, str]) -> DataFrame:
    """Values of several kinds charted under the same keys, side by side: one shuffle instead of a join per kind."""
    chosen = df.where(F.col(kind).isin(*names))
    return chosen.groupBy(*keys).agg(*[F.max(F.when(F.col(kind) == k, F.col(value))).alias(n) for k, n in names.items()])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(over(keys, order))).where(F.col(rank) <= k)


def project_to(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """Exactly the columns of a contract, in its order; missing ones are null, others go."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in contract.items()])


def move_column(df: DataFrame, column: str, position: int) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(*rest[:position], column, *rest[position:])


def rename_from(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Renames the columns that the mapping names."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_positional(df: DataFrame) -> DataFrame:
    """Without the index columns that a spreadsheet left behind."""
    return df.select(*[c for c in df.columns if "unnamed" not in c.lower()])


def normalised_key(column: str):
    """A key read as a float (``12.0``) as text without its fraction."""
    return F.regexp_replace(F.trim(F.col(column).cast("string")), r"^(\d+)\.0$", "$1")


def parse_names(df: DataFrame, name: str) -> DataFrame:
    """Host, first path part, first number and number of slashes of a catalogue name."""
    path = F.regexp_extract(name, r"^[a-z]+://[^/]+/([^?#]*)", 1)
    rest = [c for c in df.columns if c != name]
    return df.select(
        *rest,
        F.regexp_extract(name, r"^[a-z]+://([^/]+)", 1).alias("host"),
        F.split(path, "/")[0].alias("study"),
        F.regexp_extract(name, r"/([0-9]+)", 1).cast("long").alias("fin"),
        (F.length(name) - F.length(F.regexp_replace(name, "/", ""))).alias("parts"),
    )


def parse_wave_id(df: DataFrame, name: str = "waveID") -> DataFrame:
    """studyID, fin, date and number of parts of names like ``date_study_fin.h5``."""
    stem = F.split(F.col(name), r"\.")[0]
    parts = F.split(stem, "_")
    return df.withColumns(
        {
            "parts": F.length(name) - F.length(F.regexp_replace(name, "_", "")),
            "date_updated": F.try_to_timestamp(parts[0], F.lit("yyyyMMdd")).cast("timestamp_ntz"),
            "studyID": F.get(parts, F.lit(1)),
            "fin": F.get(parts, F.lit(2)).try_cast("long"),
        }
    )
