"""Folds that hold every class in equal parts, and synthetic rows of the rarer classes (inventory M24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over
from ..sources.staging import staged
from .neighbours import neighbour_graph

#: Rows of a part that is numbered in one task, about.
PART_ROWS = 20_000


def chance(seed: int, *columns: str | Column) -> Column:
    """A number from 0 to 1, without 1, that the columns decide."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def class_ranks(df: DataFrame, row_id: str, label: str, seed: int, name: str = "rank") -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... over all rows, class by class, in random order inside a class.

    Classes are dealt to parts by a hash, so that a class of any size is numbered
    by many tasks; a part begins behind the parts before it (a row for each).
    """
    parts = max(1, -(-df.count() // PART_ROWS))
    part = F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(parts))
    dealt = df.withColumn("__part", part)
    sizes = dealt.groupBy(F.col(label).alias("__of"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__of", "__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("__of", "__p", before.alias("__before"))
    own = F.row_number().over(over([label, "__part"], [F.xxhash64(F.lit(seed + 1), row_id), row_id]))
    joined = dealt.withColumn("__own", own).join(begins, F.col(label).eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__part", "__p", "__of", "__own", "__before")


def stratified_folds(df: DataFrame, row_id: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: any two folds differ by one row at most, in every class and as a whole."""
    return class_ranks(df, row_id, label, seed, "__rank").withColumn("fold", (F.col("__rank") % folds).cast("int")).drop("__rank")


def with_synthetic(df: DataFrame, row_id: str, label: str, values: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows (row_id, copy, label, values): all rows, as copy 0, and synthetic ones that bring each class to the size of the largest.

    A synthetic row lies between a row and one of its k nearest of the same class,
    at a place that a hash decides; all rows of a class get as many, or one more.
    A class of one row is repeated.  ``row_id`` must be a distinct whole number.
    Rows without a class stay as they are.
    """
    rows = staged(df.select(F.col(row_id).cast("long").alias("id"), F.col(label).alias("cls"), F.col(values).cast("array<double>").alias("v")), "rows")
    sizes = {r.cls: r.n for r in rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n")).collect()}  # a row for each class
    out = rows.select("id", F.lit(0).alias("copy"), "cls", "v")
    for cls, n in sorted(sizes.items()):
        missing = max(sizes.values()) - n
        if missing:
            own = rows.where(F.col("cls") == F.lit(cls)).select("id", "cls", "v")
            many = F.lit(missing // n) + (F.col("rank") < missing % n).cast("int")
            copies = class_ranks(own, "id", "cls", seed).withColumn("many", many).where("many > 0")
            copies = copies.select("id", "cls", "v", F.explode(F.sequence(F.lit(1), F.col("many").cast("int"))).alias("copy"))
            near = neighbour_graph(own, "id", "v", k)
            near = near.join(own.select(F.col("id").alias("other"), F.col("v").alias("there")), "other").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "there"))).alias("near"))  # k at most
            chosen = copies.join(near, "id", "left")
            at = F.floor(chance(seed + 2, "id", "copy") * F.size("near")).cast("int")
            there = F.coalesce(F.get("near", at)["there"], F.col("v"))
            moved = F.zip_with("v", there, lambda a, b: a + (b - a) * F.col("share"))
            made = chosen.withColumn("share", chance(seed + 3, "id", "copy")).withColumn("v", moved)
            out = out.unionByName(made.select("id", "copy", "cls", "v"))
    return out.select(F.col("id").alias(row_id), "copy", F.col("cls").alias(label), F.col("v").alias(values))
