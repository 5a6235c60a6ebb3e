"""Operator 2: k-d tree partitioning into shards of near equal bytes.

Rows with equal texts form a group with one point in metadata space: source and
language (their bytes behind the common prefix, as a number, so that the order
of names is kept), size and id.  A node is split along the dimension that is
widest relative to the whole table, at the weighted median of bytes.  The
medians of all nodes of a level are found together in Spark, by refining
histograms of ``BINS`` bins, with a hash of the group as tie breaker.  Splitting
ends when there are as many leaves as shards (or as bytes over
``target_bytes``).  Nodes and their medians stay in tables; the driver sees only
the table's bounds.

A group larger than a quarter of a shard would break the equal sizes; its rows
are dealt over pieces of a sixteenth of a shard by a hash of the id.

Edge cases: a null text has size 1 and the crc of the empty text, and forms a
group with other null texts; null metadata counts as its own value, below all
others, as does an id that is no number; repeated rows get slots of their own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import gapless
from .storage import stored
from .textkit import as_bytes, table

BINS = 4096
DIMS = ("__source", "__lang", "__log", "__row")
#: Bits of a coordinate and of the tie breaker behind it, and bytes of a name that count.
WIDE, TIE, NAME = 38, 23, 5
#: A cut is fine enough when the bin around the median holds this share of a shard.
FINE = 1e-4
NODE = ["__first", "__n"]


def name_code(column: str, low: str | None, high: str | None) -> Column:
    """A string as a number in the order of its bytes: the five behind the prefix that all values share."""
    begin = len(commonprefix([(low or "").encode(), (high or "").encode()]))
    digits = F.rpad(F.substring(F.hex(F.col(column).cast("string").cast("binary")), 2 * begin + 1, 2 * NAME), 2 * NAME, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long") + 1, F.lit(0))


def openings(atoms: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """For each node with several shards: the dimension to split, the weight wanted on its left, and the range of keys."""
    found = atoms.where("__n > 1").groupBy(*NODE).agg(F.sum("__weight").alias("__w"), *[f(d).alias(f"{k}{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))])
    width = [(F.col(f"hi{d}") - F.col(f"lo{d}")) / F.lit(max(1, bounds[d][1] - bounds[d][0])) for d in DIMS]
    widest = F.greatest(*width)
    dim = F.coalesce(*[F.when(w == widest, i) for i, w in enumerate(width)])
    of = lambda k: F.element_at(F.array(*[F.col(f"{k}{d}") for d in DIMS]), dim + 1)
    goal = F.col("__w") * F.floor(F.col("__n") / 2) / F.col("__n")
    return found.select(
        *NODE, dim.alias("dim"), goal.alias("goal"), (of("lo") * (1 << TIE)).alias("lo"), (of("hi") * (1 << TIE) + (1 << TIE) - 1).alias("hi"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("cut")
    )


def key_of() -> Column:
    return F.element_at(F.array(*DIMS), F.col("dim") + 1) * (1 << TIE) + F.col("__tie")


def narrowed(atoms: DataFrame, jobs: DataFrame, fine: float) -> DataFrame:
    """One step: each open range becomes what the bin with its median holds, or a cut where that is fine enough or one key alone."""
    wide = F.expr(f"(hi - lo) div {BINS} + 1")
    inside = atoms.join(jobs.withColumn("wide", wide), NODE).withColumn("__key", key_of()).where("__key between lo and hi")
    bins = inside.groupBy(*NODE, F.expr("(__key - lo) div wide").alias("bin")).agg(F.sum("__weight").alias("w"), F.min("__key").alias("a"), F.max("__key").alias("z"))
    upto = F.sum("w").over(Window.partitionBy(*NODE).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("upto", upto).join(jobs, NODE)
    # the first bin that reaches the goal
    row = F.struct("bin", "w", "upto", "a", "z")
    picked = bins.groupBy(*NODE, "dim", "goal", "before").agg(F.coalesce(F.min(F.when(F.col("before") + F.col("upto") >= F.col("goal"), row)), F.max(row)).alias("b"))
    after = F.col("before") + F.col("b.upto")
    less = after - F.col("b.w")
    ends = (F.col("b.w") <= fine) | (F.col("b.a") == F.col("b.z"))
    cut = F.when(F.abs(after - F.col("goal")) < F.abs(less - F.col("goal")), F.col("b.z") + 1).otherwise(F.col("b.a"))
    return picked.select(*NODE, "dim", "goal", F.col("b.a").alias("lo"), F.col("b.z").alias("hi"), less.cast("long").alias("before"), F.when(ends, cut).cast("long").alias("cut"))


def split(atoms: DataFrame, bounds: dict[str, tuple[int, int]], fine: float) -> DataFrame:
    """The atoms one level further down the tree."""
    jobs = stored(openings(atoms, bounds), "medians")
    cuts = []
    while not jobs.isEmpty():
        jobs = stored(narrowed(atoms, jobs, fine), "medians")
        cuts.append(jobs.where("cut is not null"))
        jobs = jobs.where("cut is null")
    done = atoms.where("__n = 1")
    if not cuts:
        return done
    found = cuts[0]
    for x in cuts[1:]:
        found = found.unionByName(x)
    half = F.floor(F.col("__n") / 2).cast("int")
    left = key_of() < F.col("cut")
    moved = atoms.where("__n > 1").join(found.select(*NODE, "dim", "cut"), NODE)
    moved = moved.withColumns({"__first": F.when(left, F.col("__first")).otherwise(F.col("__first") + half), "__n": F.when(left, half).otherwise(F.col("__n") - half)})
    return done.unionByName(moved.select(*atoms.columns))


def shard(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, text: str = "text", id_col: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """One row per document: id, size, text_crc32, shard and its gapless slot in the shard."""
    data = F.coalesce(as_bytes(text), F.lit(b""))
    size = F.length(data) + 1
    ends = docs.agg(*[f(F.col(c).cast("string")) for c in (source, lang) for f in (F.min, F.max)]).first()
    points = docs.select(
        F.col(id_col),
        size.cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.struct(F.xxhash64(text), F.crc32(data), size).alias("__group"),
        name_code(source, *ends[:2]).alias("__source"),
        name_code(lang, *ends[2:]).alias("__lang"),
        F.floor(F.log2(size) * (1 << 15)).cast("long").alias("__log"),
        F.coalesce(F.col(id_col).try_cast("long"), F.lit(-1)).alias("__row"),
    )
    points = stored(points, "points")
    n_rows, total, *edges = points.agg(F.count("*"), F.sum("size"), *[f(d) for d in DIMS for f in (F.min, F.max)]).first()
    if not n_rows:
        return points.select(id_col, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shards = shards or max(1, round(total / target_bytes))
    leaf = total / shards
    # at most 4 * shards groups are this large
    large = points.groupBy("__group").agg(F.sum("size").alias("w")).where(F.col("w") > leaf / 4)
    large = large.select(F.col("__group").alias("__big"), F.ceil(F.col("w") * 16 / leaf).cast("long").alias("__pieces"))
    points = points.join(F.broadcast(large), points["__group"] == large["__big"], "left")
    points = points.withColumn("__piece", F.pmod(F.xxhash64(id_col), F.coalesce("__pieces", F.lit(1)))).drop("__big", "__pieces")
    points = points.withColumn("__atom", F.struct("__group", "__piece"))
    atoms = points.groupBy("__atom").agg(F.sum("size").alias("__weight"), *[F.min(d).alias(d) for d in DIMS])
    bounds = {d: (edges[2 * i], edges[2 * i + 1]) for i, d in enumerate(DIMS)}
    for d, (low, high) in bounds.items():  # coordinates from 0 on, of WIDE bits at most
        atoms = atoms.withColumn(d, F.shiftright(F.col(d) - F.lit(low), max(0, (high - low).bit_length() - WIDE)))
    bounds = {d: (0, (high - low) >> max(0, (high - low).bit_length() - WIDE)) for d, (low, high) in bounds.items()}
    atoms = atoms.withColumns({"__tie": F.shiftrightunsigned(F.xxhash64("__atom"), 64 - TIE), "__first": F.lit(0), "__n": F.lit(shards)})
    atoms = stored(atoms, "atoms")
    for _ in range((shards - 1).bit_length()):
        atoms = stored(split(atoms, bounds, FINE * leaf), "atoms")
    placed = atoms.select(F.col("__atom").alias("__of"), F.col("__first").alias("shard"))
    joined = points.join(placed, points["__atom"] == placed["__of"]).select(id_col, "size", "text_crc32", "shard")
    return gapless(stored(joined, "placed"), "shard", [F.col(id_col), F.col("text_crc32")], n_rows, "slot")


def op2_kd_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
