"""Operator 7: near duplicates by circulant MinHash with exact verification.

Shingles are five lower-cased words (a shorter text is one shingle).  Two
permutations make every signature coordinate: shingle hashes are the first, and
coordinate k is the least value of the second over the hashes circularly
shifted k times.  Documents with equal shingle sets form a class, and only
classes go on.  Coordinates are grouped into bands; classes that share a band
are candidates; a candidate link is confirmed on the full shingle sets.

Candidates are tried in two rounds, so that a group of near copies does not
become all of its pairs: first each class with the least one of its bucket, then
those pairs of a bucket that are still in different components and, by their
sizes and the shingles that no other class has, can reach the threshold.  After
that each candidate pair is tested, already connected or out of reach, so no
component depends on an untested candidate; see ``BANDS`` for the share of linked
pairs that are no candidates (and of these most are connected through others).

Edge cases: texts without words have no shingles and are linked with nothing;
null ids keep their row, with a null component; repeated rows share a class; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitset import bitset, hit
from .components import components
from .storage import stored
from .textkit import STEP, U64, Chunk, as_bytes, chunks, mix, table

SHINGLE = 5
#: A pair at the similarity s shares no band with the probability (1 - s**ROWS)**BANDS: 3.5e-3 at 0.8, 1.3e-4 at 0.85, 3e-7 at 0.9.
BANDS, ROWS = 24, 7


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by document, and how many each document has.

    The document's place in the chunk takes the upper bits during the sort, so
    48 bits or more of each hash remain; they are scrambled again afterwards.
    """
    c = Chunk(texts, lower=True)
    gram, at = c.ngrams(SHINGLE)
    doc = c.doc[at]
    short = np.flatnonzero((c.count > 0) & (c.count < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), U64)
        for k, d in enumerate(short):
            h = np.array([c.count[d]], U64)
            for x in c.hash[c.first[d] : c.first[d] + c.count[d]]:
                h = mix(h * STEP + x)
            whole[k] = h[0]
        gram, doc = np.concatenate([gram, whole]), np.concatenate([doc, short])
    bits = max(1, int(len(texts)).bit_length())
    low = U64((1 << (64 - bits)) - 1)
    packed = (doc.astype(U64) << U64(64 - bits)) | (gram & low)
    packed.sort()
    keep = np.ones(len(packed), bool)
    keep[1:] = packed[1:] != packed[:-1]
    packed = packed[keep]
    sizes = np.bincount((packed >> U64(64 - bits)).astype(np.int64), minlength=len(texts))
    # a set must not depend on the chunk it was in: 44 bits are the same everywhere
    return mix(packed & U64((1 << 44) - 1)), sizes


def circulant(shingles: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Signature coordinates (a row each) of the sets that begin at ``starts``."""
    base = (shingles >> U64(32)).astype(np.uint32)
    out = np.empty((coordinates, len(starts)), np.uint32)
    x, t = np.empty_like(base), np.empty_like(base)
    for k in range(coordinates):
        np.add(base, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=x)  # the circular shift of the universe
        np.right_shift(x, 16, out=t)
        x ^= t
        x *= np.uint32(0x7FEB352D)
        np.right_shift(x, 15, out=t)
        x ^= t
        x *= np.uint32(0x846CA68B)
        np.minimum.reduceat(x, starts, out=out[k])
    return out


def signatures(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Rows (id, n_shingles, set_hash, bands)."""

    def run(batches):
        for batch, texts in chunks(batches, "__text"):
            shingles, sizes = shingle_sets(texts)
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            keys, whole = np.zeros((len(texts), BANDS), np.int64), np.zeros(len(texts), U64)
            if len(some):
                coords = circulant(shingles, starts, BANDS * ROWS)
                for b in range(BANDS):
                    h = np.full(len(some), b + 1, U64)
                    for row in coords[b * ROWS : (b + 1) * ROWS]:
                        h = mix(h * STEP + row)
                    keys[some, b] = h.view(np.int64)
                whole[some] = mix(np.add.reduceat(mix(shingles), starts)) ^ np.bitwise_xor.reduceat(shingles, starts)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(sizes.astype(np.int64)), pa.array(whole.view(np.int64)), bands], ["id", "n_shingles", "set_hash", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), as_bytes(text).alias("__text")).mapInArrow(run, f"id {kind}, n_shingles long, set_hash long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, text: str, id_col: str) -> DataFrame:
    """Rows (id, shingles) for the ids in ``wanted``; others are left out by a filter of fixed size before any shuffle."""
    held = bitset(wanted.select(F.xxhash64("id").alias("h")), "h")

    def run(batches):
        for batch in batches:
            some = hit(held.value, batch.column("__at").to_numpy().view(U64))
            for part, texts in chunks([batch.filter(pa.array(some))], "__text"):
                shingles, sizes = shingle_sets(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offsets, pa.array(shingles.view(np.int64)))], ["id", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), as_bytes(text).alias("__text")).where("id is not null").withColumn("__at", F.xxhash64("id"))
    return source.mapInArrow(run, f"id {kind}, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def open_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components in a bucket that can reach the threshold.

    A shingle that no other open class has can't be common, so with ``s`` of its
    ``n`` shingles left a class reaches the threshold only with classes of at
    most ((100 + percent) * s - percent * n) / percent shingles.  Every class
    outside its bucket's largest component looks up the sizes it can be linked
    with; of two components in a bucket, one at least is not the largest.
    """
    reps = open_.select(F.col("rep").alias("id")).distinct()
    single = sets.join(reps, "id", "left_semi").select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("m"), F.min("id").alias("rep")).where("m = 1")
    single = single.groupBy("rep").agg(F.count("*").alias("u"))
    n = F.col("n_shingles")
    most = F.floor(((100 + percent) * (n - F.coalesce("u", F.lit(0))) - percent * n) / percent)
    bound = open_.join(single, "rep", "left").withColumn("lo", F.ceil(n * percent / 100)).withColumn("hi", F.least(F.floor(n * 100 / percent), most))
    bound = stored(bound.where("lo <= hi").drop("u"), "bounds")
    cell = lambda x: F.floor(F.log(x) / np.log(1.02)).cast("int")
    major = bound.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("major"))
    # a pair is made once: in its first common bucket, by the one that isn't in the largest component or has the smaller id
    keys = bound.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    bound = bound.join(major, "key").join(keys, "rep").withColumn("is_major", F.col("c") == F.col("major"))
    x = bound.where(~F.col("is_major")).select("key", F.col("rep").alias("a"), n.alias("na"), F.col("c").alias("ca"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.col("keys").alias("ka"))
    x = x.withColumn("cell", F.explode(F.sequence(cell(F.col("la")), cell(F.col("ha")))))
    y = bound.select("key", F.col("rep").alias("b"), n.alias("nb"), F.col("c").alias("cb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.col("keys").alias("kb"), F.col("is_major").alias("mb"), cell(n).alias("cell"))
    fits = (F.col("ca") != F.col("cb")) & F.col("nb").between(F.col("la"), F.col("ha")) & F.col("na").between(F.col("lb"), F.col("hb")) & (F.col("mb") | (F.col("a") < F.col("b")))
    once = F.array_min(F.array_intersect("ka", "kb")) == x.key
    return x.join(y, (x.key == y.key) & (x.cell == y.cell) & fits & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. Links need ``percent`` of the union in common."""
    signed = stored(signatures(docs, text, id_col), "signatures")
    classes = stored(signed.where("n_shingles > 0").groupBy("set_hash", "n_shingles").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")).where("rep is not null"), "classes")
    members = stored(classes.select("rep", "n_shingles", F.explode("bands").alias("key")), "members")
    shared = members.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("a")).where("m > 1")
    near = lambda x, y: (F.least(x, y) * 100) >= (F.greatest(x, y) * percent)  # noqa: E731  a link needs like sizes
    sizes = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"))
    in_bucket = stored(members.join(shared.select("key", "a"), "key"), "buckets")
    stars = in_bucket.where("rep > a").select("a", F.col("rep").alias("b"), F.col("n_shingles").alias("nb")).distinct().join(sizes, "a").where(near(F.col("na"), F.col("nb"))).select("a", "b")
    stars = stored(stars, "stars")
    # the sets of every class in a shared bucket: the second round needs them too
    wanted = in_bucket.select(F.col("rep").alias("id")).distinct()
    sets = stored(sets_of(docs, wanted, text, id_col), "sets")
    links = stored(verified(stars, sets, percent), "links")
    first = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = in_bucket.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("c"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    open_ = placed.join(mixed, "key")
    rest = open_pairs(stored(open_, "open"), sets, percent)
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    more = verified(rest, sets, percent)
    final = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more.select("a", "b")))
    by_class = classes.select("set_hash", "n_shingles", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select(F.col("set_hash").alias("h"), F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component"))
    joined = signed.join(by_class, (signed.set_hash == by_class.h) & (signed.n_shingles == by_class.n), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
