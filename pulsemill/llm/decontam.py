"""Operator 10: benchmark decontamination on canonical templates.

Every text becomes a sequence of canonical words: punctuation around a word is
cut and ASCII letters are lower-cased; numbers, names (a capital letter inside a
sentence) and units (a unit word after a number) become typed placeholders.
Windows of five canonical words are hash-joined with those of the benchmark
items.  Document tasks first drop the windows that hit none of the bits of a
fixed-size filter over the benchmark; the join decides.

For a (document, item, alignment) the slots are compared: an item value that
always meets the same document value is consistent.  A document contains an item
if consistent alignments with at least ``min_slots`` of consistent slot values
cover at least half of the item's windows, together, or if ``min_run`` words of a
longer item stand in it one after the other with the same slot values.  ``kind`` is
``exact`` when no slot value differs, else ``reparameterised``.

An item of fewer than five words can't be told from ordinary phrases: it is
found only where a whole text is that sequence.

Edge cases: null, empty and wordless texts match nothing, nor do such items;
windows of placeholders alone count only for items that have no others, and
match only with the same values; repeated documents are each reported once per id; equal items are each reported; empty tables on either
side give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitset import bitset, hit
from .storage import stored
from .textkit import STEP, U64, Chunk, as_bytes, chunks, mix, span_hash, table

WINDOW = 5
#: Fixed list of unit words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams ton tons lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts"
).split()

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:"]] = True
NUMBER, NAME, UNIT = U64(1), U64(2), U64(3)


def _unit_hashes() -> np.ndarray:
    c = Chunk([" ".join(UNITS).encode()])
    return np.sort(c.hash)


def canonical(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical word hashes, slot values (0 for a literal word) and the document of each word."""
    c = Chunk(texts, lower=True)
    letter, digit = LETTER[c.raw], DIGIT[c.raw]
    kept = letter | digit
    place = np.flatnonzero(kept)
    before = np.concatenate([[0], np.cumsum(kept)])
    some = before[c.end] > before[c.start]
    start, end, doc = c.start[some], c.end[some], c.doc[some]
    first, last = place[before[start]], place[before[end] - 1] + 1
    literal = span_hash(c.prefix, first, last)
    letters, digits = np.concatenate([[0], np.cumsum(letter)]), np.concatenate([[0], np.cumsum(digit)])
    number = (digits[last] > digits[first]) & (letters[last] == letters[first])
    head, second = c.raw[first], c.raw[np.minimum(first + 1, len(c.raw) - 1)]
    capital = CAPITAL[head] | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    lines = np.concatenate([[0], np.cumsum(c.raw == 10)])
    opens = np.ones(len(start), bool)
    opens[1:] = STOP[c.raw[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1]]) | (doc[1:] != doc[:-1])
    name = capital & ~opens & ~number
    follows = np.zeros(len(start), bool)
    follows[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = follows.copy()
    at = np.flatnonzero(follows)
    unit[at] = np.isin(literal[at], _unit_hashes())
    canon = literal.copy()
    for mask, kind in ((name, NAME), (number, NUMBER), (unit, UNIT)):
        canon[mask] = kind
    return canon, np.where(number | name | unit, literal, U64(0)), doc


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, position and slot values (a column per word) of each template window.

    A text of one to four canonical words has one window: all its words.
    """
    canon, slot, doc = canonical(texts)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    size = max(0, len(canon) - WINDOW + 1)
    acc = np.zeros(size, U64)
    for i in range(WINDOW):
        acc *= STEP
        acc += mix(canon[i : i + size])
    at = np.flatnonzero(doc[:size] == doc[WINDOW - 1 :]) if size else np.empty(0, np.int64)
    slots = np.stack([slot[i : i + size][at] for i in range(WINDOW)], 1) if size else np.empty((0, WINDOW), U64)
    hashes, docs, pos = mix(acc[at]), doc[at], at - first[doc[at]]
    bare = np.flatnonzero((slots != 0).all(axis=1))
    plain = np.zeros(len(bare), U64)
    for i in range(WINDOW):
        plain = plain * STEP + mix(slots[bare, i])
    hashes[bare] = mix(plain)
    short = np.flatnonzero((count > 0) & (count < WINDOW))
    if len(short):
        whole, own = np.empty(len(short), U64), np.zeros((len(short), WINDOW), U64)
        for k, d in enumerate(short):
            h = U64(count[d])
            for j in range(count[d]):
                h = mix(np.array([h]) * STEP + mix(canon[first[d] + j : first[d] + j + 1]))[0]
                own[k, j] = slot[first[d] + j]
            whole[k] = h
        hashes, docs = np.concatenate([hashes, whole]), np.concatenate([docs, short])
        pos, slots = np.concatenate([pos, np.zeros(len(short), np.int64)]), np.concatenate([slots, own])
    return hashes, docs, pos, slots


def emit(ids: pa.Array, texts: list[bytes], keep: np.ndarray | None) -> pa.RecordBatch:
    hashes, docs, pos, slots = windows(texts)
    if keep is not None:
        some = hit(keep, hashes)
        hashes, docs, pos, slots = hashes[some], docs[some], pos[some], slots[some]
    flat = pa.array(np.ascontiguousarray(slots).view(np.int64).reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * WINDOW), flat)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(docs)), pa.array(hashes.view(np.int64)), pa.array(pos.astype(np.int32)), lists], ["id", "hash", "pos", "slots"])


def template_windows(df: DataFrame, id_col: str, text: str, keep=None) -> DataFrame:
    """Rows (id, hash, pos, slots) of a table's template windows; with ``keep``, of those that may be in the filter."""

    def run(batches):
        bits = None if keep is None else keep.value
        for batch, texts in chunks(batches, "__text"):
            yield emit(batch.column("__id"), texts, bits)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("__id"), as_bytes(text).alias("__text")).mapInArrow(run, f"id {kind}, hash long, pos int, slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", min_cover: float = 0.5, min_slots: float = 0.8, min_run: int = 13) -> DataFrame:
    """One row per (document, item) found: n_windows, coverage, n_slots, n_changed, kind."""
    items = stored(template_windows(benchmark, item_col, item_text).withColumnsRenamed({"id": "__item", "pos": "__ipos", "slots": "__islots", "hash": "__hash"}), "items")
    bare = F.forall("__islots", lambda x: x != 0)
    others = items.groupBy("__item").agg(F.min(bare.cast("int")).alias("__all_bare"))
    items = items.join(others, "__item").where((F.col("__all_bare") == 1) | ~bare).drop("__all_bare")
    sizes = items.groupBy("__item").agg(F.count_distinct("__ipos").alias("__windows"))
    found = template_windows(docs, id_col, text, bitset(items, "__hash"))
    hits = found.join(items, found["hash"] == items["__hash"]).select("id", "__item", "__ipos", (F.col("pos") - F.col("__ipos")).alias("__shift"), "slots", "__islots")
    # per alignment: the item windows found, and each item value with the document value it met
    pairs = F.expr("filter(arrays_zip(__islots, slots), x -> x.__islots != 0)")
    aligned = hits.groupBy("id", "__item", "__shift").agg(F.collect_set("__ipos").alias("__found"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("__pairs"))
    values = F.array_distinct(F.expr("transform(__pairs, x -> x.__islots)"))
    steady = F.expr("size(filter(array_distinct(transform(__pairs, x -> x.__islots)), v -> size(filter(__pairs, x -> x.__islots = v)) = 1))")
    changed = F.expr("size(filter(__pairs, x -> x.__islots != x.slots))")
    checked = aligned.withColumn("__n", F.size(values)).withColumn("__steady", steady).withColumn("__changed", changed).where(F.col("__steady") >= min_slots * F.col("__n"))
    # the longest stretch of consecutive windows
    begin = F.struct(F.lit(-2).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(x == acc["at"] + 1, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("at"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    stretch = F.when(F.col("__changed") == 0, F.aggregate(F.array_sort("__found"), begin, step, lambda acc: acc["best"])).otherwise(0)
    by_item = checked.withColumn("__run", stretch).groupBy("id", "__item").agg(
        F.max("__run").alias("__run"),
        F.size(F.array_distinct(F.flatten(F.collect_list("__found")))).alias("n_windows"), F.max("__n").alias("n_slots"), F.min("__changed").alias("n_changed")
    )
    out = by_item.join(sizes, "__item").withColumn("coverage", F.col("n_windows") / F.col("__windows"))
    out = out.where((F.col("coverage") >= min_cover) | (F.col("__run") >= max(1, min_run - WINDOW + 1)))
    kind = F.when(F.col("n_changed") == 0, "exact").otherwise("reparameterised")
    return out.select(F.col("id").alias(id_col), F.col("__item").alias(item_col), "n_windows", "coverage", "n_slots", "n_changed", kind.alias("kind"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
