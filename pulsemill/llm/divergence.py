"""Operator 12: audit of how far the sources of a language differ in their words.

Texts are split into terms (runs of ASCII letters and of characters beyond ASCII,
A-Z lower-cased); each language keeps the terms in at least ``least_docs`` of its
documents.  A group (lang, source) gives a kept term the weight
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two weights differ by
f(p, q) = floor((p - q)^2 / (p + q)).

The work is done by DuckDB on shards of (lang, term), dealt by a hash:

1. map tasks count the terms of chunks of texts by document, then by group;
2. shards add these counts up, as they stream in, and keep the frequent terms;
3. shards of kept terms sum f over the terms that two sources share, count each
   source's terms by weight, and rank each source's terms against its language.

A source without a term has the weight p0, the same for all such terms.  So a
pair's sum is V f(p0, q0), plus what each side's own terms change (from the counts
by weight), plus what shared terms change again (the partial sums): no shard needs
a row for a term that a source hasn't got.  Spark adds the parts up and ranks them.

Edge cases: null text, lang and source are ''; repeated rows are documents of
their own; a language without kept terms has pairs of value 0 and no terms; a
language of one source has no pairs; ties are ranked by the bytes of the item; very
long texts are counted as a whole, as one chunk; an empty table gives an empty
result; extra columns are ignored.  All arithmetic is exact: weights are divided
in 128 bits, sums are 64-bit and overflow is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .textkit import as_bytes, chunks, table

LEAST_DOCS, TOP = 10, 10
#: Bytes of text that a map task counts at a time, and rows that a shard takes in at a time.
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 200_000
#: Kept rows of a shard, about.
SHARD_ROWS = 400_000

#: Letters and bytes beyond ASCII stay, A-Z are lowered, all others part terms.
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"
BY_GROUP = """WITH c AS (SELECT doc, term, count(*) AS n FROM words GROUP BY doc, term)
    SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM c JOIN heads USING (doc) GROUP BY lang, source, term"""
ADDED = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM rows GROUP BY lang, source, term"

KEPT = "lang string, source string, term string, n long, total long, leads boolean"
FREQUENT = """WITH k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total, min(source) AS first FROM rows GROUP BY lang, term HAVING sum(docs) >= {least})
    SELECT lang, source, term, n, total, source = first AS leads FROM rows JOIN k USING (lang, term)"""

PARTS = "part string, lang string, source string, item string, weight long, value long"
WEIGHED = """CREATE OR REPLACE TEMP TABLE k AS SELECT lang, source, term,
      CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (size + 2 * terms) AS BIGINT) AS p,
      CAST(1 + CAST(2000000000 AS HUGEINT) // (size + 2 * terms) AS BIGINT) AS p0,
      CAST(1 + (CAST(1000000000 AS HUGEINT) * (total + 2)) // (whole + 2 * terms) AS BIGINT) AS q FROM rows"""
#: Of the terms that two sources share: what the pair's sum has more than its sides' own changes say.
SHARED = """SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CAST(NULL AS BIGINT) AS weight,
      CAST(sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0)) AS BIGINT) AS value
    FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source"""
BY_WEIGHT = "SELECT 'bar' AS part, lang, source, CAST(NULL AS VARCHAR) AS item, p AS weight, count(*) AS value FROM k GROUP BY lang, source, p"
RANKED = """SELECT 'term' AS part, lang, source, term AS item, CAST(NULL AS BIGINT) AS weight, f(p, q) AS value FROM k WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {top}"""


def connection():
    """DuckDB inside a task: one thread, and nothing on the machine's disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "512MB"})


def asked(con, sql: str, **tables: pa.Table) -> pa.Table:
    """The rows of a statement over Arrow tables."""
    for name, rows in tables.items():
        con.register(name, rows)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def gathered(batches: Iterable[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """The batches as tables of about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def chunk_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of each chunk of texts."""
    con = connection()
    held: list[tuple[pa.RecordBatch, list[bytes]]] = []
    size = 0

    def counted() -> pa.Table:
        words, many = [], []
        for _, texts in held:
            for text in texts:
                own = text.translate(SPLIT).split()
                words += own
                many.append(len(own))
        heads = pa.Table.from_batches([x for x, _ in held]).select(["lang", "source"]).append_column("doc", pa.array(np.arange(len(many))))
        rows = pa.table({"doc": np.repeat(np.arange(len(many)), many), "term": pa.array(words, pa.binary()).cast(pa.string())})
        return asked(con, BY_GROUP, words=rows, heads=heads)

    for batch, texts in chunks(batches, "text", CHUNK_BYTES):
        held.append((batch, texts))
        size += sum(map(len, texts))
        if size >= CHUNK_BYTES:
            yield from counted().to_batches()
            held, size = [], 0
    if held:
        yield from counted().to_batches()


def kept_terms(least: int):
    """A shard's frequent terms: rows (lang, source, term, n, total of the language, is it the first of its term)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        rows, waiting, n = None, [], 0
        for part in gathered(batches):
            waiting.append(part)
            n += len(part)
            if n >= max(CHUNK_ROWS, len(rows or ()) // 2):  # so that the sum of all merges stays linear
                rows = asked(con, ADDED, rows=pa.concat_tables([*([rows] if rows else []), *waiting]))
                waiting, n = [], 0
        if waiting:
            rows = asked(con, ADDED, rows=pa.concat_tables([*([rows] if rows else []), *waiting]))
        if rows is not None:
            yield from asked(con, FREQUENT.format(least=least), rows=rows).to_batches()

    return run


def shard_parts(top: int):
    """A shard's partial sums of pairs, its terms by weight, and each source's first terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            con = connection()
            con.execute("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q)")
            con.register("rows", pa.Table.from_batches(held))
            con.execute(WEIGHED)
            for sql in (SHARED, BY_WEIGHT, RANKED.format(top=top)):
                yield from con.sql(sql).to_arrow_table().to_batches()

    return run


def apart(p: Column, q: Column) -> Column:
    """f(p, q) as a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank)."""
    spark = docs.sparkSession
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(own(lang).alias("lang"), own(source).alias("source"), F.coalesce(as_bytes(text), F.lit(b"")).alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(width, docs.rdd.getNumPartitions())  # a shard for each split of the scan at least, so that shards don't grow with the input
    counted = docs.mapInArrow(chunk_counts, COUNTED).repartition(shards, "lang", "term")
    kept = stored(counted.mapInArrow(kept_terms(least_docs), KEPT), "terms")

    langs = kept.groupBy("lang").agg(F.count_if("leads").alias("terms"), F.sum(F.when(F.col("leads"), F.col("total"))).alias("whole"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["terms", "whole", "size"])
    groups = stored(groups, "groups")
    rows = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "total", "size", "terms", "whole")
    shards = max(width, -(-kept.count() // SHARD_ROWS))
    parts = stored(rows.repartition(shards, "lang", "term").mapInArrow(shard_parts(top), PARTS), "parts")

    # V f(p0, q0), what each side's own terms change, and what shared terms change again
    bars = parts.where("part = 'bar'").groupBy("lang", "source", "weight").agg(F.sum("value").alias("n"))
    bars = bars.groupBy("lang", "source").agg(F.collect_list(F.struct("weight", "n")).alias("bars"))  # a row for each count that occurs
    none = F.lit(1) + F.expr("2000000000L div nullif(size + 2 * terms, 0)")
    sides = groups.select("lang", "source", "terms", none.alias("none")).join(bars, ["lang", "source"], "left")
    left = sides.select("lang", "source", "terms", F.col("none").alias("p0"), F.col("bars").alias("ps"))
    right = sides.select("lang", F.col("source").alias("item"), F.col("none").alias("q0"), F.col("bars").alias("qs"))
    changes = lambda bars, own, other: F.coalesce(
        F.aggregate(bars, F.lit(0).cast("long"), lambda a, x: a + x["n"] * (apart(x["weight"], F.col(other)) - apart(F.col(own), F.col(other)))), F.lit(0)
    )
    shared = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("shared"))
    shared = shared.union(shared.select("lang", "item", "source", "shared"))
    pairs = left.join(right, "lang").where("source <> item").join(shared, ["lang", "source", "item"], "left")
    value = F.col("terms") * apart(F.col("p0"), F.col("q0")) + changes("ps", "p0", "q0") + changes("qs", "q0", "p0") + F.coalesce("shared", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("terms") > 0, value).otherwise(0).cast("long").alias("value"))
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(terms).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
