"""Operator 9: quality by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams (``n`` bytes, ``2**bits`` buckets) are
counted in Spark: one over trusted target documents, one over all documents.  A
document's score is the mean log ratio of target to raw over its n-grams.  It
is kept if its score reaches the threshold, which is read off the scores of the
trusted documents: the first percentile less three times its distance to the
median.  No randomness takes part.

The target is every trusted document; the raw counts and the scores cover all
documents.  Texts are shuffled once to meet their ids, since the ids
grow with the table and are held by no task or driver as a whole.

Edge cases: null and empty texts have no words, fail the base rules and get
score 0.  Without trusted documents nothing is dropped by the score.  Repeated
rows are scored alike, ties at the threshold are kept, an empty table gives an
empty result, and extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import exact_quantiles
from .storage import stored
from .textkit import U64, Chunk, as_bytes, chunks, mix, span_hash, table

NGRAM = 4
BITS = 16
#: Fixed set of symbol characters.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def buckets(data: np.ndarray) -> np.ndarray:
    """The hashed bucket of the NGRAM bytes from each position of a chunk (its tail is filled with spaces)."""
    padded = np.concatenate([data, np.full(NGRAM - 1, 32, np.uint8)]).astype(U64)
    packed = np.zeros(len(data), U64)
    for i in range(NGRAM):
        packed = (packed << U64(8)) | padded[i : i + len(data)]
    return (mix(packed) >> U64(64 - BITS)).astype(np.int32)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with spaces behind each, so that no n-gram reaches into the next, and the first and the number of n-grams of each."""
    gap = b" " * (NGRAM - 1)
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(size + len(gap))[:-1]])
    return data, start, np.where(size > 0, size, 0)


def histograms(batches):
    """One row per bucket that occurs: n-grams over all documents of the task, and over its trusted ones."""
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch, texts in chunks(batches, "__text"):
        data, start, size = joined(texts)
        at = buckets(data)
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, start[size > 0], 1)
        np.add.at(inside, (start + size)[size > 0], -1)
        inside = np.cumsum(inside[:-1]) > 0
        raw += np.bincount(at[inside], minlength=1 << BITS)
        for i in np.flatnonzero(batch.column("__trusted").to_numpy(zero_copy_only=False)):
            target += np.bincount(at[start[i] : start[i] + size[i]], minlength=1 << BITS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", id_col: str = "doc_id") -> tuple[np.ndarray | None, DataFrame]:
    """Log ratios of target to raw by bucket, and the distinct ids of the target."""
    trusted = stored(trusted_ids.select(F.col(id_col).alias("__id")).where("__id is not null").distinct(), "target")
    marked = docs.select(F.col(id_col).alias("__id"), as_bytes(text).alias("__text")).join(trusted.withColumn("__hit", F.lit(True)).hint("shuffle_hash"), "__id", "left")
    counts = (
        marked.select(F.coalesce("__hit", F.lit(False)).alias("__trusted"), "__text")
        .mapInArrow(histograms, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    if not target.sum():
        return None, trusted
    smooth = 1e-7
    ratio = np.log(target / target.sum() + smooth) - np.log(raw / raw.sum() + smooth)
    return ratio.astype(np.float32), trusted


def measure(docs: DataFrame, ratio: np.ndarray | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document the counts of the base rules and the length-normalised log ratio."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        weights = held.value
        for batch, texts in chunks(batches, "__text"):
            values = base_counts(texts)
            score = np.zeros(len(texts))
            if weights is not None:
                data, start, size = joined(texts)
                some = np.flatnonzero(size)
                total = np.concatenate([[0], np.cumsum(weights[buckets(data)], dtype=np.float64)])
                score[some] = (total[start[some] + size[some]] - total[start[some]]) / size[some]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(x.astype(np.int64)) for x in values), pa.array(score)], [id_col, *names, "score"])

    schema = docs.select(id_col).schema
    for n in names:
        schema = schema.add(n, "long")
    return docs.select(id_col, as_bytes(text).alias("__text")).mapInArrow(run, schema.add("score", "double"))


def repeated_within(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does its hash occur twice or more in its document; did it occur earlier there."""
    order = np.lexsort((hashes, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twice, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def base_counts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    c = Chunk(texts)
    edges = np.stack([c.doc_start, c.doc_end], 1)

    def per_doc(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[edges[:, 1]] - total[edges[:, 0]]

    chars = per_doc(~c.gap & ((c.raw & 0xC0) != 0x80))
    symbols = per_doc(SYMBOLS[c.raw])
    ends = c.raw == 10
    ends[c.doc_end] = True
    stop = np.flatnonzero(ends)
    start = np.concatenate([[0], stop[:-1] + 1])
    doc = np.searchsorted(c.doc_end, stop)
    words = np.searchsorted(c.start, stop) > np.searchsorted(c.start, start)
    start, stop, doc = start[words], stop[words], doc[words]
    _, later = repeated_within(doc, span_hash(c.prefix, start, stop))
    dup_lines = np.bincount(doc[later], minlength=len(texts))
    gram, at = c.ngrams(5)
    twice, _ = repeated_within(c.doc[at], gram)
    cover = np.zeros(len(c.hash) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeat = c.sums(np.cumsum(cover[:-1]) > 0)
    return c.count, chars, symbols, dup_lines, repeat


def judge(measured: DataFrame, trusted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds base_failed, threshold and kept."""
    scores = measured.where("n_words > 0").select(id_col, "score").join(trusted, F.col(id_col) == F.col("__id"), "left_semi")
    marks = exact_quantiles(scores, ["score"], (0.01, 0.5)).first()
    threshold = None if marks is None else float(marks.q0 - 3 * (marks.q1 - marks.q0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = F.lit(True) if threshold is None else F.col("score") >= threshold
    return measured.withColumn("base_failed", failed).withColumn("threshold", F.lit(threshold).cast("double")).withColumn("kept", ~failed & good)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratio, trusted = fit(docs, labels.where("quality = 1"))
    return judge(stored(measure(docs, ratio), "quality"), trusted)
