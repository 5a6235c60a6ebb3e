"""Training-corpus pipeline: language ID, near-duplicate removal, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor
kept.  All but the last return the columns of ``documents``; the last returns
one row per packed sequence.

Edge cases: null and empty texts have no letter and go in the first stage; of
repeated rows the second keeps one; ties go to the least id; an empty table gives
an empty result; other columns than those of ``documents`` are left out.
"""

from pyspark.sql import functions as F

from pulsemill.llm import decontam, langid, neardup, packing, pii
from pulsemill.llm.storage import stored
from pulsemill.llm.textkit import small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark, docs, sf_dir):
    """Documents whose language is recognised; texts without a letter or far from every known language go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return langid.predict(docs, langid.fit(docs), keep=list(COLUMNS)).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates (a Jaccard similarity of 0.8 or more), the one with the least id."""
    gone = neardup.near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item, neither as it is nor with other numbers, names or units."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def pseudonyms(spark, docs, sf_dir):
    """All documents, with validated numbers, dates, addresses and secrets replaced by pseudonyms."""
    return pii.pseudonymise(docs.select(*COLUMNS), key=pii.session_key(spark), spans=None).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark, docs, sf_dir):
    """One row per sequence with its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("packing", packed)]
#: The stages' models and candidate searches can't be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``; each reads its predecessor's result from a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
