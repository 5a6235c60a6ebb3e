"""Missingness, imputation, scaling, selection and model metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, stats, windows
from .base import SAMPLES, query, read, samples

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: lineitem with nulls where the keys decide, and a column that is nearly always missing.
HOLES = """holes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS quantity, CASE WHEN l_suppkey % 4 <> 0 THEN l_extendedprice END AS price,
  CASE WHEN l_partkey % 2 = 0 THEN l_discount END AS discount, CASE WHEN l_partkey % 11 = 0 THEN l_tax END AS tax FROM lineitem)"""
COLUMNS = ["quantity", "price", "discount", "tax"]


def holes(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *NUMERIC)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_discount")).alias("discount"), F.when(F.col("l_partkey") % 11 == 0, F.col("l_tax")).alias("tax"),
    )


@query(
    f"""WITH {SAMPLES}, h AS (SELECT fin, channel, t, sample_id, CASE WHEN sample_id % 3 <> 0 THEN value END AS v FROM samples)
    SELECT sample_id, fin, channel, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY fin, channel
      ORDER BY t, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(v IGNORE NULLS) OVER (PARTITION BY fin, channel ORDER BY t, sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM h"""
)
def ffill_bfill(spark, sf_dir):
    """Missing values of each series filled forward, then backward."""
    s = samples(spark, sf_dir).withColumn("value", F.when(F.col("sample_id") % 3 != 0, F.col("value")))
    return windows.fill_both_ways(s, ["fin", "channel"], ["t", "sample_id"], ["value"]).select("sample_id", "fin", "channel", "value")


def report(c: str) -> str:
    return f"SELECT '{c}' AS feature, CAST(sum(CAST({c} IS NULL AS INT)) AS BIGINT) AS nulls, avg(CAST({c} IS NULL AS INT)) AS share FROM holes"


@query(
    f"WITH {HOLES} SELECT feature, nulls, round(share * 100, 2) AS missing_pct, CASE WHEN share <= 0.3 THEN 'Low' WHEN share <= 0.6 THEN 'Moderate' ELSE 'High' END AS risk FROM ({' UNION ALL '.join(map(report, COLUMNS))})"
)
def missing_report(spark, sf_dir):
    """Missing percentage and risk of each column."""
    return cleaning.missingness_report(holes(spark, sf_dir), COLUMNS)


@query(
    f"WITH {HOLES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity FROM holes WHERE (CAST(quantity IS NULL AS INT) + CAST(price IS NULL AS INT) + CAST(discount IS NULL AS INT)) / 3.0 <= 0.4"
)
def drop_sparse_cols_rows(spark, sf_dir):
    """Columns missing in 0.85 of the rows go, then rows missing more than 0.4, then columns missing in 0.15."""
    out, kept = cleaning.drop_sparse(holes(spark, sf_dir), COLUMNS, rows=0.4, then=0.1)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *kept)


@query(
    f"WITH {HOLES}, m AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in COLUMNS)
    + " FROM holes) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in COLUMNS)
    + " FROM holes, m"
)
def median_impute(spark, sf_dir):
    """Missing values become the median."""
    out = cleaning.median_impute(holes(spark, sf_dir), COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in COLUMNS})


@query(
    f"""WITH {HOLES}, q AS (SELECT quantity FROM holes WHERE quantity IS NOT NULL GROUP BY quantity ORDER BY count(*) DESC, quantity LIMIT 1), d AS (SELECT discount FROM holes WHERE discount IS NOT NULL GROUP BY discount ORDER BY count(*) DESC, discount LIMIT 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(holes.quantity, q.quantity) AS quantity, coalesce(holes.discount, d.discount) AS discount FROM holes, q, d"""
)
def mode_impute(spark, sf_dir):
    """Missing values become the most frequent one."""
    return cleaning.mode_impute(holes(spark, sf_dir), ["quantity", "discount"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "discount")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM lineitem"
        for c in NUMERIC
    )
)
def describe_exact(spark, sf_dir):
    """Count, mean, deviation and exact quartiles of each column."""
    out = stats.describe(read(spark, sf_dir, "lineitem", *NUMERIC), NUMERIC)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


#: price and net price are nearly the same thing.
WIDE = "wide AS (SELECT l_quantity AS a, l_extendedprice AS b, l_extendedprice * (1 - l_discount) AS c, l_tax AS d, l_quantity * 2 + l_tax AS e FROM lineitem)"
LETTERS = ["a", "b", "c", "d", "e"]
PAIRS = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{LETTERS[i]}' AS \"left\", '{LETTERS[j]}' AS \"right\", corr({LETTERS[i]}, {LETTERS[j]}) AS r FROM wide" for i in range(5) for j in range(i + 1, 5))


def wide(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", *NUMERIC)
    return li.select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("c"), F.col("l_tax").alias("d"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("e"))


@query(f'WITH {WIDE} SELECT i, j, "left", "right", round(r, 6) AS r FROM ({PAIRS})')
def corr_matrix_long(spark, sf_dir):
    """The upper triangle of the correlation matrix."""
    return stats.correlation_pairs(wide(spark, sf_dir), LETTERS).withColumn("r", F.round("r", 6))


@query(
    f"WITH {WIDE}, bad AS (SELECT DISTINCT \"right\" AS feature FROM ({PAIRS}) WHERE abs(r) > 0.9) SELECT position, feature, feature NOT IN (SELECT feature FROM bad) AS kept FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(LETTERS))}) v(position, feature)"
)
def corr_filter_greedy(spark, sf_dir):
    """Columns that correlate with an earlier one go."""
    return cleaning.correlation_filter(wide(spark, sf_dir), LETTERS, 0.9)


SCALED = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {a} AS l_quantity, {b} AS l_extendedprice FROM lineitem, (SELECT {s} FROM lineitem)"


def keyed(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(
    SCALED.format(a="round((l_quantity - m1) / s1, 6)", b="round((l_extendedprice - m2) / s2, 6)", s="avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2")
)
def standardize_pop(spark, sf_dir):
    """Zero mean and unit population deviation."""
    return cleaning.standardise(keyed(spark, sf_dir), NUMERIC[:2]).withColumns({c: F.round(c, 6) for c in NUMERIC[:2]})


@query(SCALED.format(a="round((l_quantity - a1) / (b1 - a1), 6)", b="round((l_extendedprice - a2) / (b2 - a2), 6)", s="min(l_quantity) AS a1, max(l_quantity) AS b1, min(l_extendedprice) AS a2, max(l_extendedprice) AS b2"))
def minmax_scale(spark, sf_dir):
    """Scaled to [0, 1]."""
    return cleaning.min_max(keyed(spark, sf_dir), NUMERIC[:2]).withColumns({c: F.round(c, 6) for c in NUMERIC[:2]})


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance, var_pop({c}) > 0.01 AS kept FROM lineitem" for c in NUMERIC))
def variance_filter(spark, sf_dir):
    """Variance of each column and whether it is kept."""
    return cleaning.variances(read(spark, sf_dir, "lineitem", *NUMERIC), NUMERIC).withColumn("variance", F.round("variance", 6))


@query(
    """WITH p AS (SELECT quality AS y, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS x FROM labels), c AS (SELECT y AS cls FROM p UNION SELECT x FROM p)
    SELECT cls, CAST(sum(CAST(y = cls AS INT)) AS BIGINT) AS support, CAST(sum(CAST(x = cls AND y = cls AS INT)) AS BIGINT) AS hits,
      CAST(sum(CAST(x = cls AS INT)) AS BIGINT) AS predicted,
    round(sum(CAST(x = cls AND y = cls AS INT)) / CAST(sum(CAST(x = cls AS INT)) AS DOUBLE), 6) AS precision,
      round(sum(CAST(x = cls AND y = cls AS INT)) / CAST(sum(CAST(y = cls AS INT)) AS DOUBLE), 6) AS recall,
    round(2 * sum(CAST(x = cls AND y = cls AS INT)) / CAST(sum(CAST(x = cls AS INT)) + sum(CAST(y = cls AS INT)) AS DOUBLE), 6) AS f1 FROM p, c GROUP BY cls"""
)
def confusion_prf(spark, sf_dir):
    """Precision, recall and F1 of each class."""
    rows = read(spark, sf_dir, "labels", "doc_id", "quality").withColumn("x", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return cleaning.confusion(rows, "quality", "x").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


FITTED = "fitted AS (SELECT l_extendedprice AS y, 1500 * l_quantity + 10000 AS p FROM lineitem)"


def fitted(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_extendedprice", "l_quantity").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity") + 10000).alias("p"))


@query(f"WITH {FITTED} SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(avg(abs(y - p)), 5) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) AS r2, round(corr(y, p), 8) AS pearson FROM fitted")
def regression_metrics(spark, sf_dir):
    """Errors and fit of a prediction."""
    out = cleaning.regression_metrics(fitted(spark, sf_dir), "y", "p")
    return out.select(F.round("mse", 2).alias("mse"), F.round("mae", 5).alias("mae"), F.round("r2", 8).alias("r2"), F.round("pearson", 8).alias("pearson"))


@query(f"WITH {FITTED} SELECT round(avg(y - p), 5) AS mean_diff, round(avg(y - p) - 1.96 * stddev_pop(y - p), 5) AS low, round(avg(y - p) + 1.96 * stddev_pop(y - p), 5) AS high FROM fitted")
def bland_altman(spark, sf_dir):
    """Limits of agreement of a prediction."""
    return cleaning.bland_altman(fitted(spark, sf_dir), "y", "p").select(*[F.round(c, 5).alias(c) for c in ("mean_diff", "low", "high")])


@query("SELECT event_id, CASE WHEN value > 200 THEN NULL ELSE value END AS value, TRY_CAST(CASE WHEN event_type = 'view' THEN ' ' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS charted FROM events")
def inf_nan_to_null(spark, sf_dir):
    """Infinite and undefined values as null; blanks in a number column as null."""
    e = read(spark, sf_dir, "events", "event_id", "event_type", "value")
    odd = F.when(F.col("value") > 300, F.lit(float("nan"))).when(F.col("value") > 200, F.lit(float("inf"))).otherwise(F.col("value"))
    charted = F.when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.col("event_id").cast("string"))
    return cleaning.to_null(e.withColumn("value", odd), ["value"]).select("event_id", "value", charted.try_cast("long").alias("charted"))


@query(f"WITH {HOLES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((CAST(quantity IS NULL AS INT) + CAST(price IS NULL AS INT) + CAST(discount IS NULL AS INT) + CAST(tax IS NULL AS INT)) / 4.0, 4) AS missing FROM holes")
def row_missing_share(spark, sf_dir):
    """Share of missing values in each row."""
    return holes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(cleaning.row_null_share(COLUMNS), 4).alias("missing"))
