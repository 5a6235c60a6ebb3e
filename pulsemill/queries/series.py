"""Per-series statistics and point-wise signal operators on the samples of each encounter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import signals, stats, windows
from .base import SAMPLES, query, read, samples

#: Segments of 120 hours, six of them, counted back from the last error.
HOURS, SEGMENTS = 120, 6
WIDTH = HOURS * 3_600_000_000

SEGMENTED = f"""{SAMPLES},
onset AS (SELECT fin, max(t) AS onset FROM samples WHERE channel = 'error' GROUP BY fin),
segmented AS (
  SELECT s.fin, s.channel, s.t, s.value, s.sample_id, CAST(floor((o.onset - s.t) / {WIDTH}) AS BIGINT) AS segment
  FROM samples s JOIN onset o ON s.fin = o.fin WHERE s.t < o.onset AND s.t >= o.onset - {WIDTH * SEGMENTS})"""

STATS_SQL = """
WITH {source},
a AS (SELECT {keys}, value AS v, row_number() OVER (PARTITION BY {keys} ORDER BY t, sample_id) - 1 AS i,
        lag(value) OVER (PARTITION BY {keys} ORDER BY t, sample_id) AS prev, row_number() OVER (PARTITION BY {keys} ORDER BY value) AS rk,
        count(*) OVER k AS n, avg(value) OVER k AS m, min(value) OVER k AS lo, max(value) OVER k AS hi, quantile_cont(value, 0.5) OVER k AS med
      FROM {rows} WINDOW k AS (PARTITION BY {keys})),
b AS (SELECT *, CASE WHEN hi > lo THEN least(floor((v - lo) * least(10, n) / (hi - lo)), least(10, n) - 1) ELSE 0 END AS bin,
        v - least(lo, 0.0) + 1e-7 AS x FROM a),
h AS (SELECT {keys}, -sum(c / n * ln(c / n)) AS entropy FROM (SELECT {keys}, bin, CAST(count(*) AS DOUBLE) AS c, max(n) AS n FROM b GROUP BY {keys}, bin) GROUP BY {keys})
SELECT {picked} FROM (
SELECT {bkeys}, avg(v) AS mean, max(med) AS median, stddev_pop(v) AS std, avg(abs(v - med)) AS mad,
  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75,
  CASE WHEN max(v) > min(v) THEN avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) END AS skewness,
  CASE WHEN max(v) > min(v) THEN avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 END AS kurtosis,
  CASE WHEN count(*) > 1 THEN max(h.entropy) END AS entropy,
  CASE WHEN count(*) > 1 THEN (avg(v * i) - avg(v) * avg(i)) / nullif(avg(i * i) - avg(i) * avg(i), 0) END AS slope,
  CASE WHEN count(*) > 1 THEN sum((prev - m) * (v - m)) / nullif(sum((v - m) * (v - m)), 0) END AS autocorr_lag1,
  CASE WHEN count(*) > 1 THEN 2 * sum(rk * x) / (count(*) * sum(x)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) END AS gini_index,
  count(*) AS valid_n
FROM b JOIN h USING ({keys}) GROUP BY {bkeys})
"""
ROUNDED = "mean median std mad iqr min max p25 p75 skewness kurtosis entropy slope autocorr_lag1 gini_index".split()


def stats_sql(source: str, rows: str, keys: list[str], picked: list[str]) -> str:
    columns = ", ".join(keys + [f"round({p}, 8) AS {p}" if p in ROUNDED else p for p in picked])
    return STATS_SQL.format(source=source, rows=rows, keys=", ".join(keys), bkeys=", ".join(keys), picked=columns)


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def segmented(spark, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    onset = s.where("channel = 'error'").groupBy("fin").agg(F.max("t").alias("onset"))
    return windows.backward_segments(s, onset, "fin", "t", "onset", WIDTH, SEGMENTS)


@query(stats_sql(SEGMENTED, "segmented", ["fin", "segment"], [*ROUNDED, "valid_n"]))
def series_stats_16(spark, sf_dir):
    """Sixteen statistics of each backward window of each encounter."""
    return rounded(stats.series_stats(segmented(spark, sf_dir), ["fin", "segment"], ["t", "sample_id"]), *ROUNDED)


def one(name: str, statistics: list[str]):
    @query(stats_sql(SAMPLES, "samples", ["fin", "channel"], statistics), name)
    def run(spark, sf_dir):
        out = stats.series_stats(samples(spark, sf_dir), ["fin", "channel"], ["t", "sample_id"], statistics=statistics)
        return rounded(out, *[s for s in statistics if s in ROUNDED])

    return run


hist_entropy = one("hist_entropy", ["entropy", "valid_n"])
gini_index = one("gini_index", ["gini_index", "valid_n"])
autocorr_lag1 = one("autocorr_lag1", ["autocorr_lag1", "valid_n"])
trend_slope = one("trend_slope", ["slope", "valid_n"])


@query(
    stats_sql(SAMPLES, "samples", ["fin", "channel"], ["mean", "std", "valid_n"]).join(
        ["WITH long AS (", """) SELECT fin, """ + ", ".join(f"max(CASE WHEN channel = '{c}' THEN {s} END) AS {c}_{s}" for c in ("click", "error") for s in ("mean", "std", "valid_n")) + " FROM long GROUP BY fin"]
    )
)
def wide_feature_contract(spark, sf_dir):
    """Long statistics as one wide row per encounter with fixed columns."""
    names = ["mean", "std", "valid_n"]
    long_ = rounded(stats.series_stats(samples(spark, sf_dir), ["fin", "channel"], ["t", "sample_id"], statistics=names), "mean", "std")
    return stats.wide_stats(long_, ["fin"], "channel", ["click", "error"], names)


@query(
    f"""WITH {SAMPLES}, a AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, quantile_cont(value, 0.5) OVER w AS med FROM samples WINDOW w AS (PARTITION BY fin))
    SELECT sample_id, fin, CASE WHEN abs(value - m) > 2 * sd THEN round(med, 6) ELSE value END AS value, abs(value - m) > 2 * sd AS clipped FROM a"""
)
def sigma_clip_to_median(spark, sf_dir):
    """Values more than two deviations from their series' mean become its median."""
    out = signals.sigma_clip(samples(spark, sf_dir), ["fin"], "value", 2.0)
    return out.select("sample_id", "fin", F.when(F.col("clipped"), F.round("value", 6)).otherwise(F.col("value")).alias("value"), "clipped")


@query(
    """WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b, quantile_cont(l_extendedprice, 0.25) AS c, quantile_cont(l_extendedprice, 0.75) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) THEN l_quantity END AS l_quantity,
    CASE WHEN l_extendedprice BETWEEN c - 0.5 * (d - c) AND d + 0.5 * (d - c) THEN l_extendedprice END AS l_extendedprice FROM lineitem, q"""
)
def iqr_outlier_null(spark, sf_dir):
    """Values outside the quartiles by more than half an interquartile range become null."""
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return signals.iqr_to_null(df, ["l_quantity", "l_extendedprice"], 0.5)


@query(
    f"""WITH {SAMPLES} SELECT sample_id, fin, round(quantile_cont(value, 0.5) OVER (PARTITION BY fin ORDER BY t, sample_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM samples"""
)
def median_filter(spark, sf_dir):
    """Running median of five neighbours."""
    return signals.median_filter(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "value", 5).select("sample_id", "fin", F.round("smooth", 6).alias("smooth"))


GRADIENT = """CASE WHEN lag({v}) OVER w IS NULL AND lead({v}) OVER w IS NULL THEN NULL WHEN lag({v}) OVER w IS NULL THEN lead({v}) OVER w - {v} WHEN lead({v}) OVER w IS NULL THEN {v} - lag({v}) OVER w ELSE (lead({v}) OVER w - lag({v}) OVER w) / 2 END"""


@query(
    f"""WITH {SAMPLES}, a AS (SELECT *, {GRADIENT.format(v="value")} AS vpg FROM samples WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id)),
    b AS (SELECT *, {GRADIENT.format(v="vpg")} AS apg FROM a WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id))
    SELECT sample_id, fin, round(vpg, 6) AS vpg, round(apg, 6) AS apg FROM b"""
)
def gradient_vpg_apg(spark, sf_dir):
    """First and second derivative by central differences."""
    out = signals.gradient(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "value", "vpg")
    out = signals.gradient(out, ["fin"], ["t", "sample_id"], "vpg", "apg")
    return out.select("sample_id", "fin", F.round("vpg", 6).alias("vpg"), F.round("apg", 6).alias("apg"))


PEAKS = f"""{SAMPLES}, p AS (SELECT *, row_number() OVER w AS i, value > lag(value) OVER w AND value >= lead(value) OVER w AS peak FROM samples WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id))"""


@query(f"WITH {PEAKS} SELECT fin, sample_id, t, value FROM p WHERE peak AND value >= 50")
def local_peaks(spark, sf_dir):
    """Samples above both neighbours and at least 50 high."""
    return signals.local_peaks(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "value", 50.0).select("fin", "sample_id", "t", "value")


@query(
    f"""WITH {PEAKS}, c AS (SELECT *, sum(CASE WHEN peak AND value >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY fin ORDER BY t, sample_id) AS cycle,
      sum(CASE WHEN peak AND value >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY fin) AS cycles FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY fin, cycle ORDER BY value, t, sample_id) AS rn FROM c WHERE cycle > 0 AND cycle < cycles)
    SELECT fin, CAST(cycle AS BIGINT) AS cycle, sample_id, t, value FROM r WHERE rn = 1"""
)
def trough_between_peaks(spark, sf_dir):
    """The least sample between consecutive peaks (the foot of a pulse)."""
    return signals.troughs(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "value", 50.0)


HOUR12 = 12 * 3_600_000_000


@query(
    f"""WITH {PEAKS}, k AS (SELECT * FROM p WHERE peak AND value >= 50),
    r AS (SELECT k.fin, k.sample_id, s.sample_id AS refined_id, s.value, row_number() OVER (PARTITION BY k.fin, k.sample_id ORDER BY s.value DESC, s.t, s.sample_id) AS rn
      FROM k JOIN samples s ON s.fin = k.fin AND s.t BETWEEN k.t - {HOUR12} AND k.t + {HOUR12})
    SELECT fin, sample_id, refined_id, value FROM r WHERE rn = 1"""
)
def peak_refine(spark, sf_dir):
    """Each peak moved to the highest sample within twelve hours."""
    return signals.refine_peaks(samples(spark, sf_dir), ["fin"], "t", "sample_id", "value", HOUR12, 50.0)


@query(
    f"""WITH {SAMPLES}, d AS (SELECT *, value - avg(value) OVER (PARTITION BY fin) AS x FROM samples), z AS (SELECT *, lead(x) OVER (PARTITION BY fin ORDER BY t, sample_id) AS nx FROM d)
    SELECT fin, sample_id, CASE WHEN x < 0 AND nx >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM z WHERE (x < 0 AND nx >= 0) OR (x >= 0 AND nx < 0)"""
)
def zero_crossings(spark, sf_dir):
    """Where the demeaned series changes its sign."""
    return signals.zero_crossings(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "value").select("fin", "sample_id", "direction")


@query(
    f"""WITH {SAMPLES}, a AS (SELECT *, lead(value) OVER w AS nv, lead(t) OVER w AS nt FROM samples WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id))
    SELECT fin, round(sum((value + nv) / 2), 4) AS area_unit, round(sum((value + nv) / 2 * (nt - t) / 3.6e9), 3) AS area_hours FROM a GROUP BY fin"""
)
def trapz_area(spark, sf_dir):
    """Area under each series by trapezoids, over the index and over hours."""
    out = signals.trapezoid(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "value", "t", 3.6e9)
    return out.select("fin", F.round("area_unit", 4).alias("area_unit"), F.round("area", 3).alias("area_hours"))


@query(
    f"""WITH {SAMPLES}, e AS (SELECT fin, t, (t - lag(t) OVER (PARTITION BY fin ORDER BY t, sample_id)) / 3.6e9 AS width FROM samples WHERE channel = 'click'),
    m AS (SELECT fin, quantile_cont(width, 0.5) AS med FROM e GROUP BY fin)
    SELECT e.fin, e.t, round(width, 6) AS width_hours, round(60 / nullif(width, 0), 6) AS rate FROM e JOIN m USING (fin) WHERE width < med + 24"""
)
def pulse_width_rate(spark, sf_dir):
    """Intervals between beats within the bound of the series' median, and their rate."""
    s = samples(spark, sf_dir).where("channel = 'click'")
    out = signals.intervals(s, ["fin"], ["t", "sample_id"], "t", 3.6e9, 24.0)
    return out.select("fin", "t", F.round("interval", 6).alias("width_hours"), F.round("rate", 6).alias("rate"))


@query(
    f"""WITH {SAMPLES}, a AS (SELECT fin, channel, segment, value, avg(value) OVER (PARTITION BY fin, channel) AS m, row_number() OVER (PARTITION BY fin, channel ORDER BY t, sample_id) AS i FROM (SELECT *, CAST(0 AS BIGINT) AS segment FROM samples)),
    x AS (SELECT fin, i, max(CASE WHEN channel = 'click' THEN value END) AS a, max(CASE WHEN channel = 'view' THEN value END) AS b FROM a WHERE i <= 4 GROUP BY fin, i)
    SELECT fin, round(corr(a, b), 5) AS score, count(*) AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY fin HAVING count(*) = 4"""
)
def beat_pair_correlation(spark, sf_dir):
    """Correlation of the first four samples of two channels, aligned by position."""
    s = samples(spark, sf_dir)
    out = signals.positional_correlation(s, ["fin"], ["t", "sample_id"], "channel", "click", "view", "value", 4)
    return out.select("fin", F.round("score", 5).alias("score"), "n")


@query(
    """WITH u AS (SELECT vec_id, label, UNNEST(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    t AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM u GROUP BY label, i)
    SELECT u.vec_id, u.label, round(corr(CAST(u.v AS DOUBLE), t.m), 4) AS score, corr(CAST(u.v AS DOUBLE), t.m) > 0.3 AS good FROM u JOIN t ON u.label = t.label AND u.i = t.i GROUP BY u.vec_id, u.label"""
)
def template_corr(spark, sf_dir):
    """Correlation of each beat with the mean beat of its group."""
    out = signals.template_scores(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return out.select("vec_id", "label", F.round("score", 4).alias("score"), (F.col("score") > 0.3).alias("good"))


@query(
    """WITH u AS (SELECT vec_id, label, UNNEST(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM u GROUP BY label, i),
    s AS (SELECT u.vec_id, u.label, corr(v, m) AS c FROM u JOIN m ON m.label = u.label AND m.i = u.i GROUP BY u.vec_id, u.label)
    SELECT label, count(*) AS beats, round(avg(c), 6) AS mean_corr, round(avg(CAST(c < 0.3 AS INT)), 6) AS low_share FROM s GROUP BY label"""
)
def beat_quality(spark, sf_dir):
    """Mean correlation with the mean beat, and the share of poor beats, of each group."""
    out = signals.beat_quality(signals.template_scores(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"), "label", low=0.3)
    return out.select("label", "beats", F.round("mean_corr", 6).alias("mean_corr"), F.round("low_share", 6).alias("low_share"))


@query(
    f"""WITH {SAMPLES}, b AS (SELECT *, (t - lag(t) OVER (PARTITION BY fin ORDER BY t, sample_id)) / 3.6e9 AS gap FROM samples),
    r AS (SELECT *, 60 / nullif(coalesce(gap, lead(gap) OVER (PARTITION BY fin ORDER BY t, sample_id)), 0) AS rate FROM b)
    SELECT fin, sample_id, round(rate, 6) AS rate FROM r WHERE value > 10 AND rate BETWEEN 1 AND 200"""
)
def beat_keep_rule(spark, sf_dir):
    """Beats with a good score and a plausible rate; the first beat takes the second one's rate."""
    out = signals.keep_beats(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "t", "value", 3.6e9, 10.0, 1.0, 200.0)
    return out.select("fin", "sample_id", F.round("rate", 6).alias("rate"))
