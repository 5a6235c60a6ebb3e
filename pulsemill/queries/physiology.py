"""Beat intervals, their variability, and pressures; hours between clicks stand in for beats."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from ..functions.columns import micros
from ..operators import beats, hrv, kernels
from .base import SAMPLES, query, read, samples

#: Intervals in hours between the events of an encounter.
NN = f"""{SAMPLES}, nn0 AS (SELECT fin, t, sample_id, (t - lag(t) OVER (PARTITION BY fin ORDER BY t, sample_id)) / 3.6e9 AS nn FROM samples),
nn AS (SELECT *, nn - lag(nn) OVER (PARTITION BY fin ORDER BY t, sample_id) AS d FROM nn0 WHERE nn IS NOT NULL)"""
KEYS, ORDER = ["fin"], ["t", "sample_id"]


def intervals(spark, sf_dir):
    return hrv.nn_intervals(samples(spark, sf_dir), KEYS, ORDER, "t", 3.6e9)


def rounded(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query(
    f"""WITH {NN}, m AS (SELECT fin, quantile_cont(nn, 0.5) AS med FROM nn GROUP BY fin), b AS (SELECT fin, max(n) AS top FROM (SELECT fin, floor(nn / 2) AS b, count(*) AS n FROM nn GROUP BY fin, floor(nn / 2)) GROUP BY fin),
    a AS (SELECT fin, avg(nn) AS MeanNN, stddev_samp(nn) AS SDNN, sqrt(avg(d * d)) AS RMSSD, stddev_samp(d) AS SDSD, max(med) AS MedianNN,
      quantile_cont(abs(nn - med), 0.5) AS MadNN, quantile_cont(nn, 0.75) - quantile_cont(nn, 0.25) AS IQRNN,
      quantile_cont(nn, 0.2) AS Prc20NN, quantile_cont(nn, 0.8) AS Prc80NN,
        100 * avg(CASE WHEN d IS NOT NULL THEN CAST(abs(d) > 10 AS INT) END) AS pNN50,
        100 * avg(CASE WHEN d IS NOT NULL THEN CAST(abs(d) > 5 AS INT) END) AS pNN20,
      min(nn) AS MinNN, max(nn) AS MaxNN, count(nn) / CAST(max(top) AS DOUBLE) AS HTI FROM nn JOIN m USING (fin) JOIN b USING (fin) GROUP BY fin)
    SELECT fin, {", ".join(f"round({c}, 6) AS {c}" for c in "MeanNN SDNN RMSSD SDSD MedianNN MadNN IQRNN Prc20NN Prc80NN pNN50 pNN20 MinNN MaxNN HTI".split())},
      round(SDNN / MeanNN, 6) AS CVNN, round(RMSSD / MeanNN, 6) AS CVSD, round(MadNN / MedianNN, 6) AS MCVNN, round(SDNN / RMSSD, 6) AS SDRMSSD FROM a"""
)
def hrv_time_domain(spark, sf_dir):
    """Time-domain variability of the intervals."""
    return rounded(hrv.time_domain(intervals(spark, sf_dir), KEYS, steps=(10.0, 5.0), bin_width=2.0))


@query(
    f"""WITH {NN}, w AS (SELECT fin, floor(t / 4.32e11) AS w, avg(nn) AS m, stddev_samp(nn) AS s FROM nn GROUP BY fin, floor(t / 4.32e11)) SELECT fin, round(stddev_samp(m), 6) AS SDANN, round(avg(s), 6) AS SDNNI FROM w GROUP BY fin"""
)
def hrv_windowed(spark, sf_dir):
    """Variability between and within windows of five days."""
    return rounded(hrv.windowed_deviation(intervals(spark, sf_dir), KEYS, "t", 4.32e11))


@query(
    f"""WITH {NN}, a AS (SELECT fin, sqrt(var_samp(d) / 2) AS SD1, sqrt(greatest(0.0, 2 * var_samp(nn) - var_samp(d) / 2)) AS SD2 FROM nn GROUP BY fin)
    SELECT fin, round(SD1, 6) AS SD1, round(SD2, 6) AS SD2, round(SD1 / SD2, 6) AS SD1SD2, round({pi} * SD1 * SD2, 6) AS S, round(SD2 / SD1, 6) AS CSI, round(log10(16 * SD1 * SD2), 6) AS CVI, round(4 * SD2 * SD2 / SD1, 6) AS CSI_Modified FROM a"""
)
def hrv_poincare(spark, sf_dir):
    """Poincare plot indices."""
    return rounded(hrv.poincare(intervals(spark, sf_dir), KEYS))


@query(
    f"""WITH {NN}, p AS (SELECT fin, lag(nn) OVER (PARTITION BY fin ORDER BY t, sample_id) AS x, nn AS y FROM nn), q AS (SELECT fin, y - x AS s, (x - avg(x) OVER (PARTITION BY fin)) + (y - avg(y) OVER (PARTITION BY fin)) AS e FROM p WHERE x IS NOT NULL),
    z AS (SELECT fin, sum(CASE WHEN s > 0 THEN s * s / 2 ELSE 0 END) AS sd, sum(CASE WHEN s < 0 THEN s * s / 2 ELSE 0 END) AS sa,
      sum(CASE WHEN s > 0 THEN e * e / 2 WHEN s = 0 THEN e * e / 4 ELSE 0 END) AS ld,
      sum(CASE WHEN s < 0 THEN e * e / 2 WHEN s = 0 THEN e * e / 4 ELSE 0 END) AS la, count(*) - 1 AS n FROM q GROUP BY fin)
    SELECT fin, round(sd / (sd + sa), 6) AS C1d, round(sa / (sd + sa), 6) AS C1a, round(sqrt(sd / n), 6) AS SD1d, round(sqrt(sa / n), 6) AS SD1a, round(ld / (ld + la), 6) AS C2d, round(la / (ld + la), 6) AS C2a, round(sqrt(ld / n), 6) AS SD2d, round(sqrt(la / n), 6) AS SD2a FROM z"""
)
def hr_asymmetry(spark, sf_dir):
    """Asymmetry of decelerations and accelerations."""
    return rounded(hrv.asymmetry(intervals(spark, sf_dir), KEYS, ORDER))


@query(
    f"""WITH {NN}, r AS (SELECT fin, t, sample_id, sign(d) AS s FROM nn WHERE d IS NOT NULL), l AS (SELECT *, lag(s) OVER (PARTITION BY fin ORDER BY t, sample_id) AS p FROM r),
    i AS (SELECT *, sum(CASE WHEN p IS NULL OR s <> p THEN 1 ELSE 0 END) OVER (PARTITION BY fin
      ORDER BY t, sample_id) AS run, sum(CASE WHEN s * p < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY fin ORDER BY t, sample_id) AS chain FROM l),
    n AS (SELECT *, count(*) OVER (PARTITION BY fin, run) AS length, count(*) OVER (PARTITION BY fin, chain) AS chained FROM i)
    SELECT fin, round(avg(CASE WHEN s * p <= 0 THEN 1.0 ELSE 0.0 END), 6) AS PIP, round(max(run) / CAST(count(*) AS DOUBLE), 6) AS IALS, round(avg(CASE WHEN length < 3 THEN 1.0 ELSE 0.0 END), 6) AS PSS, round(avg(CASE WHEN chained >= 4 THEN 1.0 ELSE 0.0 END), 6) AS PAS FROM n GROUP BY fin"""
)
def hrv_fragmentation(spark, sf_dir):
    """How often the intervals turn."""
    return rounded(hrv.fragmentation(intervals(spark, sf_dir), KEYS, ORDER))


def source_sql(channel: str) -> str:
    return f"SELECT fin, avg(CASE WHEN NOT (nn BETWEEN 12 AND 300) THEN 1.0 ELSE 0.0 END) AS bad FROM (SELECT fin, (t - lag(t) OVER (PARTITION BY fin ORDER BY t, sample_id)) / 3.6e9 AS nn FROM samples WHERE channel = '{channel}') WHERE nn IS NOT NULL GROUP BY fin"


@query(
    f"""WITH {SAMPLES}, a AS ({source_sql("click")}), b AS ({source_sql("view")}) SELECT coalesce(a.fin, b.fin) AS fin, round(a.bad, 6) AS first_bad, round(b.bad, 6) AS second_bad,
    CASE WHEN a.bad <= 0.2 THEN 'first' WHEN b.bad <= 0.2 THEN 'second' ELSE 'none' END AS source FROM a FULL JOIN b ON a.fin = b.fin"""
)
def nn_source_choice(spark, sf_dir):
    """The interval source of each encounter."""
    s = samples(spark, sf_dir)
    of = lambda c: hrv.nn_intervals(s.where(F.col("channel") == c), KEYS, ORDER, "t", 3.6e9)
    return rounded(hrv.choose_source(of("click"), of("view"), KEYS, 12.0, 300.0))


def interpolate_sql(source: str, target: str) -> str:
    """Linear interpolation of missing values by position."""
    w = "PARTITION BY fin ORDER BY i ROWS BETWEEN"
    return f"""{target}0 AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) AS pi, min(CASE WHEN v IS NOT NULL THEN i END) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM {source}),
    {target} AS (SELECT x.fin, x.sample_id, x.i, coalesce(x.v, a.v + (b.v - a.v) * (x.i - x.pi) / CAST(nullif(x.ni - x.pi, 0) AS DOUBLE), a.v, b.v) AS v FROM {target}0 x LEFT JOIN {source} a ON a.fin = x.fin AND a.i = x.pi LEFT JOIN {source} b ON b.fin = x.fin AND b.i = x.ni)"""


@query(
    f"""WITH {NN}, s0 AS (SELECT fin, sample_id, row_number() OVER (PARTITION BY fin ORDER BY t, sample_id) AS i, CASE WHEN nn BETWEEN 2 AND 40 THEN nn END AS v FROM nn), {interpolate_sql("s0", "s1")},
    s2 AS (SELECT fin, sample_id, i, CASE WHEN abs(v - lag(v) OVER (PARTITION BY fin ORDER BY i)) > 0.5 * lag(v) OVER (PARTITION BY fin
      ORDER BY i) THEN NULL ELSE v END AS v FROM s1), {interpolate_sql("s2", "s3")}
    SELECT fin, sample_id, CAST(ceil(round(v, 9)) AS BIGINT) AS clean FROM s3"""
)
def nn_clean_linear(spark, sf_dir):
    """Intervals without outliers and ectopic ones, interpolated."""
    out = hrv.clean_intervals(intervals(spark, sf_dir), KEYS, ORDER, 2.0, 40.0, 0.5)
    return out.select("fin", "sample_id", "clean")


@query(
    """WITH d AS (SELECT user_id AS fin, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, max(value) AS SBP, min(value) AS DBP, CAST(count(*) AS DOUBLE) * 20 AS HR FROM events GROUP BY 1, 2),
    m AS (SELECT *, (SBP + 2 * DBP) / 3 AS MAP, SBP - DBP AS PP_ABP, HR / nullif(SBP, 0) AS ShockIndex FROM d), c AS (SELECT *, PP_ABP * HR / 1000 AS CO FROM m)
    SELECT fin, day, SBP, DBP, HR, round(MAP, 6) AS MAP, round(PP_ABP, 6) AS PP_ABP, round(ShockIndex, 6) AS ShockIndex, round(CO, 6) AS CO, round(MAP / nullif(CO, 0), 6) AS TPR FROM c"""
)
def abp_haemodynamics(spark, sf_dir):
    """Pressures and flow of each day."""
    e = read(spark, sf_dir, "events", "user_id", "ts", "value")
    days = e.groupBy(F.col("user_id").alias("fin"), F.floor(micros("ts") / 86_400_000_000).cast("long").alias("day")).agg(F.max("value").alias("SBP"), F.min("value").alias("DBP"), (F.count("*").cast("double") * 20).alias("HR"))
    return rounded(hrv.haemodynamics(days, "SBP", "DBP", "HR"))


# the kernels below need NumPy and have no SQL; they run once per series, in Arrow batches


def series(spark, sf_dir):
    """Arrays of up to kernels.SEGMENT values of each encounter, in order of time."""
    return kernels.segments(samples(spark, sf_dir), "fin", ORDER, "value")


@query()
def butter_filtfilt(spark, sf_dir):
    """Zero-phase band-pass filtering of each series, by segments that overlap."""
    s = kernels.segments(samples(spark, sf_dir), "fin", ORDER, "value", margin=kernels.MARGIN)
    return kernels.filtered(s, "fin", "values", fs=10.0, low=4.0, high=0.2, order=2, keep=["segment"], core="core")


#: The values of each encounter, numbered from 0.
NUMBERED = f"{SAMPLES}, x AS (SELECT fin, row_number() OVER (PARTITION BY fin ORDER BY t, sample_id) - 1 AS r, value AS v, count(*) OVER (PARTITION BY fin) AS n FROM samples)"


@query(
    f"""WITH {NUMBERED}, k AS (SELECT DISTINCT fin, n, least(n, 256) AS size, UNNEST(range(0, greatest(1, (n - 128) // 128))) AS k FROM x),
    w AS (SELECT k.fin, k.k, k.size, x.r - k.k * 128 AS j, (x.v - avg(x.v) OVER (PARTITION BY k.fin, k.k)) * (0.5 - 0.5 * cos(2 * pi() * (x.r - k.k * 128) / k.size)) AS y
      FROM k JOIN x ON x.fin = k.fin AND x.r >= k.k * 128 AND x.r < k.k * 128 + k.size),
    f AS (SELECT DISTINCT fin, k, size, UNNEST(range(0, size // 2 + 1)) AS f FROM k),
    d AS (SELECT f.fin, f.k, f.size, f.f, pow(sum(y * cos(2 * pi() * f.f * j / f.size)), 2) + pow(sum(y * sin(2 * pi() * f.f * j / f.size)), 2) AS p
      FROM f JOIN w ON w.fin = f.fin AND w.k = f.k GROUP BY f.fin, f.k, f.size, f.f),
    q AS (SELECT fin, size, f, avg(p) * CASE WHEN f > 0 AND 2 * f < size THEN 2 ELSE 1 END AS p FROM d GROUP BY fin, size, f)
    SELECT fin, round(sum(p * f / size) / sum(p), 6) AS center_freq, 'perfect' AS status FROM q GROUP BY fin"""
)
def welch_centroid(spark, sf_dir):
    """Centre frequency of each series, from its segments' periodograms."""
    return rounded(kernels.welch_centroids(samples(spark, sf_dir), "fin", ORDER, "value", 1.0))


@query(
    f"""WITH {NUMBERED}, s AS (SELECT fin, r // 1024 AS segment, r % 1024 AS i, v FROM x), z AS (SELECT fin, segment, count(*) AS n, 0.2 * stddev_samp(v) AS tol FROM s GROUP BY fin, segment),
    e AS (SELECT s.fin, s.segment, i, v AS a, lead(v, 1) OVER o AS b, lead(v, 2) OVER o AS c, n, tol FROM s JOIN z ON z.fin = s.fin AND z.segment = s.segment WINDOW o AS (PARTITION BY s.fin, s.segment ORDER BY i)),
    m AS (SELECT p.fin, p.segment, p.n, p.i, q.i AS j, abs(p.a - q.a) <= p.tol AND abs(p.b - q.b) <= p.tol AS two, abs(p.a - q.a) <= p.tol AND abs(p.b - q.b) <= p.tol AND abs(p.c - q.c) <= p.tol AS three
      FROM e p JOIN e q ON q.fin = p.fin AND q.segment = p.segment WHERE p.i <= p.n - 2 AND q.i <= p.n - 2),
    g AS (SELECT fin, segment, sum(CASE WHEN i < n - 2 AND j < n - 2 AND i <> j AND two THEN 1 ELSE 0 END) AS b2, sum(CASE WHEN i < n - 2 AND j < n - 2 AND i <> j AND three THEN 1 ELSE 0 END) AS a3 FROM m GROUP BY fin, segment),
    c AS (SELECT fin, segment, i, n, sum(CAST(two AS INT)) / CAST(max(n) - 1 AS DOUBLE) AS c2, sum(CASE WHEN i < n - 2 AND j < n - 2 AND three THEN 1 ELSE 0 END) / CAST(max(n) - 2 AS DOUBLE) AS c3 FROM m GROUP BY fin, segment, i, n),
    h AS (SELECT fin, segment, avg(ln(c2)) - avg(CASE WHEN i < n - 2 THEN ln(c3) END) AS ap FROM c GROUP BY fin, segment),
    u AS (SELECT fin, segment, -sum(w / tot * log2(w / tot)) AS sh FROM (SELECT fin, segment, v, CAST(count(*) AS DOUBLE) AS w, CAST(sum(count(*)) OVER (PARTITION BY fin, segment) AS DOUBLE) AS tot FROM s GROUP BY fin, segment, v) GROUP BY fin, segment),
    d AS (SELECT fin, segment, abs(v - lag(v) OVER o) AS step, abs(v - first_value(v) OVER o) AS far FROM s WINDOW o AS (PARTITION BY fin, segment ORDER BY i)),
    k AS (SELECT fin, segment, log10(count(step)) AS ln_, max(far) AS far, sum(step) AS len FROM d GROUP BY fin, segment)
    SELECT g.fin, g.segment, round(CASE WHEN a3 > 0 AND b2 > 0 THEN -ln(a3 / CAST(b2 AS DOUBLE)) END, 6) AS "SampEn", round(ap, 6) AS "ApEn", round(sh, 6) AS "ShanEn", round(ln_ / (ln_ + log10(far / len)), 6) AS "KFD", 'perfect' AS status
    FROM g JOIN h ON h.fin = g.fin AND h.segment = g.segment JOIN u ON u.fin = g.fin AND u.segment = g.segment JOIN k ON k.fin = g.fin AND k.segment = g.segment"""
)
def hrv_entropies(spark, sf_dir):
    """Sample, approximate and Shannon entropy and the fractal dimension of Katz of each segment of each series."""
    chosen = {k: kernels.NONLINEAR[k] for k in ("SampEn", "ApEn", "ShanEn", "KFD")}
    return rounded(kernels.per_series(series(spark, sf_dir), "fin", "values", chosen, keep=["segment"]))


@query()
def hrv_nonlinear(spark, sf_dir):
    """Entropies, fractal dimensions, fluctuation exponents and recurrence of each segment of each series."""
    return kernels.per_series(series(spark, sf_dir), "fin", "values", kernels.NONLINEAR, keep=["segment"])


@query()
def hrv_frequency(spark, sf_dir):
    """Band powers of the interval series."""
    nn = intervals(spark, sf_dir).groupBy("fin").agg(F.array_sort(F.collect_list(F.struct("t", "nn"))).alias("x")).select("fin", (F.transform("x.nn", lambda v: v * 40)).alias("values"))
    return kernels.per_series(nn, "fin", "values", kernels.FREQUENCY)


@query()
def multiscale_entropy(spark, sf_dir):
    """Sample entropy of each segment of each series at twenty scales, and its means."""
    return kernels.per_series(series(spark, sf_dir), "fin", "values", kernels.MULTISCALE, keep=["segment"])


TURNS = f"""{SAMPLES}, k AS (SELECT fin, t, sample_id, CASE WHEN value > lag(value) OVER w AND value >= lead(value) OVER w THEN 'peak' WHEN value < lag(value) OVER w AND value <= lead(value) OVER w THEN 'trough' END AS k FROM samples WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id)),
n AS (SELECT *, lag(t) OVER v AS a, lead(t) OVER v AS b, lag(k) OVER v AS ka, lead(k) OVER v AS kb FROM k WHERE k IS NOT NULL WINDOW v AS (PARTITION BY fin ORDER BY t, sample_id))"""


@query(f"WITH {TURNS} SELECT fin, t AS peak_t, t - a AS insp_time, b - t AS exp_time, round((t - a) / CAST(nullif(b - t, 0) AS DOUBLE), 6) AS insp_exp_ratio FROM n WHERE k = 'peak' AND ka = 'trough' AND kb = 'trough'")
def breath_times(spark, sf_dir):
    """Inspiration and expiration times."""
    return rounded(beats.breaths(samples(spark, sf_dir), KEYS, ORDER, "value", "t"))
