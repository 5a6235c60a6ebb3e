"""Landmarks of waves: the values of an encounter's events, in order, stand in for a wave of 10 samples a second."""

from __future__ import annotations

from math import pi

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import beats, fiducials, hrv, modalities, peaks, stats
from .base import SAMPLES, query, samples
from .physiology import NN, intervals, rounded

KEYS, FS = ["fin"], 10.0
#: The samples with their places, and the values less their median.
WAVE = f"{SAMPLES}, x AS (SELECT fin, row_number() OVER (PARTITION BY fin ORDER BY t, sample_id) - 1 AS i, value AS v FROM samples)"
CENTRED = f"{WAVE}, c AS (SELECT fin, i, v - quantile_cont(v, 0.5) OVER (PARTITION BY fin) AS v FROM x)"


def wave(spark, sf_dir):
    """In as many tasks as ``spark.sql.shuffle.partitions`` says: joined into few by their bytes, small as these are when compressed, tasks would grow with the table."""
    dealt = samples(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEYS)
    return fiducials.indexed(dealt, KEYS, ["t", "sample_id"])


def centred(spark, sf_dir):
    return wave(spark, sf_dir).select("fin", "i", (F.col("v") - F.percentile("v", 0.5).over(Window.partitionBy(*KEYS))).alias("v"))


TURNS = {
    ("positive", False): "a < 0 AND b >= 0", ("positive", True): "a >= 0 AND b < 0", ("negative", False): "a > 0 AND b <= 0", ("negative", True): "a <= 0 AND b > 0", ("both", False): "sign(a) <> sign(b)",
}
PICKS = {("first", False): "i", ("first", True): "-i", ("max", False): "-v, i", ("min", False): "v, i"}


def reversals_sql() -> str:
    found = " UNION ALL ".join(f"SELECT fin, '{k}' AS kind, {b} AS backwards, i, v FROM s WHERE {c}" for (k, b), c in TURNS.items())
    ruled = " UNION ALL ".join(
        f"SELECT fin, kind, backwards, '{r}' AS rule, i, v FROM (SELECT *, row_number() OVER (PARTITION BY fin, kind, backwards ORDER BY {o}) AS n FROM f WHERE backwards = {b}) WHERE n = 1" for (r, b), o in PICKS.items()
    )
    return f"""WITH {WAVE}, s AS (SELECT fin, i, v, v - lag(v) OVER w AS a, lead(v) OVER w - v AS b FROM x WINDOW w AS (PARTITION BY fin ORDER BY i)), f AS ({found})
    SELECT fin, kind, backwards, 'all' AS rule, i, v FROM f UNION ALL {ruled}"""


@query(reversals_sql())
def slope_reversals(spark, sf_dir):
    """Slope reversals of each type, direction and rule."""
    rules = {(kind, backwards): [r for r, b in PICKS if b == backwards] for kind, backwards in TURNS}
    return fiducials.ruled_reversals(wave(spark, sf_dir), KEYS, rules)


CROSSES = {"positive": "v < 0 AND b >= 0", "negative": "v > 0 AND b <= 0", "both": "v = 0 AND b <> 0"}


def crossings_sql() -> str:
    found = " UNION ALL ".join(f"SELECT fin, '{k}' AS kind, i, v FROM s WHERE {c}" for k, c in CROSSES.items())
    kinds = " UNION ALL ".join(f"SELECT fin, '{k}' AS kind, i, v FROM e" for k in CROSSES)
    pick = lambda name, o: f"SELECT fin, kind, '{name}' AS rule, i, v FROM (SELECT *, row_number() OVER (PARTITION BY fin, kind ORDER BY {o}) AS n FROM f) WHERE n = 1"
    return f"""WITH {CENTRED}, s AS (SELECT fin, i, v, lead(v) OVER (PARTITION BY fin ORDER BY i) AS b FROM c), f AS ({found}), e AS (SELECT fin, max(i) + 1 AS i, arg_max(v, i) AS v FROM c GROUP BY fin), k AS ({kinds})
    SELECT fin, kind, rule, i, round(v, 6) AS v FROM (SELECT fin, kind, 'all' AS rule, i, v FROM f UNION ALL {pick("first", "i")} UNION ALL {pick("last", "i DESC")}
    UNION ALL SELECT fin, kind, 'last' AS rule, i, v FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.fin = k.fin AND f.kind = k.kind))"""


@query(crossings_sql())
def zero_crossing_rules(spark, sf_dir):
    """Zero crossings of each type and rule."""
    return rounded(fiducials.ruled_crossings(centred(spark, sf_dir), KEYS, list(CROSSES)))


@query(
    f"WITH {WAVE}, n AS (SELECT *, count(*) OVER (PARTITION BY fin) AS n FROM x), w AS (SELECT fin, i, n, UNNEST(CASE WHEN i % 8 < 2 AND i >= 8 THEN [i // 8 - 1, i // 8] ELSE [i // 8] END) AS win FROM n) SELECT fin, CAST(win AS BIGINT) AS win, CAST(min(i) AS BIGINT) AS first_i, count(*) AS n FROM w WHERE win * 8 + 10 <= n GROUP BY fin, win"
)
def extrema_windows(spark, sf_dir):
    """Search windows of ten samples that overlap by two."""
    x = fiducials.search_windows(wave(spark, sf_dir), KEYS, 10)
    return x.groupBy("fin", F.col("window").alias("win")).agg(F.min("i").cast("long").alias("first_i"), F.count("*").alias("n"))


def energy_sql(name: str, source: str, energy: str, short: int, long: int, factor: float, offset: float, least: str, apart: int) -> str:
    mean = lambda w: f"avg(e) OVER (PARTITION BY fin ORDER BY i ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)"
    return f"""{name}e AS (SELECT fin, i, v, {energy} AS e FROM {source}), {name}m AS (SELECT *, {mean(short)} > {factor} * {mean(long)} + {offset} * avg(e) OVER (PARTITION BY fin) AS q FROM {name}e),
    {name}n AS (SELECT *, CASE WHEN q = lag(q) OVER (PARTITION BY fin ORDER BY i) THEN 0 ELSE 1 END AS new
      FROM {name}m), {name}i AS (SELECT *, sum(new) OVER (PARTITION BY fin ORDER BY i) AS g FROM {name}n),
    {name}s AS (SELECT fin, g, count(*) AS n, max({{'v': v, 'i': -i}}) AS p FROM {name}i WHERE q
      GROUP BY fin, g), {name}t AS (SELECT *, avg(n) OVER (PARTITION BY fin) AS m FROM {name}s),
    {name}d AS (SELECT fin, -p.i AS i, p.v AS v, -p.i - lag(-p.i) OVER (PARTITION BY fin ORDER BY -p.i) AS gap FROM {name}t WHERE {least}), {name} AS (SELECT fin, i, v FROM {name}d WHERE gap IS NULL OR gap > {apart})"""


STEEP = "(SELECT fin, i, v, abs((coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / 2) AS g FROM x WINDOW w AS (PARTITION BY fin ORDER BY i))"
R_SQL = energy_sql("r", STEEP, "g", 1, 8, 1.5, 0.0, "n >= 0.4 * m", 3)
P_SQL = energy_sql("p", "c", "greatest(v, 0) * greatest(v, 0)", 1, 7, 1.0, 0.02, "n >= 1", 3)


@query(f"WITH {WAVE}, {R_SQL} SELECT fin, i, v FROM r")
def r_peak_detect(spark, sf_dir):
    """R peaks by the steepness of the wave."""
    return fiducials.r_peaks(wave(spark, sf_dir), KEYS, FS)


@query(f"WITH {CENTRED}, {P_SQL} SELECT fin, i, round(v, 6) AS v FROM p")
def ppg_peak_detect(spark, sf_dir):
    """Systolic peaks by two moving averages."""
    return rounded(fiducials.pulse_peaks(centred(spark, sf_dir), KEYS, FS))


@query(
    f"""WITH {WAVE}, m AS (SELECT fin, i, v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM x WINDOW w AS (PARTITION BY fin ORDER BY i)) WHERE v > a AND v >= b AND v >= 60)
    SELECT fin, i, v FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.fin = m.fin AND abs(o.i - m.i) < 4 AND (o.v > m.v OR o.v = m.v AND o.i < m.i))"""
)
def spaced_peaks(spark, sf_dir):
    """Peaks of a least height and distance."""
    return fiducials.spaced_peaks(wave(spark, sf_dir), KEYS, 4, 60.0)


@query()
def greedy_peaks(spark, sf_dir):
    """Peaks by falling height at a least distance, of a least width, in segments of 4,096 samples."""
    x = wave(spark, sf_dir).withColumn("segment", F.floor(F.col("i") / 4096).cast("int"))
    return peaks.greedy_peaks(x, ["fin", "segment"], 4, 60.0, 0.5)


@query(
    f"""WITH {SAMPLES}, x AS (SELECT fin, row_number() OVER (PARTITION BY fin ORDER BY t, sample_id) - 1 AS i, floor(value / 20) AS v FROM samples), z AS (SELECT *, coalesce(v = lag(v) OVER (PARTITION BY fin ORDER BY i), FALSE) AS z FROM x),
    n AS (SELECT *, CASE WHEN z = lag(z) OVER (PARTITION BY fin ORDER BY i) THEN 0 ELSE 1 END AS new FROM z),
      g AS (SELECT *, sum(new) OVER (PARTITION BY fin ORDER BY i) AS g FROM n),
    l AS (SELECT *, z AND count(*) OVER (PARTITION BY fin, g) >= 3 AS l FROM g),
      f AS (SELECT *, l OR coalesce(lead(l) OVER (PARTITION BY fin ORDER BY i), FALSE) AS flat FROM l),
    s AS (SELECT *, avg(CAST(flat AS INT)) OVER (PARTITION BY fin) AS share, quantile_cont(v, 0.5) OVER (PARTITION BY fin) AS med FROM f) SELECT fin, i, CASE WHEN flat THEN med ELSE v END AS v FROM s WHERE share < 0.5"""
)
def flat_gate(spark, sf_dir):
    """Series that are less than half flat, their flat stretches at the median."""
    x = wave(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 20).cast("double"))
    return fiducials.usable(x, KEYS, 3.0, most=0.5)


MARKED = f"""{CENTRED}, {P_SQL}, pc AS (SELECT c.fin, c.i, c.v, sum(CASE WHEN p.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY c.fin ORDER BY c.i) AS k FROM c LEFT JOIN p ON p.fin = c.fin AND p.i = c.i),
pk AS (SELECT *, k < max(k) OVER (PARTITION BY fin) AS whole FROM pc WHERE k > 0),
      o AS (SELECT fin, (min({{'v': v, 'i': i}})).i AS i FROM pk WHERE whole GROUP BY fin, k),
oc AS (SELECT c.fin, c.i, c.v, sum(CASE WHEN o.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY c.fin ORDER BY c.i) AS k FROM c LEFT
      JOIN o ON o.fin = c.fin AND o.i = c.i),
d1 AS (SELECT *, k < max(k) OVER (PARTITION BY fin) AS whole, (lead(v) OVER w - lag(v) OVER w) / 2 AS vpg FROM oc WHERE k > 0 WINDOW w AS (PARTITION BY fin ORDER BY i)),
d2 AS (SELECT *, (lead(vpg) OVER w - lag(vpg) OVER w) / 2 AS apg FROM d1 WINDOW w AS (PARTITION BY fin ORDER BY i)),
d3 AS (SELECT *, apg > lag(apg) OVER w AND apg >= lead(apg) OVER w AS turn, apg < lag(apg) OVER w AND apg <= lead(apg) OVER w AS pit,
      vpg > 0 AND lead(vpg) OVER w <= 0 AS fall, max(vpg) OVER q AS up, min(vpg) OVER q AS down, max(apg) OVER q AS acc FROM d2
      WINDOW w AS (PARTITION BY fin ORDER BY i), q AS (PARTITION BY fin)),
l1 AS (SELECT *, min(i) OVER u AS onset, -(max({{'v': v, 'i': -i}}) OVER u).i AS systolic, max(i) OVER u + 1 AS stop FROM d3 WHERE whole
      WINDOW u AS (PARTITION BY fin, k)),
l2 AS (SELECT *, -(max({{'v': vpg, 'i': -i}}) FILTER (WHERE i <= systolic AND vpg >= 0.5 * up) OVER u).i AS vpg_w, -(max({{'v': apg, 'i': -i}})
      FILTER (WHERE turn AND i <= systolic AND apg >= 0.45 * acc) OVER u).i AS apg_a,
  -(max({{'v': apg, 'i': -i}}) FILTER (WHERE turn AND i > systolic) OVER u).i AS apg_e FROM l1 WINDOW u AS (PARTITION BY fin, k)),
l3 AS (SELECT *, min(i) FILTER (WHERE pit AND i > coalesce(apg_a, onset)) OVER u AS apg_b, min(i)
      FILTER (WHERE fall AND i >= apg_e) OVER u AS diastolic FROM l2 WINDOW u AS (PARTITION BY fin, k)),
l4 AS (SELECT *, (min({{'v': vpg, 'i': i}}) FILTER (WHERE i BETWEEN systolic AND apg_e AND vpg <= 0.45 * down) OVER u).i AS vpg_y,
      -(max({{'v': vpg, 'i': -i}}) FILTER (WHERE i >= apg_e AND vpg IS NOT NULL) OVER u).i AS vpg_z,
  min(i) FILTER (WHERE turn AND i > apg_b AND i < apg_e) OVER u AS apg_c FROM l3 WINDOW u AS (PARTITION BY fin, k)),
l5 AS (SELECT *, min(i) FILTER (WHERE pit AND i > greatest(apg_b, apg_c) AND i < apg_e) OVER u AS apg_d FROM l4 WINDOW u AS (PARTITION BY fin, k)),
marks AS (SELECT fin, k AS cycle, max(apg_e) AS notch, {", ".join(f"max({c}) AS {c}" for c in "onset systolic diastolic vpg_w vpg_y vpg_z apg_a apg_b apg_c apg_d apg_e stop".split())} FROM l5 GROUP BY fin, k)"""


def landmarks(spark, sf_dir):
    x = centred(spark, sf_dir)
    onsets = fiducials.feet(x, fiducials.pulse_peaks(x, KEYS, FS), KEYS)
    return x, onsets, fiducials.pulse_landmarks(x, onsets, KEYS)


@query(f"WITH {MARKED} SELECT fin, CAST(cycle AS BIGINT) AS cycle, {', '.join(fiducials.PULSE)}, stop FROM marks")
def pulse_landmarks(spark, sf_dir):
    """Onset, peaks, notch and the waves of both derivatives of each pulse."""
    return landmarks(spark, sf_dir)[2].drop("wave")


@query(
    f"""WITH {MARKED}, n AS (SELECT marks.fin, quantile_cont(c.v, 0.5) AS n FROM marks JOIN c ON c.fin = marks.fin AND c.i = notch GROUP BY marks.fin), q AS (SELECT marks.fin, quantile_cont(c.v, 0.5) AS d FROM marks JOIN c ON c.fin = marks.fin AND c.i = diastolic GROUP BY marks.fin),
    b AS (SELECT coalesce(n.fin, q.fin) AS fin, n, d, abs(100 * (d - n) / nullif(n, 0)) AS x FROM n FULL JOIN q ON q.fin = n.fin)
    SELECT fin, CASE WHEN d IS NULL THEN NULL WHEN d > n AND x > 10 THEN 'Class1' WHEN x < 10 THEN 'Class2' WHEN d < n AND x > 10 THEN 'Class3' ELSE 'Unknown' END AS ppg_class FROM b"""
)
def pulse_class(spark, sf_dir):
    """The class of each encounter's pulses."""
    x, _, marks = landmarks(spark, sf_dir)
    return fiducials.pulse_class(marks, x, KEYS)


@query(
    f"""WITH {MARKED}, {R_SQL}, ci AS (SELECT fin, quantile_cont(d, 0.5) AS ms FROM (SELECT fin, (i - lag(i) OVER (PARTITION BY fin ORDER BY i)) * 100.0 AS d FROM p) WHERE d IS NOT NULL GROUP BY fin),
    h AS (SELECT r.fin, r.i, min(o.i - r.i) * 100.0 AS pat_ms FROM r JOIN o ON o.fin = r.fin AND o.i > r.i GROUP BY r.fin, r.i),
      k AS (SELECT h.fin, i, pat_ms FROM h JOIN ci ON ci.fin = h.fin WHERE pat_ms < 0.85 * ms)
    SELECT fin, i, CAST(pat_ms AS DOUBLE) AS pat_ms, CAST(pat_ms - lag(pat_ms) OVER (PARTITION BY fin ORDER BY i) AS DOUBLE) AS dpat_ms FROM k"""
)
def pulse_arrival(spark, sf_dir):
    """Pulse arrival times and their changes."""
    x, onsets, _ = landmarks(spark, sf_dir)
    every = fiducials.intervals_ms(fiducials.pulse_peaks(x, KEYS, FS), KEYS, FS, "pp").groupBy("fin").agg(F.percentile("pp", 0.5).alias("interval_ms"))
    return fiducials.arrival_times(fiducials.r_peaks(wave(spark, sf_dir), KEYS, FS), onsets, KEYS, FS, every)


RATE = """SELECT fin, i, avg(60000.0 / nullif(d, 0)) OVER (PARTITION BY fin ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM (SELECT fin, i, (i - lag(i) OVER (PARTITION BY fin ORDER BY i)) * 100.0 AS d FROM {0}) WHERE d IS NOT NULL"""


def breaths_sql(name: str, source: str, least: int) -> str:
    return f"""{name}v AS ({source}), {name}m AS (SELECT fin, i, v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM {name}v WINDOW w AS (PARTITION BY fin ORDER BY i)) WHERE v > a AND v >= b),
    {name} AS (SELECT fin, i FROM {name}m AS m WHERE NOT EXISTS (SELECT 1 FROM {name}m AS o WHERE o.fin = m.fin AND abs(o.i - m.i) < {least} AND (o.v > m.v OR o.v = m.v AND o.i < m.i)))"""


@query(
    f"""WITH {CENTRED}, {R_SQL}, {P_SQL}, {breaths_sql("belt", "SELECT fin, i, v FROM x WHERE fin % 3 = 0", 8)}, {breaths_sql("edr", RATE.format("r"), 8)}, {breaths_sql("pdr", RATE.format("p"), 8)},
    u AS (SELECT fin, i, 0 AS r, 'RESP' AS source FROM belt UNION ALL SELECT fin, i, 1, 'EDR' FROM edr UNION ALL SELECT fin, i, 2, 'PDR' FROM pdr),
      n AS (SELECT *, count(*) OVER (PARTITION BY fin, r) AS n FROM u),
    b AS (SELECT *, min(r) OVER (PARTITION BY fin) AS best FROM n WHERE n >= 2),
      w AS (SELECT fin, i, source, (i - lag(i) OVER (PARTITION BY fin ORDER BY i)) / 10.0 AS w FROM b WHERE r = best)
    SELECT fin, i, source, CAST(w AS DOUBLE) AS "resp_width_PPresp_s", round(60.0 / w, 6) AS "resp_rate_Bpm" FROM w WHERE w IS NOT NULL"""
)
def breathing_source(spark, sf_dir):
    """Breath widths and rates from the belt (here of each third encounter), else the ECG, else the pulse."""
    x, c = wave(spark, sf_dir), centred(spark, sf_dir)
    belt = fiducials.spaced_peaks(x.where(F.col("fin") % 3 == 0), KEYS, 8)
    edr, pdr = (fiducials.derived_breaths(p, KEYS, FS, 0.8) for p in (fiducials.r_peaks(x, KEYS, FS), fiducials.pulse_peaks(c, KEYS, FS)))
    return rounded(fiducials.breathing(belt, edr, pdr, KEYS, FS))


ECG_FS = 25.0
R_FAST = energy_sql("r", STEEP, "g", 2, 19, 1.5, 0.0, "n >= 0.4 * m", 8)
MS = "CASE WHEN {0} >= {1} THEN ({0} - {1}) * 40.0 END"


def ecg_sql() -> str:
    top = lambda a, b: f"-(max({{'v': v, 'i': -i}}) FILTER (WHERE i BETWEEN {a} AND {b}) OVER u).i"
    low = lambda a, b: f"(min({{'v': v, 'i': i}}) FILTER (WHERE i BETWEEN {a} AND {b}) OVER u).i"
    names = "q s r_on r_off p p_on p_off t t_on t_off".split()
    gated = {"pr_interval_ms": (MS.format("r_on", "p_on"), 400), "pr_segment_ms": (MS.format("r_on", "p_off"), 300), "st_interval_ms": (MS.format("t_off", "r_off"), 700), "st_segment_ms": (MS.format("t_on", "r_off"), 400)}
    qt = MS.format("t_off", "r_on")
    gated |= {"qt_interval_ms": (f"CASE WHEN rr IS NOT NULL THEN {qt} END", 900), "qtc_interval_ms": (f"CASE WHEN rr > 0 THEN ({qt}) / cbrt(rr / 25.0) END", 900)}
    return f"""WITH {WAVE}, {R_FAST}, b AS (SELECT fin, i AS r, i - lag(i) OVER w AS rr, lead(i) OVER w AS nx FROM r WINDOW w AS (PARTITION BY fin ORDER BY i)), s AS (SELECT *, r + least(11, coalesce(floor(0.6 * (nx - r)), 11)) AS stop FROM b),
    j AS (SELECT s.*, x.i, x.v FROM s JOIN x ON x.fin = s.fin AND x.i BETWEEN s.r - 8 AND s.r + 15),
      w1 AS (SELECT *, {low("r - 2", "r")} AS q, {low("r", "r + 2")} AS s FROM j WINDOW u AS (PARTITION BY fin, r)),
    w2 AS (SELECT *, {top("q - 1", "q")} AS r_on, {top("s", "s + 2")} AS r_off FROM w1 WINDOW u AS (PARTITION BY fin, r)),
      w3 AS (SELECT *, {top("r - 6", "r_on - 1")} AS p, {top("r_off + 1", "stop")} AS t FROM w2 WINDOW u AS (PARTITION BY fin, r)),
    w4 AS (SELECT *, {low("p - 2", "p")} AS p_on, {low("p", "r_on")} AS p_off, {low("r_off", "t")} AS t_on, {low("t", "t + 4")} AS t_off FROM w3 WINDOW u AS (PARTITION BY fin, r)),
    m AS (SELECT fin, r, max(rr) AS rr, {", ".join(f"max({n}) AS {n}" for n in names)} FROM w4 GROUP BY fin, r),
    f AS (SELECT fin, r AS i, p_off - p_on AS "P_duration", r_off - r_on AS "QRS_duration", t_off - t_on AS "T_duration", {MS.format("r", "p")} AS "atrialSys_phase", {MS.format("t_off", "r")} AS "ventSys_phase", {", ".join(f"{e} AS {n}" for n, (e, _) in gated.items())}, rr * 40.0 AS "T_rr_ms", 1500.0 / nullif(rr, 0) AS "HR_bpm" FROM m)
    SELECT fin, i, "P_duration", "QRS_duration", "T_duration", CAST("atrialSys_phase" AS DOUBLE) AS "atrialSys_phase", CAST("ventSys_phase" AS DOUBLE) AS "ventSys_phase", {", ".join(f"round(CASE WHEN avg({n}) OVER (PARTITION BY fin) < {most} THEN {n} END, 6) AS {n}" for n, (_, most) in gated.items())}, CAST("T_rr_ms" AS DOUBLE) AS "T_rr_ms", round("HR_bpm", 6) AS "HR_bpm" FROM f"""


@query(ecg_sql())
def ecg_intervals(spark, sf_dir):
    """Durations, intervals and segments of each heartbeat."""
    x = wave(spark, sf_dir)
    return rounded(fiducials.ecg_intervals(fiducials.ecg_landmarks(x, fiducials.r_peaks(x, KEYS, ECG_FS), KEYS, ECG_FS), KEYS, ECG_FS))


def beat_sql() -> str:
    """The features of ``beats`` on lists: ``x`` is a pulse's wave up to the next onset, whose first value is x[1]."""
    at = lambda c: f"CASE WHEN {c} >= 0 THEN x[{c} + 1] END"
    part = lambda a, b: f"list_slice(x, {a} + 1, {b})"
    total = lambda w: f"list_reduce({w}, lambda a, b: a + b)"  # noqa: E731  one by one, as the fold does
    area = lambda w: f"CASE WHEN len({w}) > 0 THEN {total(w)} - ({w}[1] + {w}[-1]) / 2 - list_min({w}) * (len({w}) - 1) END"
    near = lambda w, level: f"(list_position(list_transform({w}, lambda v: abs(v - ({level}))), list_min(list_transform({w}, lambda v: abs(v - ({level}))))) - 1)"
    when = lambda c, v: f"CASE WHEN {c} THEN {v} END"
    ratio = lambda a, b: f"({a}) / nullif(CAST({b} AS DOUBLE), 0)"
    level = lambda k: f"x0 + (xs - x0) * {k / 100}"
    times = {"os": "s", "so": "n - s", "sys": "nn", "dias": "n - nn", "ow": "w", "wo": "n - w"}
    pairs = {"good_s": ("os", "so"), "good_n": ("sys", "dias"), "good_w": ("ow", "wo")}
    halves = {"os": part("0", "s"), "so": part("s", "n"), "sys": part("0", "nn"), "dias": part("nn", "n"), "ow": part("0", "w"), "wo": part("w", "n")}
    base = {
        "Ton_off_ms": when("n * 100.0 < ci + 150", "n * 100.0"), "Tsp_sp_ms": when("tsp < ci + 150", "tsp"), "Delta_A_sp_sp": ratio("xs - lag(xs) OVER k", "first_value(xs) OVER k"),
        "max_upslope": when("w >= 1", "(x[w + 2] - x[w]) / 2"), "Delta_T_sd": when("(d - s) * 100.0 < 0.6 * ci", "(d - s) * 100.0"), "RI": ratio(f"{at('d')} - x0", "xs - x0"),
        "SI": ratio("1000 * (xs - x0)", "(d - s) * 100.0"), "Delta_A_dn_dp": ratio(f"{at('d')} - {at('nn')}", "x0"), "T_dn_dp_ms": "(d - nn) * 100.0",
        "Augmentation_index": when("c > s", ratio(f"{at('c')} - x0", "xs - x0")), "A_dn": f"{at('nn')} - x0", "DN_exists": "CAST(nn IS NOT NULL AS DOUBLE)", "A_sp": "xs - x0", "A_off": "x[-1] - x0",
        "A_AC": when("good_s", "xs - x[1]"), "mean_slope_os": when("good_s", ratio("xs - x[1]", "s")), "mean_slope_so": when("good_s", ratio("x[-1] - xs", "n - s")), "T_so_cd_ms": when("good_s", "(n - s) / CAST(n AS DOUBLE)"),
        "a_pulse": when("n * 100.0 < 1.75 * ci", area(part("0", "n"))), "lifted": when("n * 100.0 < ci + 180", f"list_transform({part('0', 'n')}, lambda v: v - list_min({part('0', 'n')}))"),
    }
    for good, own in pairs.items():
        base |= {f"T_{k}_ms": when(good, f"({times[k]}) * 100.0") for k in own} | {f"a_{k}": when(good, area(halves[k])) for k in own}
    for k in beats.WIDTHS:
        base[f"PW_{k}"] = when("good_s", f"(s - {near(halves['os'], level(k))} + {near(halves['so'], level(k))}) * 100.0")
    norm = lambda a, b: f"(quantile_cont(T_{a}_ms + T_{b}_ms, 0.5) OVER f / 100.0 * quantile_cont(\"A_AC\", 0.5) OVER f)"
    moment = lambda p: f"{total(f'list_transform(lifted, lambda v: pow(v - mean_ppg, {p}))')} / size"
    bins = "list_transform(lifted, lambda v: least(29, floor((v - list_min(lifted)) / nullif(list_max(lifted) - list_min(lifted), 0) * 30)))"
    share = f"list_transform(range(30), lambda b: len(list_filter({bins}, lambda y: y = b)) / CAST(size AS DOUBLE))"
    bits = f"coalesce(list_sum(list_transform(list_filter({share}, lambda q: q > 0), lambda q: -q * log2(q))), 0)"
    late = {
        "AUCos_nu": ratio("a_os", norm("os", "so")), "AUCso_nu": ratio("a_so", norm("os", "so")), "AUCow_nu": ratio("a_ow", norm("ow", "wo")), "AUCwo_nu": ratio("a_wo", norm("ow", "wo")),
        "AUC_sys_nu": ratio("a_sys", norm("sys", "sys")), "AUC_dias_nu": ratio("a_dias", norm("sys", "sys")), "AUC_pulse_nu": ratio("a_pulse", '(quantile_cont(CAST(n AS DOUBLE), 0.5) OVER f * quantile_cont("A_AC", 0.5) OVER f)'),
        "PR": ratio("60000.0", "\"Tsp_sp_ms\""), "variance_ppg": "m2", "std_ppg": "sqrt(m2)", "skewness_ppg": ratio("m3", "pow(m2, 1.5)"), "kurtosis_ppg": f"{ratio('m4', 'm2 * m2')} - 3", "energy_ppg": total("list_transform(lifted, lambda v: v * v)"),
        "median_ppg": "(list_sort(lifted)[(size - 1) // 2 + 1] + list_sort(lifted)[size // 2 + 1]) / 2", "entropy_ppg": f"CASE WHEN list_max(lifted) > list_min(lifted) THEN {bits} WHEN list_max(lifted) = list_min(lifted) THEN 0 END",
    }
    names = [n for n in beats.feature_names() if n != "IPA"]
    every = ", ".join(f'round("{n}" + 1e-7, 4) AS "{n}"' for n in names)  # off the ties of rounding, which engines settle differently
    return f"""WITH {MARKED}, l AS (SELECT m.fin, m.cycle, m.onset, list(c.v ORDER BY c.i) AS x, any_value(m.systolic - m.onset) AS s, any_value(m.notch - m.onset) AS nn, any_value(m.diastolic - m.onset) AS d,
      any_value(m.vpg_w - m.onset) AS w, any_value(m.apg_c - m.onset) AS c FROM marks m JOIN c ON c.fin = m.fin AND c.i BETWEEN m.onset AND m.stop GROUP BY m.fin, m.cycle, m.onset),
    t AS (SELECT *, len(x) - 1 AS n, x[s + 1] AS xs, (onset + s - lag(onset + s) OVER k) * 100.0 AS tsp, first_value(x[1]) OVER k AS x0 FROM l WINDOW k AS (PARTITION BY fin ORDER BY cycle)),
    u AS (SELECT *, quantile_cont(tsp, 0.5) OVER (PARTITION BY fin) AS ci FROM t),
    g AS (SELECT *, s * 100.0 < 0.8 * ci AND (n - s) * 100.0 < 0.8 * ci AS good_s, nn * 100.0 < 0.8 * ci AND (n - nn) * 100.0 < 0.8 * ci AS good_n, w * 100.0 < 0.5 * ci AND (n - w) * 100.0 < ci AS good_w FROM u),
    b AS (SELECT fin, cycle, n, {", ".join(f'{e} AS "{k}"' for k, e in base.items())} FROM g WINDOW k AS (PARTITION BY fin ORDER BY cycle)),
    h AS (SELECT *, len(lifted) AS size, {total("lifted")} / len(lifted) AS mean_ppg FROM b), q AS (SELECT *, {moment(2)} AS m2, {moment(3)} AS m3, {moment(4)} AS m4 FROM h),
    z AS (SELECT *, {", ".join(f'{e} AS "{k}"' for k, e in late.items())} FROM q WINDOW f AS (PARTITION BY fin))
    SELECT fin, CAST(cycle AS BIGINT) AS cycle, {every}, round({ratio('"AUC_dias_nu"', '"AUC_sys_nu"')} + 1e-7, 4) AS "IPA" FROM z"""


def pulse_features(spark, sf_dir):
    x, _, marks = landmarks(spark, sf_dir)
    return beats.pulse_features(fiducials.pulse_rows(marks, x, KEYS), "fin", FS)


@query(beat_sql())
def ppg_beat_features(spark, sf_dir):
    """Every feature of every pulse."""
    return pulse_features(spark, sf_dir).select("fin", "cycle", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in beats.feature_names()])


@query()
def ppg_beat_statistics(spark, sf_dir):
    """Sixteen statistics of each pulse feature of each encounter."""
    return stats.series_stats(beats.long_features(pulse_features(spark, sf_dir), "fin", beats.feature_names()), ["fin", "feature"], ["cycle"])


#: Four kinds of events stand for the four channels of a unit, which is ten encounters in a row; so units are bounded and their number grows with the table.
CHANNELS = {"II": "click", "Pleth": "view", "Resp": "purchase", "ABP": "signup"}
UNIT, ORDER = ["unit"], ["t", "fin", "sample_id"]


def unit_samples(spark, sf_dir):
    return samples(spark, sf_dir).where(F.col("channel").isin(*CHANNELS.values())).withColumn("unit", F.floor(F.col("fin") / 10))


@query()
def segment_features(spark, sf_dir):
    """The feature row of each unit: sixteen statistics of its beats, pulses, breaths and pressures, variability and pulse class."""
    return modalities.segment_rows(unit_samples(spark, sf_dir), UNIT, ORDER, FS, CHANNELS)


@query()
def segment_feature_series(spark, sf_dir):
    """Every value of every feature of each unit."""
    return modalities.features(unit_samples(spark, sf_dir), UNIT, ORDER, FS, CHANNELS)[0].select("key.unit", "feature", "i", F.round("value", 6).alias("value"))


@query()
def raw_segment_features(spark, sf_dir):
    """The feature row of each unit from raw channels: conditioned at five times their rate, with all variability indices of cleaned intervals."""
    return modalities.extract(unit_samples(spark, sf_dir), UNIT, ORDER, dict.fromkeys(CHANNELS, FS), CHANNELS, 5 * FS)


HR_PAIRS = f"""{NN}, q AS (SELECT fin, lag(nn) OVER (PARTITION BY fin ORDER BY t, sample_id) AS x, nn AS y FROM nn), g AS (SELECT fin, x, y, abs(y - x) AS d, abs({pi / 4} - atan(y / nullif(x, 0))) AS a FROM q WHERE x IS NOT NULL)"""


@query(
    f"""WITH {HR_PAIRS} SELECT fin, round(100 * sum(CASE WHEN y > x THEN d ELSE 0 END) / nullif(sum(d), 0), 6) AS "GI", round(100 * sum(CASE WHEN y > x THEN a ELSE 0 END) / nullif(sum(a), 0), 6) AS "SI",
    round(100 * sum(CASE WHEN y > x THEN a * (x * x + y * y) ELSE 0 END) / nullif(sum(a * (x * x + y * y)), 0), 6) AS "AI", round(100 * sum(CAST(y < x AS INT)) / CAST(nullif(sum(CAST(y <> x AS INT)), 0) AS DOUBLE), 6) AS "PI" FROM g GROUP BY fin"""
)
def hrv_shape(spark, sf_dir):
    """Asymmetry of the Poincare plot by distance, angle, area and count."""
    return rounded(hrv.shape(intervals(spark, sf_dir), KEYS, ["t", "sample_id"]))


@query(
    f"""WITH {NN}, {", ".join(f"w{m} AS (SELECT fin, stddev_samp(m) AS a, avg(s) AS i FROM (SELECT fin, avg(nn) AS m, stddev_samp(nn) AS s FROM nn GROUP BY fin, floor(t / {m * 8.64e10})) GROUP BY fin)" for m in (1, 2, 5))}
    SELECT w1.fin, {", ".join(f'round(w{m}.a, 6) AS "SDANN{m}", round(w{m}.i, 6) AS "SDNNI{m}"' for m in (1, 2, 5))} FROM w1 JOIN w2 ON w2.fin = w1.fin JOIN w5 ON w5.fin = w1.fin"""
)
def hrv_minutes(spark, sf_dir):
    """Variability between and within windows of three widths (a day stands for a minute)."""
    return rounded(hrv.windowed_contract(intervals(spark, sf_dir), KEYS, "t", 8.64e10))
