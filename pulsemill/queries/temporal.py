"""Joins in time, segmentation and interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import micros
from ..operators import signals, windows
from .base import SAMPLES, query, read, samples
from .series import SEGMENTED, SEGMENTS, WIDTH, segmented

HOUR = 3_600_000_000


@query(f"WITH {SAMPLES} SELECT fin, t, value, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY fin ORDER BY t, sample_id) AS rn FROM samples WHERE channel = 'error') WHERE rn = 1")
def index_event_first(spark, sf_dir):
    """The first error of each encounter."""
    s = samples(spark, sf_dir).where("channel = 'error'")
    return windows.first_per_key(s, ["fin"], ["t", "sample_id"]).select("fin", "t", "value", "sample_id")


@query(f"WITH {SAMPLES} SELECT fin, channel, t, value, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY fin, channel ORDER BY t DESC, sample_id DESC) AS rn FROM samples) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    """The latest sample of each encounter and channel."""
    return windows.first_per_key(samples(spark, sf_dir), ["fin", "channel"], ["t", "sample_id"], latest=True).select("fin", "channel", "t", "value", "sample_id")


@query(f"WITH {SEGMENTED} SELECT fin, segment, channel, count(*) AS n, round(sum(value), 4) AS total FROM segmented GROUP BY fin, segment, channel")
def segment_backward(spark, sf_dir):
    """Samples and their sum in each window counted back from the last error."""
    return segmented(spark, sf_dir).groupBy("fin", "segment", "channel").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    f"""WITH {SEGMENTED}, g AS (SELECT DISTINCT fin FROM segmented), k AS (SELECT fin, CAST(s AS BIGINT) AS segment FROM g, range({SEGMENTS}) r(s)),
    c AS (SELECT k.fin, k.segment, count(x.t) AS n FROM k LEFT JOIN segmented x ON x.fin = k.fin AND x.segment = k.segment GROUP BY k.fin, k.segment)
    SELECT fin, segment, n, min(CASE WHEN n >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY fin ORDER BY segment ROWS UNBOUNDED PRECEDING) = 1 AS valid FROM c"""
)
def segment_sticky_drop(spark, sf_dir):
    """Once a window has fewer than six samples it and all further ones are dropped."""
    s = segmented(spark, sf_dir)
    grid = s.select("fin").distinct().withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SEGMENTS - 1).cast("long"))))
    counts = grid.join(s.groupBy("fin", "segment").agg(F.count("*").alias("n")), ["fin", "segment"], "left").fillna(0, ["n"])
    return windows.sticky_drop(counts, ["fin"], "segment", "n", 6)


@query(
    f"""WITH {SAMPLES}, s AS (SELECT *, t - lag(t) OVER w AS step, row_number() OVER w AS i FROM samples WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id)),
    l AS (SELECT fin, coalesce(max(CASE WHEN step > {30 * HOUR} THEN i END), 0) AS last FROM s GROUP BY fin)
    SELECT s.fin, s.sample_id, s.t, s.value FROM s JOIN l USING (fin) WHERE i >= last"""
)
def gap_truncate_last(spark, sf_dir):
    """The samples after the last gap of more than thirty hours."""
    return windows.truncate_at_last_gap(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "t", 0, 30 * HOUR).select("fin", "sample_id", "t", "value")


@query(
    f"""WITH {SAMPLES}, s AS (SELECT fin, t - lag(t) OVER w AS step, row_number() OVER w AS i FROM samples WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id))
    SELECT fin, round(quantile_cont(step, 0.5) / 1e6, 3) AS step_s, count(step) AS steps FROM s WHERE i <= 40 GROUP BY fin"""
)
def sampling_rate_estimate(spark, sf_dir):
    """Median step of the first forty samples."""
    out = windows.sampling_step(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "t", 40)
    return out.select("fin", F.round(F.col("step") / 1e6, 3).alias("step_s"), "steps")


@query(
    f"""WITH {SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY fin, channel) AS n, row_number() OVER (PARTITION BY fin, channel ORDER BY t DESC, sample_id DESC) AS back FROM samples),
    m AS (SELECT *, min(n) OVER (PARTITION BY fin) AS least FROM n) SELECT fin, channel, sample_id, t, value FROM m WHERE back <= least"""
)
def align_to_shortest(spark, sf_dir):
    """All channels cut to the size of the shortest one, aligned at their ends."""
    return windows.align_at_end(samples(spark, sf_dir), ["fin"], "channel", ["t", "sample_id"]).select("fin", "channel", "sample_id", "t", "value")


@query(
    f"""WITH {SAMPLES}, o AS (SELECT fin, max(t) AS onset FROM samples WHERE channel = 'error' GROUP BY fin), g AS (SELECT fin, onset, CAST(s AS BIGINT) AS segment FROM o, range(4) r(s)),
    j AS (SELECT g.fin, g.segment, v.sample_id, v.value, v.t - g.onset - g.segment * {24 * HOUR} AS d FROM g JOIN samples v ON v.fin = g.fin AND v.channel = 'view'),
    r AS (SELECT *, row_number() OVER (PARTITION BY fin, segment ORDER BY CASE WHEN d < 0 THEN 0 ELSE 1 END, abs(d), sample_id) AS rn FROM j)
    SELECT fin, segment, sample_id, value, d AS difference FROM r WHERE rn = 1"""
)
def asof_nearest_signed(spark, sf_dir):
    """For each segment the charted value nearest before its reference time, else nearest after it."""
    s = samples(spark, sf_dir)
    onset = s.where("channel = 'error'").groupBy("fin").agg(F.max("t").alias("onset"))
    grid = onset.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    charted = s.where("channel = 'view'").select("fin", "sample_id", "value", "t")
    grid = grid.withColumn("at", F.col("onset") + F.col("segment") * (24 * HOUR))
    return windows.nearest_signed(grid, charted, "fin", ["segment"], "at", "t", ["sample_id"], ["value"]).select("fin", "segment", "sample_id", "value", "difference")


@query(
    f"""WITH {SAMPLES}, d AS (SELECT s.fin, s.sample_id, s.t, min(o.t) - s.t AS delay FROM samples s LEFT JOIN samples o ON o.fin = s.fin AND o.channel = 'purchase' AND o.t > s.t WHERE s.channel = 'click' GROUP BY s.fin, s.sample_id, s.t),
    m AS (SELECT fin, quantile_cont(step, 0.5) AS med FROM (SELECT fin, t - lag(t) OVER (PARTITION BY fin ORDER BY t) AS step FROM samples
      WHERE channel = 'purchase') GROUP BY fin)
    SELECT d.fin, d.sample_id, round(delay / 3.6e9, 6) AS delay_hours FROM d JOIN m ON d.fin = m.fin WHERE delay < 0.85 * med"""
)
def next_event_within(spark, sf_dir):
    """Delay from each click to the next purchase, if below 0.85 of the median interval of purchases."""
    s = samples(spark, sf_dir)
    delays = windows.next_within(s, ["fin"], ["t", "sample_id"], "t", F.col("channel") == "click", F.col("channel") == "purchase")
    median = signals.intervals(s.where("channel = 'purchase'"), ["fin"], ["t"], "t", 1.0).groupBy("fin").agg(F.percentile("interval", 0.5).alias("median"))
    return delays.join(median, "fin").where(F.col("delay") < 0.85 * F.col("median")).select("fin", "sample_id", F.round(F.col("delay") / 3.6e9, 6).alias("delay_hours"))


@query(
    f"""WITH {SAMPLES} SELECT s.fin, s.sample_id, s.t, (SELECT max(p.t) FROM samples p WHERE p.fin = s.fin AND p.channel = 'view' AND p.t < s.t) AS previous,
    (SELECT min(p.t) FROM samples p WHERE p.fin = s.fin AND p.channel = 'click' AND p.t > s.t) AS following FROM samples s WHERE s.channel = 'error'"""
)
def prev_next_landmark(spark, sf_dir):
    """Around each error the last view before it and the first click after it."""
    is_ = lambda x: F.col("channel") == x
    out = windows.neighbours(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "t", is_("error"), is_("view"), is_("click"))
    return out.select("fin", "sample_id", "t", "previous", "following")


@query(
    f"""WITH {SAMPLES}, b AS (SELECT fin, t AS start, lead(t) OVER (PARTITION BY fin ORDER BY t, sample_id) AS stop, row_number() OVER (PARTITION BY fin ORDER BY t, sample_id) AS cycle FROM samples WHERE channel = 'signup')
    SELECT b.fin, b.cycle, b.start, b.stop, min(s.t) AS landmark FROM b LEFT JOIN samples s ON s.fin = b.fin AND s.channel = 'click' AND s.t > b.start AND s.t < b.stop WHERE b.stop IS NOT NULL GROUP BY b.fin, b.cycle, b.start, b.stop"""
)
def band_join_cycle_first(spark, sf_dir):
    """The first click inside each interval between two signups."""
    out = windows.first_in_cycle(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "t", F.col("channel") == "signup", F.col("channel") == "click")
    return out.select("fin", "cycle", "start", F.col("end").alias("stop"), "landmark")


@query(
    f"""WITH {SAMPLES}, f AS (SELECT fin, min(t) AS begin FROM samples WHERE channel = 'view' GROUP BY fin),
    l AS (SELECT s.fin, s.channel, s.t, row_number() OVER (PARTITION BY s.fin, s.channel ORDER BY s.t, s.sample_id) AS k FROM samples s
      JOIN f USING (fin) WHERE s.channel = 'view' OR (s.channel = 'click' AND s.t > f.begin))
    SELECT a.fin, a.k, round((b.t - a.t) / 3.6e9, 6) AS hours FROM l a JOIN l b ON a.fin = b.fin AND a.k = b.k AND a.channel = 'view' AND b.channel = 'click'"""
)
def zip_align_cycles(spark, sf_dir):
    """The k-th view with the k-th click after the first view."""
    out = windows.zip_series(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "channel", "view", "click", "t")
    return out.select("fin", F.col("k").cast("long").alias("k"), F.round((F.col("b") - F.col("a")) / 3.6e9, 6).alias("hours"))


STAYS = """stays AS (SELECT user_id AS fin, event_type AS unit, date_trunc('day', ts) AS begin, date_trunc('day', lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS stop FROM events)"""


def stays(spark, sf_dir):
    """Unit stays: from the day of an event to the day of the next one."""
    e = read(spark, sf_dir, "events", "user_id", "event_type", "ts", "event_id")
    nxt = F.lead("ts").over(windows.over(["user_id"], ["ts", "event_id"]))
    return e.select(F.col("user_id").alias("fin"), F.col("event_type").alias("unit"), F.expr("date_trunc('day', ts)").alias("begin"), nxt.alias("n")).select(
        "fin", "unit", "begin", F.expr("date_trunc('day', n)").alias("stop")
    )


@query(
    f"""WITH {STAYS}, d AS (SELECT DISTINCT fin, unit, begin, stop FROM stays WHERE stop > begin),
    a AS (SELECT *, CASE WHEN lag(stop) OVER w = begin THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY fin, unit ORDER BY begin, stop)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY fin, unit ORDER BY begin, stop) AS island, row_number() OVER (PARTITION BY fin, unit ORDER BY begin, stop) AS rn FROM a)
    SELECT fin, unit, epoch_us(min(begin)) AS begin_us, epoch_us(max_by(stop, rn)) AS stop_us, count(*) AS parts FROM i GROUP BY fin, unit, island"""
)
def interval_coalesce(spark, sf_dir):
    """Stays of a unit whose end is the next one's begin, joined."""
    distinct = stays(spark, sf_dir).where("stop > begin").distinct()
    out = windows.coalesce_intervals(distinct, ["fin", "unit"], "begin", "stop")
    return out.select("fin", "unit", micros("begin").alias("begin_us"), micros("stop").alias("stop_us"), "parts")


@query(
    f"""WITH {SAMPLES}, v AS (SELECT fin, sample_id, t, floor(value / 40) AS level FROM samples),
    a AS (SELECT *, row_number() OVER w AS i, CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY fin ORDER BY i) AS island FROM a)
    SELECT fin, CAST(min(level) AS DOUBLE) AS value, min(i) AS first, max(i) AS last, count(*) AS length FROM g GROUP BY fin, island HAVING count(*) >= 3"""
)
def flatline_runs(spark, sf_dir):
    """Runs of three samples or more on one level."""
    s = samples(spark, sf_dir).withColumn("level", F.floor(F.col("value") / 40).cast("double"))
    return signals.flat_runs(s, ["fin"], ["t", "sample_id"], "level", 3).select("fin", "value", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "length")


@query(
    f"""WITH {SAMPLES}, g AS (SELECT *, (t - lag(t) OVER w) / 1e6 AS gap FROM samples WINDOW w AS (PARTITION BY fin ORDER BY t, sample_id))
    SELECT fin, round(max(gap), 3) AS longest_s, round(avg(gap), 3) AS mean_s FROM g GROUP BY fin"""
)
def time_gaps(spark, sf_dir):
    """Longest and mean gap of each series."""
    out = signals.intervals(samples(spark, sf_dir), ["fin"], ["t", "sample_id"], "t", 1e6)
    return out.groupBy("fin").agg(F.round(F.max("interval"), 3).alias("longest_s"), F.round(F.avg("interval"), 3).alias("mean_s"))


@query("SELECT event_id, epoch_us(CAST(date_trunc('second', ts) AS TIMESTAMP)) AS origin_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_attr_time(spark, sf_dir):
    """A JSON attribute, and the time cut to seconds from its text."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "props")
    text = F.substring(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), 1, 19)
    return e.select("event_id", micros(F.to_timestamp_ntz(text)).alias("origin_us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {SEGMENTED} SELECT DISTINCT s.fin, s.segment, o.onset - (s.segment + 1) * {WIDTH} AS begin_us, o.onset - s.segment * {WIDTH} AS stop_us FROM segmented s JOIN onset o ON o.fin = s.fin")
def segment_edges(spark, sf_dir):
    """Begin and end of each segment."""
    begin, stop = windows.segment_edges(F.col("segment"), F.col("onset"), WIDTH)
    return segmented(spark, sf_dir).select("fin", "segment", begin.alias("begin_us"), stop.alias("stop_us")).distinct()
