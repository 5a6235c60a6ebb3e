"""State-sequence features; the event types of an encounter in order of time are its states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import over
from ..operators import sequences
from .base import query, read

STATES = """s AS (SELECT user_id AS fin, event_type AS state, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS segment FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 36)"""
NAMES = ["click", "error", "purchase", "signup", "view"]
DUE = "3hr"


def states(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_type", "ts", "event_id")
    rows = e.select(F.col("user_id").alias("fin"), F.col("event_type").alias("state"), (F.row_number().over(over(["user_id"], ["ts", "event_id"])) - 1).alias("segment"))
    return sequences.block(rows, "segment", DUE)


LIST = ", ".join(f"('{x}')" for x in NAMES)
GRID = f"g AS (SELECT DISTINCT s.fin, v.state FROM s, (VALUES {LIST}) v(state))"


@query(
    f"""WITH {STATES}, {GRID}, f AS (SELECT fin, state, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY fin) AS DOUBLE) AS freq FROM s GROUP BY fin, state)
    SELECT g.fin, g.state, coalesce(n, 0) AS n, round(coalesce(freq, 0), 6) AS freq FROM g LEFT JOIN f ON f.fin = g.fin AND f.state = g.state"""
)
def state_freq(spark, sf_dir):
    """Share of each state."""
    return sequences.frequency(states(spark, sf_dir), ["fin"], "state", NAMES).withColumn("freq", F.round("freq", 6))


def transition_sql(sign: str) -> str:
    return f"""WITH {STATES}, {GRID}, t AS (SELECT fin, state AS from_state, lead(state) OVER (PARTITION BY fin ORDER BY segment) AS to_state FROM s),
    f AS (SELECT fin, from_state, to_state, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY fin) AS DOUBLE) AS share FROM t
      WHERE to_state IS NOT NULL AND from_state {sign} to_state GROUP BY fin, from_state, to_state)
    SELECT a.fin, a.state AS from_state, b.state AS to_state, coalesce(n, 0) AS n, round(coalesce(share, 0), 6) AS share FROM g a JOIN g b ON b.fin = a.fin AND a.state {sign} b.state LEFT JOIN f ON f.fin = a.fin AND f.from_state = a.state AND f.to_state = b.state"""


@query(transition_sql("<>"))
def cross_transition(spark, sf_dir):
    """Share of each change among all changes."""
    return sequences.transitions(states(spark, sf_dir), ["fin"], "segment", "state", same=False, states=NAMES).withColumn("share", F.round("share", 6))


@query(transition_sql("="))
def self_transition(spark, sf_dir):
    """Share of each stay among all stays."""
    return sequences.transitions(states(spark, sf_dir), ["fin"], "segment", "state", same=True, states=NAMES).withColumn("share", F.round("share", 6))


@query(
    f"""WITH {STATES}, {GRID}, a AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY fin ORDER BY segment) THEN 0 ELSE 1 END AS new, count(*) OVER (PARTITION BY fin) AS n FROM s),
    r AS (SELECT *, sum(new) OVER (PARTITION BY fin ORDER BY segment) AS run FROM a),
      l AS (SELECT fin, state, run, count(*) AS length, max(n) AS n FROM r GROUP BY fin, state, run),
    f AS (SELECT fin, state, max(length) AS longest, max(length) / CAST(max(n) AS DOUBLE) AS dwell FROM l GROUP BY fin, state)
    SELECT g.fin, g.state, coalesce(longest, 0) AS longest, round(coalesce(dwell, 0), 6) AS dwell FROM g LEFT JOIN f ON f.fin = g.fin AND f.state = g.state"""
)
def dwell(spark, sf_dir):
    """Longest run of each state."""
    return sequences.dwell(states(spark, sf_dir), ["fin"], "segment", "state", NAMES).withColumn("dwell", F.round("dwell", 6))


@query(f"WITH {STATES}, f AS (SELECT fin, state, count(*) / CAST(sum(count(*)) OVER (PARTITION BY fin) AS DOUBLE) AS p FROM s GROUP BY fin, state) SELECT fin, round(-sum(p * ln(p)), 6) AS entropy FROM f GROUP BY fin")
def state_entropy(spark, sf_dir):
    """Entropy of the states."""
    return sequences.entropy(states(spark, sf_dir), ["fin"], "state").withColumn("entropy", F.round("entropy", 6))


@query(
    f"""WITH {STATES}, f AS (SELECT fin, state, min(segment) / CAST(max(n) AS DOUBLE) AS p FROM (SELECT *, count(*) OVER (PARTITION BY fin) AS n FROM s) GROUP BY fin, state), g AS (SELECT DISTINCT s.fin, v.state FROM s, (VALUES {", ".join(f"('{x}')" for x in NAMES)}) v(state))
    SELECT g.fin, g.state, round(coalesce(f.p, 1.0), 6) AS first_lag FROM g LEFT JOIN f ON f.fin = g.fin AND f.state = g.state"""
)
def first_lag(spark, sf_dir):
    """Position of the first occurrence of each state."""
    return sequences.first_lag(states(spark, sf_dir), ["fin"], "segment", "state", NAMES).withColumn("first_lag", F.round("first_lag", 6))
