"""Cohort joins, event incidence, day-level outcomes and event-free days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import days_floor, micros
from ..operators import outcomes, relational
from .base import query, read

# Encounters are orders: the order date is the onset, the shipping of a line is an event.
# shock: price over 90000, ventilation: returned lines, death: the largest quantity of a late line.
EVENTS_SQL = """ev AS (SELECT o.o_orderkey AS fin, o.o_custkey AS study, o.o_orderdate AS onset, l.l_shipdate AS at,
  CAST(floor((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000) AS BIGINT) AS day,
  l.l_extendedprice > 90000 AS vp, l.l_returnflag = 'R' AS vent, l.l_quantity >= 50 AS death
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)"""
HORIZONS = (28, 7, 2)


def cohort_events(spark, sf_dir):
    """In as many tasks as ``spark.sql.shuffle.partitions`` says: joined into few by their compressed bytes, tasks would grow with the table."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_quantity")
    o, li = o.repartition(parts, "o_orderkey"), li.repartition(parts, "l_orderkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_orderkey").alias("fin"), F.col("o_custkey").alias("study"), F.col("o_orderdate").alias("onset"), F.col("l_shipdate").alias("at"),
        days_floor("l_shipdate", "o_orderdate").alias("day"),
        (F.col("l_extendedprice") > 90000).alias("vp"), (F.col("l_returnflag") == "R").alias("vent"), (F.col("l_quantity") >= 50).alias("death"),
    )


@query(
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/')[1] AS study,
    CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS fin, CAST(len(url) - len(replace(url, '/', '')) AS INTEGER) AS parts FROM pages"""
)
def catalogue_parse_url(spark, sf_dir):
    """The parts of a catalogue name."""
    return relational.parse_names(read(spark, sf_dir, "pages", "page_id", "url"), "url")


@query("SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000")
def cohort_match_left(spark, sf_dir):
    """Every member of the cohort with the files that belong to it, if any."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").where("o_totalprice > 400000")
    return relational.match(read(spark, sf_dir, "customer", "c_custkey", "c_name"), o, ["c_custkey"], ["o_custkey"], "left")


@query("SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 400000")
def cohort_match_inner(spark, sf_dir):
    """Only the members with a file."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").where("o_totalprice > 400000")
    return relational.match(read(spark, sf_dir, "customer", "c_custkey", "c_name"), o, ["c_custkey"], ["o_custkey"], "inner")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_membership(spark, sf_dir):
    """Rows whose key belongs to a set."""
    members = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'MACHINERY'")
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(members, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query(
    """SELECT l.l_orderkey, l.l_partkey, l.l_quantity, p.first_ship FROM lineitem l LEFT JOIN
    (SELECT l_orderkey, l_partkey, epoch_us(min(l_shipdate)) AS first_ship FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) p ON p.l_orderkey = l.l_orderkey AND p.l_partkey = l.l_partkey"""
)
def multi_key_left_join(spark, sf_dir):
    """A left join on two keys."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag")
    first = li.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey").agg(micros(F.min("l_shipdate")).alias("first_ship"))
    return li.select("l_orderkey", "l_partkey", "l_quantity").join(first, ["l_orderkey", "l_partkey"], "left")


@query("SELECT o.o_orderkey, s.l_suppkey FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) s ON s.l_orderkey = o.o_orderkey WHERE o.o_totalprice > 300000")
def distinct_build_join(spark, sf_dir):
    """A left join whose other side is made distinct first."""
    side = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").distinct()
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").where("o_totalprice > 300000").select("o_orderkey")
    return relational.match(o, side, ["o_orderkey"], ["l_orderkey"], "left")


@query(
    """SELECT a.l_orderkey AS fin, a.l_suppkey AS study_x, b.l_suppkey AS study_y, a.l_linenumber AS left_line, b.l_linenumber AS right_line FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'"""
)
def suffix_inner_join(spark, sf_dir):
    """An inner join of two tables that both carry the study column."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    pick = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("fin"), F.col("l_suppkey").alias("study"), F.col("l_linenumber").alias("line"))
    out = relational.suffixed_join(pick("R"), pick("A"), ["fin"])
    return out.select("fin", "study_x", "study_y", F.col("line_x").alias("left_line"), F.col("line_y").alias("right_line"))


@query(
    """WITH e AS (SELECT user_id AS fin, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_type, max(value) AS v FROM events GROUP BY 1, 2, 3)
    SELECT a.fin, a.day, a.v AS sbp, b.v AS rr, c.v AS gcs FROM e a LEFT JOIN e b ON b.fin = a.fin AND b.day = a.day AND b.event_type = 'click' LEFT JOIN e c ON c.fin = a.fin AND c.day = a.day AND c.event_type = 'error' WHERE a.event_type = 'view'"""
)
def timestamp_equal_join(spark, sf_dir):
    """Values charted at the same time, by two left joins on keys and time (here one aggregate: the build sides are the same table)."""
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_type", "value")
    keyed = e.select(F.col("user_id").alias("fin"), F.floor(micros("ts") / 86_400_000_000).cast("long").alias("day"), "event_type", "value")
    return relational.aligned_values(keyed, ["fin", "day"], "event_type", "value", {"view": "sbp", "click": "rr", "error": "gcs"}).where("sbp is not null")


@query("SELECT fin, onset_us, at_us, CASE WHEN at_us IS NULL THEN NULL WHEN at_us > onset_us THEN at_us END AS t_post, CASE WHEN at_us <= onset_us THEN at_us END AS t_pre FROM (SELECT user_id AS fin, max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) AS onset_us, max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS at_us FROM events GROUP BY user_id)")
def pre_post_split(spark, sf_dir):
    """An event's time as before or after the onset; without event both are null."""
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_type")
    last = lambda k: F.max(F.when(F.col("event_type") == k, micros("ts")))
    rows = e.groupBy(F.col("user_id").alias("fin")).agg(last("error").alias("onset_us"), last("purchase").alias("at_us"))
    return outcomes.pre_post(rows, "onset_us", "at_us")


@query(
    "SELECT round(100.0 * avg(a), 4) AS vp_pct, round(100.0 * avg(b), 4) AS vent_pct, round(100.0 * avg(c), 4) AS death_pct FROM (SELECT fin, max(CAST(vp AS INT)) AS a, max(CAST(vent AS INT)) AS b, max(CAST(death AS INT)) AS c FROM ev GROUP BY fin)".join(
        [f"WITH {EVENTS_SQL} ", ""]
    )
)
def incidence_pct(spark, sf_dir):
    """Percentage of encounters with each event."""
    out = outcomes.incidence(cohort_events(spark, sf_dir), "fin", {"vp": F.col("vp"), "vent": F.col("vent"), "death": F.col("death")})
    return out.select(*[F.round(c, 4).alias(c) for c in ("vp_pct", "vent_pct", "death_pct")])


@query(f"WITH {EVENTS_SQL} SELECT fin, CAST(max(CAST(death AS INT)) AS INTEGER) AS death, CAST(max(CAST(vp AND day <= 28 AS INT)) AS INTEGER) AS shock_28 FROM ev GROUP BY fin")
def status_flags_max(spark, sf_dir):
    """Whether an encounter ever has a flag."""
    return outcomes.ever(cohort_events(spark, sf_dir), "fin", {"death": F.col("death"), "shock_28": F.col("vp") & (F.col("day") <= 28)})


GRID_SQL = f"""{EVENTS_SQL}, grid AS (SELECT fin, day, {", ".join(f"CAST(max(CASE WHEN {k} AND day BETWEEN 0 AND {h} THEN 1 ELSE 0 END) AS INTEGER) AS {k}_{h}" for k in ("vp", "vent") for h in HORIZONS)},
  {", ".join(f"CAST(max(CASE WHEN death AND day <= {h} THEN 1 ELSE 0 END) AS INTEGER) AS death_{h}" for h in HORIZONS)} FROM ev WHERE vp OR vent OR death GROUP BY fin, day)"""


def grid(spark, sf_dir):
    e = cohort_events(spark, sf_dir)
    return outcomes.event_grid(e, "fin", "day", {"vp": F.col("vp"), "vent": F.col("vent")}, {"death": F.col("death")}, HORIZONS)


@query(f"WITH {GRID_SQL} SELECT * FROM grid")
def full_outer_event_grid(spark, sf_dir):
    """The encounter-day grid of all events: one aggregate instead of a chain of full outer joins."""
    return grid(spark, sf_dir)


@query(f"WITH {EVENTS_SQL} SELECT fin, day, count(*) AS n, " + ", ".join(f"CAST(max(CASE WHEN vp AND day BETWEEN 0 AND {h} THEN 1 ELSE 0 END) AS INTEGER) AS vp_{h}" for h in (28, 7, 2, 1)) + " FROM ev GROUP BY fin, day")
def horizon_flags_1_2_7_28(spark, sf_dir):
    """Flags of an event within each horizon by day."""
    e = cohort_events(spark, sf_dir)
    flags = outcomes.horizon_flags("vp", F.col("vp"), "day", (28, 7, 2, 1))
    return e.groupBy("fin", "day").agg(F.count("*").alias("n"), *[F.max(c).alias(k) for k, c in flags.items()])


@query(
    f"WITH {GRID_SQL}, g AS (SELECT fin, "
    + ", ".join(f"CASE WHEN max(death_{h}) = 1 THEN 0 ELSE greatest(0, {h} - sum({k}_{h})) END AS {k}_free_{h}" for k in ("vp", "vent") for h in HORIZONS)
    + " FROM grid GROUP BY fin) SELECT o.o_orderkey AS fin, "
    + ", ".join(f"CAST(coalesce({k}_free_{h}, 0) AS BIGINT) AS {k}_free_{h}" for k in ("vp", "vent") for h in HORIZONS)
    + " FROM orders o LEFT JOIN g ON g.fin = o.o_orderkey"
)
def free_days_28_7_2(spark, sf_dir):
    """Event-free days: 0 after a death within the horizon, else the horizon less the days with the event; 0 for encounters without any event."""
    cohort = read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("fin"))
    return outcomes.free_days(grid(spark, sf_dir), cohort, "fin", ("vp", "vent"), "death", HORIZONS)


@query(
    """SELECT c.c_mktsegment AS grp, count(*) AS n, round(avg(o.o_totalprice), 3) AS mean_price, round(quantile_cont(o.o_totalprice, 0.5), 3) AS median_price, round(avg(CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS rate
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1"""
)
def outcomes_by_group(spark, sf_dir):
    """Rate, mean and median of outcomes by group."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    rows = relational.match(o, c, ["o_custkey"], ["c_custkey"], "inner").select(F.col("c_mktsegment").alias("grp"), "o_totalprice", (F.col("o_orderstatus") == "F").cast("double").alias("died"))
    out = outcomes.by_group(rows, "grp", means={"mean_price": "o_totalprice", "rate": "died"}, medians={"median_price": "o_totalprice"})
    return out.select("grp", "n", F.round("mean_price", 3).alias("mean_price"), F.round("median_price", 3).alias("median_price"), F.round("rate", 6).alias("rate"))


@query(
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT month, sum(n) AS total FROM m GROUP BY month)
    SELECT m.month, """
    + ", ".join(f"CAST(coalesce(max(CASE WHEN s = '{s}' THEN n END), 0) AS BIGINT) AS n_{s}, round(coalesce(max(CASE WHEN s = '{s}' THEN 100.0 * n / total END), 0), 4) AS pct_{s}" for s in "FOP")
    + " FROM m JOIN t USING (month) GROUP BY m.month"
)
def monthly_timeline_pct(spark, sf_dir):
    """Counts and shares of each group by month."""
    o = read(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return outcomes.timeline(o, "month", "o_orderstatus", ["F", "O", "P"])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def full_row_distinct(spark, sf_dir):
    """Distinct rows."""
    return read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query("SELECT event_type, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def value_counts(spark, sf_dir):
    """Rows and share of each value."""
    from ..operators.stats import value_counts as counts

    return counts(read(spark, sf_dir, "events", "event_type"), "event_type").select("event_type", "n", F.round("share", 6).alias("share"))


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders")
def count_distinct(spark, sf_dir):
    """Exact numbers of distinct values."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderdate")
    return o.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn <= 3")
def top_k_per_group(spark, sf_dir):
    """The three largest rows of each group."""
    return relational.top_k(read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, "rn")


@query(
    """SELECT 'order' AS kind, o_orderkey AS key, o_totalprice AS amount, NULL::DOUBLE AS discount FROM orders WHERE o_totalprice > 450000
    UNION ALL SELECT 'line', l_orderkey, l_extendedprice, l_discount FROM lineitem WHERE l_extendedprice > 94000"""
)
def union_by_name(spark, sf_dir):
    """A union of tables with different columns; missing ones are null."""
    o = read(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    li = read(spark, sf_dir, "lineitem").where("l_extendedprice > 94000")
    li = li.select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("amount"), F.col("l_discount").alias("discount"))
    return relational.project_to(o.unionByName(li, allowMissingColumns=True), {"kind": "string", "key": "long", "amount": "double", "discount": "double"})


@query(
    """SELECT fin, day, CAST(gcs < 15 AS INT) + CAST(rr >= 22 AS INT) + CAST(sbp <= 100 AS INT) AS total, CAST(gcs < 15 AS INT) AS gcs_flag, CAST(rr >= 22 AS INT) AS rr_flag, CAST(sbp <= 100 AS INT) AS sbp_flag FROM
    (SELECT user_id AS fin, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, max(CASE WHEN event_type = 'error' THEN value END) AS gcs, max(CASE WHEN event_type = 'click' THEN value END) AS rr, max(CASE WHEN event_type = 'view' THEN value END) AS sbp FROM events WHERE event_type IN ('error', 'click', 'view') GROUP BY 1, 2)"""
)
def bedside_score(spark, sf_dir):
    """Three bedside flags and their sum, null where one is missing."""
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_type", "value")
    keyed = e.select(F.col("user_id").alias("fin"), F.floor(micros("ts") / 86_400_000_000).cast("long").alias("day"), "event_type", "value")
    rows = relational.aligned_values(keyed, ["fin", "day"], "event_type", "value", {"error": "gcs", "click": "rr", "view": "sbp"})
    return outcomes.bedside_flags(rows, ["fin", "day"], "gcs", "rr", "sbp")


@query("SELECT l_orderkey, l_linenumber, greatest(a, b) AS onset_us FROM (SELECT l.l_orderkey, l.l_linenumber, epoch_us(l.l_shipdate) AS a, CASE WHEN o.o_totalprice > 200000 THEN epoch_us(o.o_orderdate) + 2592000000000 END AS b FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)")
def greatest_timestamp(spark, sf_dir):
    """The later of two times; a missing one doesn't count."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    later = F.when(F.col("o_totalprice") > 200000, micros("o_orderdate") + 2_592_000_000_000)
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.greatest(micros("l_shipdate"), later).alias("onset_us"))
