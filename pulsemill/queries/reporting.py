"""Group profiles, importance tables and report text; embeddings and their labels stand in for phenotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes, profiles, reports
from .base import query, read

LONG = "long AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature, CAST(UNNEST(embedding) AS DOUBLE) AS value FROM embeddings)"
IMPORTANCE = f"{LONG}, imp AS (SELECT label, feature, avg(abs(value)) AS importance FROM long GROUP BY label, feature), top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY importance DESC, feature) AS rank FROM imp)"


def long_(spark, sf_dir):
    return profiles.long_features(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


def importance(spark, sf_dir):
    return profiles.mean_absolute(long_(spark, sf_dir), "label")


@query(
    f"""WITH {LONG}, o AS (SELECT feature, avg(value) AS overall FROM long GROUP BY feature), c AS (SELECT label, feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY label, feature)
    SELECT label, feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(overall, 6) AS overall, CASE WHEN mean - overall > 0.01 THEN 'up' WHEN mean - overall < -0.01 THEN 'down' ELSE 'same' END AS direction FROM c JOIN o USING (feature)"""
)
def cluster_profile_direction(spark, sf_dir):
    """Mean, deviation and direction of each feature by group."""
    out = profiles.group_profile(long_(spark, sf_dir), "label", slack=0.01)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "overall")})


@query(f"WITH {IMPORTANCE} SELECT label, feature, CAST(rank AS INTEGER) AS rank, round(importance, 6) AS importance FROM top WHERE rank <= 10")
def top10_by_importance(spark, sf_dir):
    """The ten most important features of each group."""
    out = profiles.top_features(importance(spark, sf_dir), "label", 10)
    return out.select("label", "feature", "rank", F.round("importance", 6).alias("importance"))


@query(f"WITH {IMPORTANCE}, m AS (SELECT *, importance / max(importance) OVER (PARTITION BY label) AS x FROM imp) SELECT label, feature, CASE WHEN x >= 0.66 THEN 'High' WHEN x >= 0.33 THEN 'Moderate' ELSE 'Low' END AS grade FROM m")
def importance_grade(spark, sf_dir):
    """Grade of each feature in its group."""
    return profiles.grade(importance(spark, sf_dir), "label").select("label", "feature", "grade")


@query(
    f"WITH {IMPORTANCE}, t AS (SELECT * FROM top WHERE rank <= 15) SELECT feature, count(*) AS groups, "
    + ", ".join(f"CAST(max(CASE WHEN label = {g} THEN 16 - rank ELSE 0 END) AS INTEGER) AS g{g}" for g in range(10))
    + " FROM t GROUP BY feature HAVING count(*) > 1"
)
def rank_matrix_shared(spark, sf_dir):
    """Reverse ranks of the features that several groups share."""
    return profiles.shared_ranks(profiles.top_features(importance(spark, sf_dir), "label", 15), "label", range(10), 15)


@query(f"WITH {LONG}, c AS (SELECT label, feature, avg(value) AS m, count(*) AS n FROM long GROUP BY label, feature) SELECT label, feature, round((1 / (1.0 / n + 1e-10)) * abs(m), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (1 / (1.0 / n + 1e-10)) * abs(m) DESC, feature) AS rn FROM c) WHERE rn <= 5")
def fallback_score_topk(spark, sf_dir):
    """The five features with the best fallback score of each group."""
    cells = long_(spark, sf_dir).groupBy("label", "feature").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    scored = cells.withColumn("importance", profiles.fallback_score(1.0 / F.col("n"), "m"))
    return profiles.top_features(scored, "label", 5).select("label", "feature", F.round("importance", 6).alias("score"))


#: Fixed keywords of each category, in order.
KEYWORDS = {"PPG": ["ring", "widget"], "ECG": ["bolt", "gear"], "HRV": ["red", "blue"]}


@query(
    "SELECT category, count(*) AS n FROM (SELECT CASE WHEN p_name ILIKE '%ring%' OR p_name ILIKE '%widget%' THEN 'PPG' WHEN p_name ILIKE '%bolt%' OR p_name ILIKE '%gear%' THEN 'ECG' WHEN p_name ILIKE '%red%' OR p_name ILIKE '%blue%' THEN 'HRV' ELSE 'Other' END AS category FROM part) GROUP BY category"
)
def feature_category_match(spark, sf_dir):
    """Features by the first category whose keyword their name holds."""
    return read(spark, sf_dir, "part", "p_name").groupBy(profiles.category("p_name", KEYWORDS).alias("category")).agg(F.count("*").alias("n"))


@query(
    "WITH k(position, key, context) AS (VALUES (0, 'ring', 'round'), (1, 'red', 'warm'), (2, 'widget', 'thing')) SELECT p_partkey, p_name, min_by(context, position) AS context FROM part LEFT JOIN k ON contains(lower(p_name), key) GROUP BY p_partkey, p_name"
)
def feature_context_lookup(spark, sf_dir):
    """The context of the first key contained in a name."""
    contexts = spark.createDataFrame([(0, "ring", "round"), (1, "red", "warm"), (2, "widget", "thing")], "position int, key string, context string")
    return profiles.lookup_context(read(spark, sf_dir, "part", "p_partkey", "p_name"), "p_name", contexts)


@query(
    f"""WITH {IMPORTANCE}, g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), f AS (SELECT label, string_agg(CAST(feature AS VARCHAR), ', ' ORDER BY rank) AS all_features, string_agg(CASE WHEN rank <= 3 THEN CAST(feature AS VARCHAR) END, ', ' ORDER BY rank) AS top_features FROM top WHERE rank <= 10 GROUP BY label)
    SELECT g.label, 'Phenotype_' || g.label AS name, g.n, format('{{:.1f}}%', 100.0 * n / sum(n) OVER ()) AS percentage, top_features, all_features FROM g LEFT JOIN f USING (label)"""
)
def phenotype_comparison(spark, sf_dir):
    """The comparison table of the groups."""
    groups = read(spark, sf_dir, "embeddings", "label").groupBy("label").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("Phenotype_"), F.col("label")))
    return profiles.comparison(groups, "label", "name", profiles.top_features(importance(spark, sf_dir), "label", 10))


@query(
    """SELECT label, 'PHENOTYPE ' || label || ': Phenotype_' || label || chr(10) || 'Patients: ' || format('{:,}', n) || ' (' || format('{:.1f}', 100.0 * n / sum(n) OVER ()) || '%)' || chr(10) || 'Key features: none' AS card FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)"""
)
def summary_cards(spark, sf_dir):
    """The text of each group's card."""
    groups = read(spark, sf_dir, "embeddings", "label").groupBy("label").agg(F.count("*").alias("n"))
    share = 100 * F.col("n") / F.sum("n").over(profiles.over([]))
    label = F.col("label").cast("string")
    return groups.select("label", profiles.card(label, F.concat(F.lit("Phenotype_"), label), F.col("n"), share, F.lit("none")).alias("card"))


@query(
    r"""WITH t AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)
    SELECT item_id, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 40 THEN a || ' ' || x ELSE a || chr(10) || x END) END AS wrapped FROM t"""
)
def wrap_text(spark, sf_dir):
    """Texts of the benchmark in lines of forty characters."""
    return read(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", profiles.wrap("text", 40).alias("wrapped"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN len(b) > 60 THEN substr(b, 1, 60) || '...' ELSE b END AS section FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_extract('Name:' || chr(10) || text || chr(10) || 'End:', '(?s)(?:^|\n)Name:[ \t]*\n?(.*?)(?:\n[^\n]*:[ \t]*(?:\n|$)|$)', 1), '\s+', ' ', 'g')) AS b FROM conversations)"""
)
def section_extract(spark, sf_dir):
    """The text under a header, cut at sixty characters."""
    text = F.concat(F.lit("Name:\n"), F.col("text"), F.lit("\nEnd:"))
    return read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", profiles.section(text, "Name", 60).alias("section"))


@query(
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment || ' two' WHEN 2 THEN c_mktsegment || ' three' WHEN 3 THEN c_mktsegment || ' profile of the group' WHEN 4 THEN 'Group ' || c_mktsegment WHEN 5 THEN c_mktsegment || ' six' ELSE 'Unnamed Phenotype' END AS name FROM customer"""
)
def name_extract(spark, sf_dir):
    """A name from an interpretation: labelled, quoted, in a descriptive line, behind a number, or the default."""
    s = F.col("c_mktsegment")
    forms = [
        F.concat(F.lit("text\nPhenotype Name: "), s, F.lit("\nmore")),
        F.concat(F.lit('### 1. PHENOTYPE NAME: "'), s, F.lit(' two"\n"other name"')),
        F.concat(F.lit('A "name" is not "'), s, F.lit(' three" here')),
        F.concat(F.lit("## 2. "), s, F.lit(" profile of the group **\nmore")),
        F.concat(F.lit("no\n1. 'Group "), s, F.lit("'")),
        F.concat(F.lit('PHENOTYPE NAME: "Pheno"\n"'), s, F.lit(' six"')),
        F.lit("nothing here"),
    ]
    text = F.element_at(F.array(*forms), (F.col("c_custkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select("c_custkey", profiles.phenotype_name(text).alias("name"))


@query("""SELECT '{"label":' || label || ',"n_patients":' || count(*) || '}' AS value FROM embeddings GROUP BY label""")
def summary_json(spark, sf_dir):
    """One JSON line per group."""
    groups = read(spark, sf_dir, "embeddings", "label").groupBy("label").agg(F.count("*").alias("n_patients"))
    return profiles.summary_document(groups, ["label", "n_patients"])


@query(
    """WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), s AS (SELECT sum(n) AS total, count(*) AS k FROM g),
    d AS (SELECT string_agg('"' || label || '":{"cluster_id":' || label || ',"phenotype_name":"Phenotype_' || label || '","n_patients":' || n || ',"percentage":' || CAST(100 * n / CAST(total AS DOUBLE) AS VARCHAR) || '}',
      ',' ORDER BY CAST(label AS VARCHAR)) AS t FROM g, s)
    SELECT '{"analysis_info":{"total_patients":' || total || ',"total_features_selected":64,"n_phenotypes":' || k || ',"analysis_timestamp":"2024-01-01T00:00:00"},"phenotype_distribution":{' || t || '},"feature_categories":{"HRV":3,"PPG":5},"model_performance":{"precision":[0.5,1.0],"recall":[1.0,0.5],"f1_score":[0.75,0.75],"accuracy":0.625}}' AS value FROM s, d"""
)
def analysis_summary(spark, sf_dir):
    """The document of an analysis: sizes, groups, feature categories and the model's quality."""
    groups = read(spark, sf_dir, "embeddings", "label").groupBy("label").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("Phenotype_"), F.col("label")))
    categories = spark.createDataFrame([("PPG", 5), ("HRV", 3)], "category string, n long")
    performance = spark.createDataFrame([(0, 4, 4, 0.5, 1.0, 0.75), (1, 4, 1, 1.0, 0.5, 0.75)], "cls int, support long, hits long, precision double, recall double, f1 double")
    return profiles.analysis_summary(groups, "label", "name", categories, performance, 64, at="2024-01-01T00:00:00")


@query(
    """WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, 'Cluster ' || label || ' holds ' || n || ' patients (' || format('{:.1f}', 100.0 * n / sum(n) OVER ()) || '% of the cohort).' || chr(10) || 'Most important features: a, b.' || chr(10) || 'Name the phenotype and interpret it in clinical terms.' AS prompt FROM g"""
)
def prompt_assembly(spark, sf_dir):
    """The prompt of each group."""
    groups = read(spark, sf_dir, "embeddings", "label").groupBy("label").agg(F.count("*").alias("n"))
    share = 100 * F.col("n") / F.sum("n").over(profiles.over([]))
    return groups.select("label", reports.prompt(F.col("label").cast("string"), F.col("n"), share, F.lit("a, b")).alias("prompt"))


@query(
    """SELECT c_mktsegment AS grp, c_mktsegment || ': ' || count(*) || ' patients; mortality ' || format('{:.1f}', 100 * avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END)) || '%; stay ' || format('{:.1f}', CAST(quantile_cont(c_nationkey, 0.5) AS DOUBLE)) AS line FROM customer GROUP BY c_mktsegment"""
)
def validation_report(spark, sf_dir):
    """A line of outcomes per group."""
    c = read(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal", "c_nationkey")
    groups = outcomes.by_group(c.select(F.col("c_mktsegment").alias("grp"), (F.col("c_acctbal") < 0).cast("double").alias("died"), "c_nationkey"), "grp", {"rate": "died"}, {"stay": "c_nationkey"})
    return reports.validation_report(groups, "grp", "n", {"mortality": "rate"}, {"stay": "stay"})


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'auc' ELSE 'f1' END AS metric, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std, count(v) AS folds FROM (SELECT doc_id, CAST(doc_id % 7 AS DOUBLE) / 7 AS v FROM labels) GROUP BY 1")
def cv_summary(spark, sf_dir):
    """Mean and deviation of metrics over folds."""
    folds = read(spark, sf_dir, "labels", "doc_id").select(F.when(F.col("doc_id") % 2 == 0, "auc").otherwise("f1").alias("metric"), ((F.col("doc_id") % 7).cast("double") / 7).alias("v"))
    return reports.cross_validation_summary(folds, "metric", "v").select("metric", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "folds")
