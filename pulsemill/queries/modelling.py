"""Clusterings and models of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, boosting, imputation, linkage, modelling, neighbours, spectral, trees
from .base import query, read


def vectors(spark, sf_dir):
    return modelling.with_vector(read(spark, sf_dir, "embeddings"), "embedding")


@query(
    """WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2))))) AS total, count(*) AS n
      FROM embeddings a, embeddings b GROUP BY a.vec_id, a.label, b.label),
    s AS (SELECT vec_id, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY vec_id)
    SELECT vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM s"""
)
def silhouette_scores(spark, sf_dir):
    """Silhouette of each vector under its label."""
    out = modelling.silhouette(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return out.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query(
    """WITH u AS (SELECT vec_id, label, UNNEST(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM u GROUP BY label, i), o AS (SELECT i, avg(v) AS m FROM u GROUP BY i),
    r AS (SELECT u.label, u.vec_id, sum(pow(v - m, 2)) AS d2 FROM u JOIN c ON c.label = u.label AND c.i = u.i GROUP BY u.label, u.vec_id),
      s AS (SELECT label, count(*) AS n, avg(sqrt(d2)) AS s, sum(d2) AS w FROM r GROUP BY label),
    p AS (SELECT a.label AS la, b.label AS lb, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label),
    db AS (SELECT avg(x) AS v FROM (SELECT la, max((sa.s + sb.s) / d) AS x FROM p JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la)),
    bt AS (SELECT sum(n * e) AS v FROM (SELECT c.label, sum(pow(c.m - o.m, 2)) AS e FROM c JOIN o ON o.i = c.i GROUP BY c.label) JOIN s USING (label))
    SELECT round(db.v, 6) AS davies_bouldin, round((bt.v / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM db, bt, (SELECT count(*) AS k, sum(n) AS n, sum(w) AS w FROM s)"""
)
def davies_bouldin_calinski(spark, sf_dir):
    """Two indices of the labelling."""
    out = modelling.cluster_indices(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return out.select(F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query()
def pca_90(spark, sf_dir):
    """The components that hold nine tenths of the variance."""
    return modelling.pca(vectors(spark, sf_dir))[0].select("vec_id", "components")


@query()
def consensus_labels(spark, sf_dir):
    """Labels that resampled clusterings agree on."""
    return modelling.consensus_labels(vectors(spark, sf_dir), "vec_id", k=10, resamples=5).select("vec_id", "cluster")


@query()
def kmeans_coassociation(spark, sf_dir):
    """How far each vector agrees with its consensus cluster."""
    return modelling.consensus_share(modelling.consensus_labels(vectors(spark, sf_dir), "vec_id", k=10, resamples=5, share=1.0), "vec_id")


@query()
def classifier_importance(spark, sf_dir):
    """Importance of each feature for predicting the label."""
    _, shares = modelling.membership(vectors(spark, sf_dir).select("vec_id", "label", "features"), "label", trees=10)
    return spark.createDataFrame(list(enumerate(shares)), "feature int, importance double")


@query()
def lasso_selection(spark, sf_dir):
    """Coefficients of the penalised regression chosen by cross-validation."""
    from pyspark.ml.feature import VectorAssembler

    li = read(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_tax", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    names = ["l_quantity", "l_discount", "l_tax"]
    penalty, coefficients = modelling.lasso_path(VectorAssembler(inputCols=names, outputCol="features").transform(li), "y", folds=3)
    return spark.createDataFrame([(n, float(c), penalty) for n, c in zip(names, coefficients, strict=True)], "feature string, coefficient double, penalty double")


@query()
def chained_imputation(spark, sf_dir):
    """Missing values regressed on the other columns."""
    from .cleaning import holes

    return modelling.chained_imputation(holes(spark, sf_dir).select("l_orderkey", "l_linenumber", "quantity", "price", "discount"), ["quantity", "price", "discount"], rounds=1)


@query(
    """WITH s AS (SELECT round(CAST(doc_id % 100 AS DOUBLE) / 100 + quality * 0.3, 2) AS score, quality FROM labels), g AS (SELECT score, sum(CAST(quality = 1 AS INT)) AS p, sum(CAST(quality = 0 AS INT)) AS n FROM s GROUP BY score)
    SELECT score, round(sum(p) OVER (ORDER BY score DESC) / CAST(sum(p) OVER () AS DOUBLE), 6) AS tpr, round(sum(n) OVER (ORDER BY score DESC) / CAST(sum(n) OVER () AS DOUBLE), 6) AS fpr FROM g"""
)
def roc_curve(spark, sf_dir):
    """Points of the ROC curve."""
    labels = read(spark, sf_dir, "labels", "doc_id", "quality").withColumn("score", F.round(F.col("doc_id") % 100 / 100 + F.col("quality") * 0.3, 2))
    return modelling.roc_points(labels, "quality", "score").select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


VOTES = "[label, label % 5, (vec_id // 7) % 3, (label + vec_id % 2) % 4]"


@query(
    f"""WITH v AS (SELECT vec_id, {VOTES} AS v FROM embeddings), p AS (SELECT CAST(a.v[1] = b.v[1] AS INT) + CAST(a.v[2] = b.v[2] AS INT) + CAST(a.v[3] = b.v[3] AS INT) + CAST(a.v[4] = b.v[4] AS INT) AS agree FROM v a JOIN v b ON a.vec_id < b.vec_id)
    SELECT CAST(agree AS INT) AS agree, count(*) AS n FROM p GROUP BY agree"""
)
def agreement_histogram(spark, sf_dir):
    """How many pairs of vectors agree in how many labellings."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "label")
    votes = F.array(F.col("label").cast("int"), (F.col("label") % 5).cast("int"), (F.floor(F.col("vec_id") / 7) % 3).cast("int"), ((F.col("label") + F.col("vec_id") % 2) % 4).cast("int"))
    return modelling.agreement_histogram(e.select("vec_id", votes.alias("votes")), "vec_id").where("n > 0")


@query()
def consensus_best_k(spark, sf_dir):
    """Consensus areas for several numbers of clusters, and the knee."""
    areas, best = modelling.choose_k(vectors(spark, sf_dir), "vec_id", ks=(2, 4, 6, 8, 10), resamples=4)
    return areas.withColumn("best", F.col("k") == best)


@query()
def mixed_imputation(spark, sf_dir):
    """Missing binary, ordinal and continuous values, each by its kind of model."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    gap = lambda k: F.col("l_orderkey") % k == 0
    held = li.select(
        "l_orderkey", "l_linenumber", F.when(~gap(11), (F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.when(~gap(7), F.least(F.floor(F.col("l_quantity") / 13), F.lit(3)).cast("int")).alias("grade"),
        F.when(~gap(5), F.col("l_extendedprice").cast("double")).alias("price"), F.col("l_quantity").cast("double").alias("quantity"),
    )
    return modelling.chained_imputation(held, ["returned", "grade", "price", "quantity"], rounds=1, binary=["returned"], ordinal={"grade": (0, 3)})


@query()
def class_contributions(spark, sf_dir):
    """What tells each label of the vectors from the others: its five first features."""
    return modelling.class_importance(vectors(spark, sf_dir), "label", [f"e{i}" for i in range(64)], trees=5).where("rank <= 5")


def folded(spark, sf_dir):
    score = F.round(F.col("doc_id") % 100 / 100 + F.col("quality") * 0.3, 2)
    return read(spark, sf_dir, "labels", "doc_id", "quality").select("quality", score.alias("score"), (F.floor(F.col("doc_id") / 100) % 4).cast("int").alias("fold"))


FOLDED = "s AS (SELECT CAST((doc_id // 100) % 4 AS INT) AS fold, round(CAST(doc_id % 100 AS DOUBLE) / 100 + quality * 0.3, 2) AS score, quality FROM labels), g AS (SELECT fold, score, sum(CAST(quality = 1 AS INT)) AS p, sum(CAST(quality = 0 AS INT)) AS n FROM s GROUP BY fold, score), c AS (SELECT fold, score, sum(n) OVER w / CAST(sum(n) OVER (PARTITION BY fold) AS DOUBLE) AS fpr, sum(p) OVER w / CAST(sum(p) OVER (PARTITION BY fold) AS DOUBLE) AS tpr, sum(p) OVER w / CAST(sum(p) OVER w + sum(n) OVER w AS DOUBLE) AS prec FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC))"


@query(
    f"""WITH {FOLDED}, x AS (SELECT UNNEST(range(0, 101)) AS i), f AS (SELECT DISTINCT fold FROM c), e AS (SELECT fold, i, coalesce((SELECT max(tpr) FROM c WHERE c.fold = f.fold AND c.fpr <= i / 100.0 + 1e-11), 0) AS tpr, (SELECT max(prec) FROM c WHERE c.fold = f.fold AND c.tpr >= i / 100.0 - 1e-11) AS prec FROM f, x),
    m AS (SELECT i, avg(tpr) AS t, stddev_samp(tpr) AS ts, avg(prec) AS p, stddev_samp(prec) AS ps FROM e GROUP BY i)
    SELECT i / 100.0 AS x, round(t, 6) AS tpr, round(greatest(t - 1.96 * ts, 0), 6) AS tpr_low, round(least(t + 1.96 * ts, 1), 6) AS tpr_high, round(p, 6) AS precision, round(greatest(p - 1.96 * ps, 0), 6) AS precision_low, round(least(p + 1.96 * ps, 1), 6) AS precision_high FROM m"""
)
def curve_bands(spark, sf_dir):
    """ROC and precision-recall curves as means over folds, with bands."""
    out = modelling.curve_bands(modelling.curve_points(folded(spark, sf_dir), "quality", "score", "fold"), "fold")
    return out.select("x", *[F.round(c, 6).alias(c) for c in out.columns if c != "x"])


@query()
def cross_validated_scores(spark, sf_dir):
    """Each vector's probability of one label, by a forest of the other folds with weighted classes."""
    v = vectors(spark, sf_dir).withColumn("y", (F.col("label") < 2).cast("int"))
    return modelling.cross_validated(v, "vec_id", "y", folds=3, trees=5)


@query()
def block_outcomes(spark, sf_dir):
    """The same for each block of vectors."""
    v = vectors(spark, sf_dir).withColumns({"y": (F.col("label") < 5).cast("int"), "block": (F.col("vec_id") % 2).cast("int")})
    return modelling.by_block(v, "block", lambda own: modelling.cross_validated(own, "vec_id", "y", folds=2, trees=5, balance="oversample"))


PARTIAL_VOTES = "[label, CASE WHEN vec_id % 5 > 0 THEN label % 5 END, CASE WHEN vec_id % 3 > 0 THEN (vec_id // 7) % 3 END, (label + vec_id % 2) % 4]"


@query(
    f"""WITH v AS (SELECT vec_id, {PARTIAL_VOTES} AS v FROM embeddings),
    p AS (SELECT a.vec_id AS u, b.vec_id AS v, coalesce(CAST(a.v[1] = b.v[1] AS INT), 0) + coalesce(CAST(a.v[2] = b.v[2] AS INT), 0) + coalesce(CAST(a.v[3] = b.v[3] AS INT), 0) + coalesce(CAST(a.v[4] = b.v[4] AS INT), 0) AS together,
      2 + CAST(a.v[2] IS NOT NULL AND b.v[2] IS NOT NULL AS INT) + CAST(a.v[3] IS NOT NULL AND b.v[3] IS NOT NULL AS INT) AS "both" FROM v a JOIN v b ON a.vec_id < b.vec_id)
    SELECT u, v, together, "both" FROM p WHERE together > 0"""
)
def co_association(spark, sf_dir):
    """In how many labellings two vectors have one label, of those that label both."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "label")
    row, label = F.col("vec_id"), F.col("label")
    votes = F.array(label, F.when(row % 5 > 0, label % 5), F.when(row % 3 > 0, F.floor(row / 7) % 3).cast("int"), ((label + row % 2) % 4).cast("int"))
    return linkage.co_association(e.select(row.alias("id"), votes.alias("votes")))


@query()
def agglomerative_areas(spark, sf_dir):
    """Areas under the consensus distributions for 2 to 9 clusters over 100 resamples by average linkage, their gains, and two choices."""
    _, nodes, graph = linkage.consensus(vectors(spark, sf_dir), "vec_id")
    return linkage.gains(linkage.areas(nodes, graph))


@query()
def agglomerative_consensus(spark, sf_dir):
    """Four clusters by average linkage of the consensus of 100 resamples, with distances taken twice."""
    rows, nodes, graph = linkage.consensus(vectors(spark, sf_dir), "vec_id", ks=(4,))
    return linkage.consensus_clusters(rows, nodes, graph, 4, twice=True).withColumnRenamed("row", "vec_id")


@query()
def spectral_consensus(spark, sf_dir):
    """Ten clusters by the spectrum of what ten k-means labellings agree on."""
    labelled = modelling.resampled_labels(vectors(spark, sf_dir), "features", 10, 10, 0.8, 42)
    return spectral.spectral_clusters(labelled.select("vec_id", F.array(*[f"__l{b}" for b in range(10)]).alias("votes")), "vec_id", 10)


@query(
    """WITH d AS (SELECT a.vec_id AS id, b.vec_id AS other, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))) AS d
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY d, other) AS INT) AS rank FROM d)
    SELECT id, other, round(d, 6) AS distance, rank FROM r WHERE rank <= 15"""
)
def nearest_neighbours(spark, sf_dir):
    """The fifteen nearest vectors of each; all are right where one stretch holds the table, nearly all elsewhere."""
    graph = neighbours.neighbour_graph(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return graph.withColumn("distance", F.round("distance", 6))


@query()
def plane_layout(spark, sf_dir):
    """Places of the vectors in the plane."""
    return neighbours.layout(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


def forest_shares(spark, sf_dir):
    """Shares of the components of the vectors in a forest's probability of each label, and the model."""
    from pyspark.ml.classification import RandomForestClassifier

    v = vectors(spark, sf_dir)
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=20, maxDepth=5, seed=42).fit(v)
    return v, model, trees.contributions(trees.ensemble(trees.node_table(model)), v, "vec_id")


@query("SELECT vec_id, CAST(UNNEST(range((SELECT CAST(max(label) AS INT) + 1 FROM embeddings))) AS INT) AS cls, 0.0 AS gap FROM embeddings")
def shapley_additivity(spark, sf_dir):
    """How far base and shares are from adding up to the forest's probability of each label."""
    from pyspark.ml.functions import vector_to_array

    v, model, found = forest_shares(spark, sf_dir)
    wanted = model.transform(v).select("vec_id", F.posexplode(vector_to_array("probability")).alias("cls", "p"))
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, x: a + x)
    return found.join(wanted, ["vec_id", "cls"]).select("vec_id", "cls", (F.abs(F.round(total - F.col("p"), 9)) + 0.0).alias("gap"))


@query()
def shapley_by_class(spark, sf_dir):
    """The five components with the largest mean share for each label, and over all."""
    return trees.mean_shares(forest_shares(spark, sf_dir)[2], [f"e{i}" for i in range(64)]).where("rank <= 5")


@query(
    """WITH c AS (SELECT label, count(*) AS n, sum(count(*)) OVER (ORDER BY label) - count(*) AS o FROM embeddings GROUP BY label), f AS (SELECT CAST(UNNEST(range(5)) AS INT) AS fold)
    SELECT label, fold, CAST(n // 5 + CAST(((fold - o) % 5 + 5) % 5 < n % 5 AS INT) AS BIGINT) AS n FROM c, f"""
)
def stratified_fold_sizes(spark, sf_dir):
    """How many vectors of each label each of five folds holds."""
    return balance.stratified_folds(read(spark, sf_dir, "embeddings", "vec_id", "label"), "vec_id", "label", 5).groupBy("label", "fold").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT CASE WHEN label < 6 THEN 0 WHEN label < 9 THEN 1 ELSE 2 END AS kind, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT CAST(kind AS INT) AS kind, n AS kept, (SELECT max(n) FROM e) - n AS made, true AS inside FROM e"""
)
def synthetic_minority(spark, sf_dir):
    """Rows kept and made in each of three unequal classes, and whether the made ones lie inside the bounds of their class in every component."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("label") < 6, 0).when(F.col("label") < 9, 1).otherwise(2).alias("kind"))
    out = balance.with_synthetic(e, "vec_id", "kind", "embedding")
    sides = out.select("kind", "copy", F.posexplode("embedding").alias("i", "x")).groupBy("kind", "i")
    kept, made = F.when(F.col("copy") == 0, F.col("x")), F.when(F.col("copy") > 0, F.col("x"))
    slack = 1e-9
    inside = sides.agg((F.coalesce(F.min(made) >= F.min(kept) - slack, F.lit(True)) & F.coalesce(F.max(made) <= F.max(kept) + slack, F.lit(True))).alias("ok"))
    counts = out.groupBy("kind").agg(F.count_if(F.col("copy") == 0).alias("kept"), F.count_if(F.col("copy") > 0).alias("made"))
    return counts.join(inside.groupBy("kind").agg(F.bool_and("ok").alias("inside")), "kind")


@query()
def boosted_membership(spark, sf_dir):
    """Each label's vectors in a held-out fifth, and how many of them boosted trees of the rest tell."""
    v = vectors(spark, sf_dir).withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0)
    forest, _ = boosting.boost(v.where("not held"), "vec_id", "label", rounds=10, classes=10)
    found = boosting.scored(forest, v.where("held"), "vec_id").join(v.select("vec_id", "label"), "vec_id")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("hits"))


@query()
def boosted_regression(spark, sf_dir):
    """Prices of a held-out fifth of the line items by boosted trees of the rest: bias and limits of agreement by quantity."""
    from pyspark.ml.feature import VectorAssembler

    names = ["l_quantity", "l_discount", "l_tax"]
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", *names).withColumn("row", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    x = VectorAssembler(inputCols=names, outputCol="features").transform(li).withColumn("held", F.pmod(F.xxhash64("row"), F.lit(5)) == 0)
    forest, _ = boosting.boost(x.where("not held"), "row", "l_extendedprice", objective="squared", rounds=20, depth=3)
    found = boosting.scored(forest, x.where("held"), "row", objective="squared").join(x.select("row", "l_quantity", "l_extendedprice"), "row")
    gap = F.col("prediction") - F.col("l_extendedprice").cast("double")
    return found.groupBy(F.floor(F.col("l_quantity") / 10).cast("int").alias("tens")).agg(F.count("*").alias("n"), F.avg(gap).alias("bias"), (F.avg(gap) - 1.96 * F.stddev_samp(gap)).alias("low"), (F.avg(gap) + 1.96 * F.stddev_samp(gap)).alias("high"))


@query()
def bayesian_imputation(spark, sf_dir):
    """Missing quantities, prices and discounts by Bayesian ridge regressions on each other, until they settle."""
    from .cleaning import holes

    held = holes(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("quantity", "price", "discount")])
    return imputation.regression_imputation(held, ["quantity", "price", "discount"])[0]
