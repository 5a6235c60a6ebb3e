"""Embeddings, consensus clustering, cluster quality and supervised models on pyspark.ml (inventory 2.14)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over, reach_back
from ..sources.staging import staged
from .balance import stratified_folds, with_synthetic
from .neighbours import layout
from .stats import running_sums

#: Rows of a block in the sums of distances, about.
BLOCK_ROWS = 8192
#: Rows of a block of silhouettes, and how many of them are measured at once.
SILHOUETTE_ROWS, TILE_ROWS = 32_768, 64


def with_vector(df: DataFrame, values: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(values).cast("array<double>")))


def pca(df: DataFrame, features: str = "features", share: float = 0.9, most: int = 200, out: str = "components") -> tuple[DataFrame, list[float]]:
    """The leading components that hold ``share`` of the variance, and their shares; the covariance is gathered in Spark."""
    size = len(df.select(features).first()[0])
    model = PCA(k=min(most, size), inputCol=features, outputCol="__pca").fit(df)
    shares = model.explainedVariance.toArray()
    k = min(len(shares), int(np.searchsorted(np.cumsum(shares), share)) + 1)
    return model.transform(df).withColumn(out, F.slice(vector_to_array("__pca"), 1, k)).drop("__pca"), shares[:k].tolist()


def plane(df: DataFrame, row_id: str, features: str = "features") -> DataFrame:
    """``features`` replaced by places in the plane that keep neighbours together."""
    places = layout(df.select(row_id, vector_to_array(features).alias("__v")), row_id, "__v")
    return df.drop(features).join(places.select(row_id, array_to_vector(F.array("x", "y")).alias(features)), row_id)


def components(df: DataFrame, row_id: str) -> DataFrame:
    return pca(df)[0].withColumn("features", array_to_vector("components")).drop("components")


#: Selectable reducers: DataFrame with ``features``, and the name of its id, to DataFrame with ``features``.
REDUCERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"none": lambda df, row_id: df, "pca": components, "layout": plane, "pca_layout": lambda df, row_id: plane(components(df, row_id), row_id)}


def resampled_labels(df: DataFrame, features: str, k: int, resamples: int, share: float, seed: int) -> DataFrame:
    """Adds ``__l0``, ``__l1`` ...: each row's label by k-means on a resample."""
    labelled = df
    for b in range(resamples):
        model = KMeans(k=k, seed=seed + b, maxIter=20, featuresCol=features, predictionCol=f"__l{b}").fit(df.sample(share, seed=seed + b))
        labelled = model.transform(labelled)
    return labelled


def agreement_histogram(labels: DataFrame, row_id: str, votes: str = "votes") -> DataFrame:
    """Rows (agree, n): how many pairs of rows have ``agree`` equal votes.

    Rows with the same votes are counted together first, so the work grows with the
    square of the number of different votes alone; these are compared by pairs of
    blocks, and no pair leaves its block.
    """
    rows = labels.groupBy(F.col(votes).cast("array<int>").alias("v")).agg(F.count("*").alias("w"))
    blocks = max(4, -(-rows.count() // BLOCK_ROWS))
    block, every = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # each pair of blocks once
    left = rows.withColumn("i", block).withColumn("j", every).where("i <= j")
    right = rows.select(F.col("v").alias("v"), F.col("w").alias("w")).withColumn("j", block).withColumn("i", every).where("i <= j")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(0, np.int64)
        if len(left) and len(right):
            x, y = (np.asarray(t["v"].combine_chunks().flatten()).reshape(len(t), -1) for t in (left, right))
            wx, wy = left["w"].to_numpy(), right["w"].to_numpy()
            total = np.zeros(x.shape[1] + 1, np.int64)
            exact = float(wx.sum()) * float(wy.sum()) < 2.0**53  # sums of products as doubles
            for at in range(0, len(x), 256):
                same = sum((x[at : at + 256, r, None] == y[None, :, r]).astype(np.int16) for r in range(x.shape[1]))
                pairs = wx[at : at + 256, None] * wy
                if exact:
                    total += np.bincount(same.ravel(), pairs.ravel(), len(total)).astype(np.int64)
                else:
                    np.add.at(total, same.ravel(), pairs.ravel())
            if left["i"][0].as_py() == left["j"][0].as_py():  # both orders, and each row with itself
                total[-1] -= (wx * wx).sum()
                total //= 2
                total[-1] += (wx * (wx - 1) // 2).sum()
        return pa.table({"agree": pa.array(np.arange(len(total), dtype=np.int32)), "n": pa.array(total)})

    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(count, "agree int, n long")
    return parts.groupBy("agree").agg(F.sum("n").alias("n"))


def consensus_area(histogram: DataFrame, resamples: int) -> DataFrame:
    """One row with the area under the distribution of the pairs' agreement (in shares of the resamples)."""
    upto = F.sum("n").over(over([], ["agree"]).rowsBetween(Window.unboundedPreceding, 0))  # a row for each number of votes
    shares = histogram.withColumn("__c", upto / F.sum("n").over(over([])))
    return shares.agg((F.sum(F.when(F.col("agree") < resamples, F.col("__c"))) / resamples).alias("area"))


def choose_k(df: DataFrame, row_id: str, features: str = "features", ks: Sequence[int] = tuple(range(2, 10)), resamples: int = 10, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, int]:
    """Rows (k, area, gain) of the consensus areas and their relative gains, and the knee: the k whose area lies highest over the line from the first to the last."""
    areas = []
    for k in ks:
        votes = resampled_labels(df, features, k, resamples, share, seed).select(row_id, F.array(*[f"__l{b}" for b in range(resamples)]).alias("votes"))
        areas.append(float(consensus_area(agreement_histogram(votes, row_id), resamples).first().area))
    gains = [areas[0]] + [(b - a) / a if a else 0.0 for a, b in zip(areas[:-1], areas[1:], strict=True)]
    line = [areas[0] + (areas[-1] - areas[0]) * i / max(1, len(ks) - 1) for i in range(len(ks))]
    best = max(range(len(ks)), key=lambda i: areas[i] - line[i])
    rows = [(int(k), a, float(g)) for k, a, g in zip(ks, areas, gains, strict=True)]
    return df.sparkSession.createDataFrame(rows, "k int, area double, gain double"), int(ks[best])


def consensus_labels(df: DataFrame, row_id: str, features: str = "features", k: int = 4, resamples: int = 10, share: float = 0.8, seed: int = 42, out: str = "cluster") -> DataFrame:
    """Labels that resampled clusterings agree on.

    Each resample's k-means labels all rows; two rows' co-association is the share
    of equal labels, so rows are clustered by their label vectors (as one-hot
    vectors the squared distance is the number of disagreements).  No pair of
    rows is ever formed.
    """
    labelled = resampled_labels(df, features, k, resamples, share, seed)
    hot = F.array(*[F.when(F.col(f"__l{b}") == i, 1.0).otherwise(0.0) for b in range(resamples) for i in range(k)])
    votes = labelled.withColumn("__votes", array_to_vector(hot))
    final = KMeans(k=k, seed=seed, maxIter=40, featuresCol="__votes", predictionCol=out).fit(votes)
    agreed = final.transform(votes)
    return agreed.select(row_id, out, F.array(*[f"__l{b}" for b in range(resamples)]).alias("votes"))


def consensus_share(labels: DataFrame, row_id: str, cluster: str = "cluster", votes: str = "votes") -> DataFrame:
    """How far each row agrees with its cluster: the mean share of the cluster's rows that have its label, over the resamples."""
    long_ = labels.select(row_id, cluster, F.posexplode(votes).alias("b", "label"))
    counted = long_.withColumn("__same", F.count("*").over(over([cluster, "b", "label"]))).withColumn("__all", F.count("*").over(over([cluster, "b"])))
    return counted.groupBy(row_id, cluster).agg(F.avg(F.col("__same") / F.col("__all")).alias("agreement"))


def silhouette(df: DataFrame, row_id: str, cluster: str, values: str) -> DataFrame:
    """Silhouette of each row with Euclidean distances, the same at every size.

    Rows are dealt by their ids into blocks of about SILHOUETTE_ROWS.  A group for
    each unordered pair of blocks sums the distances of each one's rows to the
    other's by cluster, and the sums are added up by row and cluster.  Each block is
    sent to as many groups as there are blocks, and one more.
    """
    blocks = max(4, -(-df.count() // SILHOUETTE_ROWS))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (row_id, cluster)}
    rows = df.select(F.col(row_id).alias("id"), F.col(cluster).alias("c"), F.col(values).cast("array<double>").alias("v"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = rows.withColumn("i", block).withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1))))
    right = rows.withColumn("j", block).withColumn("i", F.explode(F.sequence(F.lit(0), "j")))
    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(distance_sums, f"id {kinds[row_id]}, own {kinds[cluster]}, other {kinds[cluster]}, total double")
    sums = parts.groupBy("id", "own", "other").agg(F.sum("total").alias("total"))
    sized = sums.join(rows.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("n")), "other")
    mine = F.col("own") == F.col("other")
    both = sized.groupBy("id", "own").agg(
        F.max(F.when(mine, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"), F.max(F.when(mine, F.col("n"))).alias("n")
    )
    most = F.greatest("a", "b")
    value = F.when(F.col("n") == 1, 0.0).when(F.col("b").isNull(), None).when(most == 0, float("nan")).otherwise((F.col("b") - F.col("a")) / F.nullif(most, F.lit(0.0)))
    return both.select(F.col("id").alias(row_id), value.alias("silhouette"))


def distance_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows (id, own, other, total): the sum of distances of each row of a block to the rows of each cluster of the other block, both ways; a block with itself one way."""
    none = pa.table({"id": left["id"].slice(0, 0), "own": left["c"].slice(0, 0), "other": right["c"].slice(0, 0), "total": pa.array([], pa.float64())})
    if not len(left) or not len(right):
        return none
    x, y = (np.asarray(t["v"].combine_chunks().flatten(), float).reshape(len(t), -1) for t in (left, right))
    (names, member), (own_names, own_member) = members(right["c"]), members(left["c"])
    yy = (y**2).sum(1)
    forth, back = np.zeros((len(x), len(names))), np.zeros((len(y), len(own_names)))
    for at in range(0, len(x), TILE_ROWS):
        part = x[at : at + TILE_ROWS]
        scale = (part**2).sum(1)[:, None] + yy[None, :]
        square = scale - 2 * part @ y.T
        near = np.nonzero(square <= 1e-6 * scale)  # differences of almost equal numbers
        square[near] = ((part[near[0]] - y[near[1]]) ** 2).sum(1)
        distance = np.sqrt(square, out=square)
        forth[at : at + TILE_ROWS] = distance @ member
        back += distance.T @ own_member[at : at + TILE_ROWS]
    ways = [(left, names, forth)]
    if left["i"][0].as_py() != left["j"][0].as_py():
        ways.append((right, own_names, back))
    out = [pa.table({"id": t["id"], "own": t["c"], "other": pa.array([name.as_py()] * len(t), kinds.type), "total": total[:, k]}) for t, kinds, total in ways for k, name in enumerate(kinds)]
    return pa.concat_tables([none, *out])


def members(clusters: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The clusters, and which of them each row is in."""
    names = pc.unique(clusters)
    member = np.zeros((len(clusters), len(names)))
    member[np.arange(len(clusters)), pc.index_in(clusters, names).to_numpy()] = 1
    return names, member


def squared_silhouette(df: DataFrame, row_id: str, cluster: str, values: str) -> DataFrame:
    """Silhouette with squared distances: a row's sum of distances to a cluster needs only the cluster's size, sum and sum of squares."""
    from pyspark.ml.stat import Summarizer

    v = df.select(row_id, F.col(cluster).alias("__c"), array_to_vector(F.col(values).cast("array<double>")).alias("__v"))
    square = F.aggregate(vector_to_array("__v"), F.lit(0.0), lambda a, x: a + x * x)
    sums = v.withColumn("__q", square).groupBy("__c").agg(F.count("*").alias("n"), Summarizer.sum(F.col("__v")).alias("s"), F.sum("__q").alias("q"))
    table = sums.select(F.collect_list(F.struct(F.col("__c").alias("c"), "n", vector_to_array("s").alias("s"), "q")).alias("t"))  # a row per cluster
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    rows = v.withColumn("__q", square).withColumn("__x", vector_to_array("__v")).crossJoin(F.broadcast(table))
    far = F.transform("t", lambda t: F.struct(t["c"].alias("c"), t["n"].alias("n"), (t["n"] * F.col("__q") + t["q"] - 2 * dot(t["s"], F.col("__x"))).alias("d")))
    rows = rows.withColumn("__f", far)
    own = F.filter("__f", lambda f: f["c"] == F.col("__c"))[0]
    a = own["d"] / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(F.filter("__f", lambda f: f["c"] != F.col("__c")), lambda f: f["d"] / f["n"]))
    return rows.select(row_id, F.when(own["n"] > 1, (b - a) / F.greatest(a, b)).otherwise(0.0).alias("silhouette"))


def cluster_indices(df: DataFrame, row_id: str, cluster: str, values: str) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz indices from the clusters' centres and scatter."""
    long_ = df.select(F.col(row_id).alias("r"), F.col(cluster).alias("c"), F.posexplode(F.col(values).cast("array<double>")).alias("i", "v"))
    centre = long_.groupBy("c", "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.sum("v").alias("s"))
    rows = long_.join(centre.select("c", "i", "m"), ["c", "i"]).groupBy("c", "r").agg(F.sum(F.pow(F.col("v") - F.col("m"), 2)).alias("d2"))
    scatter = {x.c: (x.n, x.s, x.w) for x in rows.groupBy("c").agg(F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w")).collect()}
    centres = {x.c: np.array([y.m for y in sorted(x.m, key=lambda y: y.i)]) for x in centre.groupBy("c").agg(F.collect_list(F.struct("i", "m")).alias("m")).collect()}
    names = sorted(scatter)
    n, k = sum(scatter[c][0] for c in names), len(names)
    worst = [max((scatter[a][1] + scatter[b][1]) / max(float(np.linalg.norm(centres[a] - centres[b])), 1e-300) for b in names if b != a) for a in names] if k > 1 else [float("nan")]
    whole = sum(scatter[c][0] * centres[c] for c in names) / n
    between = sum(scatter[c][0] * float(((centres[c] - whole) ** 2).sum()) for c in names)
    within = sum(scatter[c][2] for c in names)
    ch = between / (k - 1) / (within / (n - k)) if k > 1 and n > k and within else float("nan")
    return df.sparkSession.createDataFrame([(float(np.mean(worst)), float(ch))], "davies_bouldin double, calinski_harabasz double")


def membership(df: DataFrame, label: str, features: str = "features", seed: int = 42, trees: int = 40) -> tuple[DataFrame, list[float]]:
    """A forest that predicts the cluster on held-out rows (a fifth), and the importance of each feature."""
    train, test = df.randomSplit([0.8, 0.2], seed)
    model = RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=trees, seed=seed).fit(train)
    return model.transform(test), model.featureImportances.toArray().tolist()


def class_importance(df: DataFrame, label: str, names: Sequence[str], features: str = "features", seed: int = 42, trees: int = 20) -> DataFrame:
    """Rows (cls, feature, importance, rank): what tells each class from all others, by a forest for each class."""
    rows = []
    for c in sorted(r[0] for r in df.select(label).distinct().collect()):  # a row per class
        one = df.withColumn("__y", (F.col(label) == c).cast("double"))
        shares = RandomForestClassifier(labelCol="__y", featuresCol=features, numTrees=trees, seed=seed).fit(one).featureImportances.toArray()
        order = sorted(range(len(names)), key=lambda i: (-shares[i], i))
        rows += [(int(c), names[i], float(shares[i]), at + 1) for at, i in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "cls int, feature string, importance double, rank int")


def save_model(model, path: str) -> None:
    """Writes a fitted model of pyspark.ml to a folder."""
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    """Reads what ``save_model`` wrote; ``kind`` is the model's class."""
    return kind.load(path)


def cross_validated(df: DataFrame, row_id: str, label: str, features: str = "features", folds: int = 5, seed: int = 42, trees: int = 40, balance: str = "weights") -> DataFrame:
    """Rows (row_id, fold, label, score): each row's probability of class 1 by a forest of the other folds.

    ``balance`` evens out the classes: ``weights``, ``oversample`` (the rarer class
    repeated to equal numbers, with a fraction of it at random), ``synthetic`` (rows
    between near rows of the rarer class, in the training folds alone; the id must be
    a distinct whole number), or ``none``.  Folds hold each class in equal parts.
    """
    labelled = df.select(row_id, F.col(label).cast("double").alias("__y"), features)
    dealt = staged(stratified_folds(labelled, row_id, "__y", folds, seed), "folds")
    out = None
    for f in range(folds):
        train, test = dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f)
        n = {r["__y"]: r.n for r in train.groupBy("__y").agg(F.count("*").alias("n")).collect()}  # a row per class
        most = max(n.values())
        times = F.lit(1.0)
        for c, own in n.items():
            times = F.when(F.col("__y") == c, most / own).otherwise(times)
        if balance == "oversample":
            copies = F.floor(times + F.rand(seed)).cast("int")
            train = train.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).drop("__copy")
        if balance == "synthetic":
            train = with_synthetic(train.withColumn("__v", vector_to_array(features)), row_id, "__y", "__v", seed=seed).withColumn(features, array_to_vector("__v"))
        train = train.withColumn("__weight", times if balance == "weights" else F.lit(1.0))
        model = RandomForestClassifier(labelCol="__y", featuresCol=features, weightCol="__weight", numTrees=trees, seed=seed).fit(train)
        own = model.transform(test).select(row_id, "fold", F.col("__y").cast("int").alias(label), vector_to_array("probability")[1].alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


def curve_points(df: DataFrame, label: str, score: str, fold: str) -> DataFrame:
    """Rows (fold, score, fpr, tpr, precision) of each fold by falling score."""
    by_score = df.where(F.col(score).isNotNull()).groupBy(fold, score).agg(F.sum((F.col(label) == 1).cast("int")).alias("p"), F.sum((F.col(label) == 0).cast("int")).alias("n"))
    total = by_score.groupBy(fold).agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    run = running_sums(by_score, score, ["p", "n"], descending=True, keys=[fold]).join(total, fold)
    return run.select(fold, score, (F.col("run_n") / F.col("__n")).alias("fpr"), (F.col("run_p") / F.col("__p")).alias("tpr"), (F.col("run_p") / (F.col("run_p") + F.col("run_n"))).alias("precision"))


def curve_bands(points: DataFrame, fold: str, cells: int = 100) -> DataFrame:
    """Rows (x, tpr, tpr_low, tpr_high, precision, precision_low, precision_high): means over the folds with a band of 1.96 deviations.

    At each x the highest tpr at an fpr of x or less, and the highest precision at a
    recall of x or more.
    """
    rounding = 1e-9
    grid = points.sparkSession.range(cells + 1).select(F.col("id").cast("int").alias("cell"))
    folds = points.select(fold).distinct()
    every = folds.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells)))).join(grid, "cell")
    roc = points.groupBy(fold, F.ceil(F.col("fpr") * cells - rounding).cast("int").alias("cell")).agg(F.max("tpr").alias("tpr"))
    pr = points.groupBy(fold, F.floor(F.col("tpr") * cells + rounding).cast("int").alias("cell")).agg(F.max("precision").alias("precision"))
    both = every.join(roc, [fold, "cell"], "left").join(pr, [fold, "cell"], "left")
    filled = both.select(fold, "cell", F.coalesce(F.max("tpr").over(reach_back([fold], ["cell"])), F.lit(0.0)).alias("tpr"), F.max("precision").over(reach_back([fold], ["cell"], ahead=True)).alias("precision"))
    out = filled.groupBy("cell").agg(*[f(c).alias(n) for c in ("tpr", "precision") for n, f in ((c, F.avg), (f"__{c}", F.stddev_samp))])
    edge = lambda c: {f"{c}_low": F.greatest(F.col(c) - 1.96 * F.col(f"__{c}"), F.lit(0.0)), f"{c}_high": F.least(F.col(c) + 1.96 * F.col(f"__{c}"), F.lit(1.0))}
    return out.withColumns(edge("tpr") | edge("precision")).select((F.col("cell") / cells).alias("x"), "tpr", "tpr_low", "tpr_high", "precision", "precision_low", "precision_high")


def by_block(df: DataFrame, block: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``run`` for each block of rows (the hours before an outcome, say), with its name."""
    out = None
    for b in sorted(r[0] for r in df.select(block).distinct().collect()):  # a row per block
        own = run(df.where(F.col(block) == b)).withColumn(block, F.lit(b))
        out = own if out is None else out.unionByName(own)
    return out


def lasso_path(df: DataFrame, label: str, features: str = "features", penalties: Sequence[float] = (1.0, 0.1, 0.01), folds: int = 5, seed: int = 42) -> tuple[float, list[float]]:
    """The penalty with the least cross-validated error, and the coefficients under it."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LinearRegression(labelCol=label, featuresCol=features, elasticNetParam=1.0)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(penalties)).build()
    best = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed).fit(df).bestModel
    return best.getOrDefault("regParam"), best.coefficients.toArray().tolist()


def boosted_regression(df: DataFrame, label: str, features: str = "features", seed: int = 42) -> DataFrame:
    """Predictions of boosted trees on held-out rows."""
    train, test = df.randomSplit([0.8, 0.2], seed)
    return GBTRegressor(labelCol=label, featuresCol=features, maxIter=10, seed=seed).fit(train).transform(test)


def chained_imputation(df: DataFrame, columns: Sequence[str], rounds: int = 2, binary: Sequence[str] = (), ordinal: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Missing values regressed on all other columns in turn, from the median (of binary and ordinal columns the mode) on.

    Linear models for numbers; of ``ordinal`` columns (with their least and greatest
    level) the prediction is rounded and clipped; logistic models for ``binary`` ones.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from .cleaning import median_impute, mode_impute

    ordinal = dict(ordinal or {})
    named = [*binary, *ordinal]
    marked = df.withColumns({f"__na_{c}": F.col(c).isNull() for c in columns})
    out = median_impute(mode_impute(marked, named) if named else marked, [c for c in columns if c not in named])
    for _ in range(rounds):
        for c in columns:
            x = VectorAssembler(inputCols=[o for o in columns if o != c], outputCol="__x").transform(out)
            known = x.where(~F.col(f"__na_{c}"))
            if c in binary:
                model = LogisticRegression(labelCol="__y", featuresCol="__x", predictionCol="__p", regParam=1e-6).fit(known.withColumn("__y", F.col(c).cast("double")))
            else:
                model = LinearRegression(labelCol=c, featuresCol="__x", predictionCol="__p", regParam=1e-6).fit(known)
            found = F.col("__p")
            if c in ordinal:
                low, high = ordinal[c]
                found = F.least(F.greatest(F.round(found), F.lit(low)), F.lit(high))
            out = model.transform(x).withColumn(c, F.when(F.col(f"__na_{c}"), found).otherwise(F.col(c)).cast(df.schema[c].dataType)).select(*df.columns, *[f"__na_{o}" for o in columns])
    return out.drop(*[f"__na_{c}" for c in columns])


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative true and false positive shares by falling score; scores are aggregated first."""
    by_score = df.groupBy(score).agg(F.sum((F.col(label) == 1).cast("int")).alias("p"), F.sum((F.col(label) == 0).cast("int")).alias("n"))
    total = by_score.agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    share = lambda c: F.col(f"run_{c}") / total.select(c).scalar()
    return running_sums(by_score.where(F.col(score).isNotNull()), score, ["p", "n"], descending=True).select(score, share("p").alias("tpr"), share("n").alias("fpr"))
