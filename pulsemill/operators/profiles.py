"""Profiles of groups, importance tables and text of reports (inventory 2.5 A14g-A25g, 2.10, 2.16)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, over


def long_features(df: DataFrame, row_id: str, group: str, values: str) -> DataFrame:
    """Rows (row_id, group, feature, value) of a table with an array of features."""
    return df.select(row_id, group, F.posexplode(values).alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def group_profile(long_: DataFrame, group: str, feature: str = "feature", value: str = "value", slack: float = 0.0) -> DataFrame:
    """Size, mean and sample deviation of each feature by group, and its direction against the whole cohort.

    The cohort's mean comes from the group sums, so the long table is read once.
    """
    cells = long_.groupBy(group, feature).agg(F.count(value).alias("n"), F.sum(value).alias("__s"), F.stddev_samp(value).alias("std"))
    w = over([feature])
    cells = cells.withColumn("mean", F.col("__s") / F.col("n")).withColumn("overall", F.sum("__s").over(w) / F.sum("n").over(w))
    gap = F.col("mean") - F.col("overall")
    return cells.withColumn("direction", F.when(gap > slack, "up").when(gap < -slack, "down").otherwise("same")).drop("__s")


def mean_absolute(long_: DataFrame, group: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean absolute contribution of each feature, by group and over all."""
    cells = long_.groupBy(group, feature).agg(F.sum(F.abs(value)).alias("__s"), F.count(value).alias("__n"))
    w = over([feature])
    return cells.select(group, feature, (F.col("__s") / F.col("__n")).alias("importance"), (F.sum("__s").over(w) / F.sum("__n").over(w)).alias("overall"))


def top_features(importance: DataFrame, group: str, k: int = 10, score: str = "importance", feature: str = "feature") -> DataFrame:
    """The k most important features of each group with their rank."""
    return importance.withColumn("rank", F.row_number().over(over([group], [F.desc(score), feature]))).where(F.col("rank") <= k)


def fallback_score(p: str | Column, effect: str | Column) -> Column:
    """The score that ranks features where no contributions are known."""
    return (1 / (col(p) + 1e-10)) * F.abs(col(effect))


def grade(importance: DataFrame, group: str, score: str = "importance") -> DataFrame:
    """High, Moderate or Low by the share of the group's greatest importance; Medium if that is 0."""
    most = F.max(score).over(over([group]))
    share = F.col(score) / most
    label = F.when(most == 0, "Medium").when(share >= 0.66, "High").when(share >= 0.33, "Moderate").otherwise("Low")
    return importance.withColumn("grade", label)


def shared_ranks(top: DataFrame, group: str, groups: Sequence, k: int, feature: str = "feature") -> DataFrame:
    """Reverse ranks (k for the first) by group of the features that more than one group has; 0 if absent."""
    out = top.groupBy(feature).agg(F.count("*").alias("groups"), *[F.max(F.when(F.col(group) == g, k + 1 - F.col("rank")).otherwise(0)).alias(f"g{g}") for g in groups])
    return out.where("groups > 1")


def category(name: str | Column, keywords: Mapping[str, Sequence[str]], default: str = "Other") -> Column:
    """The first category of which a keyword is contained in the name, whatever the case."""
    out = None
    low = F.lower(col(name))
    for label, words in keywords.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def lookup_context(names: DataFrame, name: str, contexts: DataFrame) -> DataFrame:
    """The context of the first key (by position) contained in the name; ``contexts`` is a small fixed table (position, key, context)."""
    joined = names.join(contexts, F.lower(F.col(name)).contains(F.lower(F.col("key"))), "left")
    return joined.groupBy(*names.columns).agg(F.min_by("context", "position").alias("context"))


def comparison(groups: DataFrame, group: str, name: str, features: DataFrame, k: int = 3) -> DataFrame:
    """One row per group: name, size, share as text, its first features and all of them."""
    listed = features.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("feature").cast("string").alias("feature")))).alias("__f"))
    out = groups.join(listed, group, "left").withColumn("__f", F.transform("__f", lambda x: x["feature"]))
    return out.select(
        F.col(group), F.col(name), "n", F.format_string("%.1f%%", 100 * F.col("n") / groups.agg(F.sum("n")).scalar()).alias("percentage"),
        F.array_join(F.slice("__f", 1, k), ", ").alias("top_features"), F.array_join("__f", ", ").alias("all_features"),
    )


def wrap(text: str | Column, width: int) -> Column:
    """The words of a text in lines of at most ``width`` characters (a longer word has its own line)."""
    words = F.filter(F.split(col(text), r"\s+"), lambda w: w != "")
    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, word: Column) -> Column:
        longer = F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        fits = (acc["line"] == "") | (F.length(longer) <= width)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], acc["line"], F.lit("\n"))).alias("done"), F.when(fits, longer).otherwise(word).alias("line"))

    return F.aggregate(words, begin, add, lambda acc: F.concat(acc["done"], acc["line"]))


def section(text: str | Column, header: str, limit: int = 200) -> Column:
    """What follows a header up to the next line that ends with a colon, cut at ``limit`` characters with an ellipsis; empty if absent."""
    body = F.regexp_extract(col(text), rf"(?s)(?:^|\n){re.escape(header)}:[ \t]*\n?(.*?)(?=\n[^\n]*:[ \t]*(?:\n|$)|$)", 1)
    body = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("..."))).otherwise(body)


#: Fixed words that stand for the prompt, not for a name.
PROMPT_WORDS = ("name", "phenotype name", "phenotype", "title", "1.", "### 1. pheno", "### 1. name", "pheno", "### 1.")
#: Fixed words of which a line without a label must hold one.
DESCRIPTIVE = ("pattern", "type", "profile", "syndrome", "dysfunction", "instability", "compromise")


def phenotype_name(text: str | Column, default: str = "Unnamed Phenotype") -> Column:
    """The name in an interpretation: labelled and quoted, else quoted, else labelled, else a descriptive line, else the text behind ``1.``.

    A name has 4 to 99 characters, at most 15 words, and is no word of the prompt;
    of several the first such one counts.  Lines are sought among the first ten.
    """
    t = col(text)
    label = r"PHENOTYPE NAME\s*:\s*"

    def fits(x: Column) -> Column:
        return ~F.lower(x).isin(*PROMPT_WORDS) & (F.length(x) > 3) & (F.length(x) < 100) & (F.size(F.split(x, r"\s+")) <= 15)

    def first(names: Column) -> Column:
        return F.get(F.filter(F.transform(names, lambda x: F.trim(x)), fits), F.lit(0))

    lines = F.slice(F.split(t, "\n"), 1, 10)
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^\w\s]+|[^\w\s]+$", "")), r"^\d+\.\s*", ""), f"(?i)^{label}", ""))
    described = F.filter(F.transform(lines, bare), lambda x: F.exists(F.array(*map(F.lit, DESCRIPTIVE)), lambda w: F.contains(F.lower(x), w)))
    numbered = F.transform(F.filter(lines, lambda x: F.trim(x).startswith("1.")), lambda x: F.btrim(F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), r"^\d+\.\s*", "")), f"(?i)^{label}", "")), F.lit("\"'")))
    found = [F.regexp_extract_all(t, F.lit(f'(?i){label}"([^"]+)"'), 1), F.regexp_extract_all(t, F.lit('"([^"]+)"'), 1), F.regexp_extract_all(t, F.lit(rf"(?i){label}([^\n]+)"), 1), described, numbered]
    return F.coalesce(*[first(x) for x in found], F.lit(default))


def file_name(title: str | Column) -> Column:
    return F.regexp_replace(col(title), "[ /]", "_")


def summary_document(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows as JSON lines: a text column for ``write.text``."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def analysis_summary(groups: DataFrame, group: str, name: str, categories: DataFrame, performance: DataFrame, features: int, at: str | None = None) -> DataFrame:
    """One JSON document: sizes, the share of each group, the features by category, and precision, recall, F1 and accuracy by class.

    ``groups`` has a row per group with its size ``n``; ``categories`` (category, n)
    and ``performance`` (cls, support, hits, precision, recall, f1) a few rows each.
    """
    total = groups.agg(F.sum("n")).scalar()
    share = F.struct(F.col(group).alias("cluster_id"), F.col(name).alias("phenotype_name"), F.col("n").alias("n_patients"), (100 * F.col("n") / total).alias("percentage"))
    spread = groups.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(group).cast("string").alias("k"), share.alias("v"))))).alias("phenotype_distribution"), F.sum("n").alias("__n"), F.count("*").alias("__k"))
    kinds = categories.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("feature_categories"))
    by_class = F.sort_array(F.collect_list(F.struct("cls", "precision", "recall", "f1")))
    quality = performance.agg(by_class.alias("__c"), (F.sum("hits") / F.sum("support")).alias("accuracy"))
    of = lambda k: F.transform("__c", lambda x: x[k])
    quality = quality.select(F.struct(of("precision").alias("precision"), of("recall").alias("recall"), of("f1").alias("f1_score"), "accuracy").alias("model_performance"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    when = F.lit(at) if at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    info = F.struct(F.col("__n").alias("total_patients"), F.lit(features).alias("total_features_selected"), F.col("__k").alias("n_phenotypes"), when.alias("analysis_timestamp"))
    joined = one(spread).join(one(kinds), "__one").join(one(quality), "__one")  # one row each
    return joined.select(F.to_json(F.struct(info.alias("analysis_info"), "phenotype_distribution", "feature_categories", "model_performance")).alias("value"))


def card(group: Column, name: Column, size: Column, share: Column, features: Column) -> Column:
    """The text of a group's summary card."""
    return F.concat_ws("\n", F.format_string("PHENOTYPE %s: %s", group, name), F.format_string("Patients: %s (%.1f%%)", F.format_number(size, 0), share), F.concat(F.lit("Key features: "), features))
