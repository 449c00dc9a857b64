"""Classifier metrics, samples and telemetry summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.groupBy(gold, pred).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, gold: str, pred: str, classes: list[str], high: str) -> DataFrame:
    """One row: n, accuracy, recall of each class (0 without members), precision of ``high``."""
    right, ratio = F.col(gold) == F.col(pred), lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    aggs = [F.count("*").alias("n"), ratio(F.count_if(right), F.count("*")).alias("accuracy")]
    aggs += [ratio(F.count_if(right & (F.col(gold) == c)), F.count_if(F.col(gold) == c)).alias(f"recall_{c}") for c in classes]
    return rows.agg(*aggs, ratio(F.count_if(right & (F.col(pred) == high)), F.count_if(F.col(pred) == high)).alias(f"precision_{high}"))


def auc(rows: DataFrame, label: str, score: str, ranges: int = 64) -> DataFrame:
    """One row: positives, negatives, auc by rank sums with tied scores at half; NaN without both.

    Distinct scores are counted and dealt to ``ranges`` by approximate quantiles; a window ranks
    within a range, and each range carries the negatives of those below it.  Null scores are
    left out.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    cuts = sorted(set(counts.approxQuantile("s", [i / ranges for i in range(1, ranges)], 0.005)))
    counts = counts.withColumn("r", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("s"))) if cuts else F.lit(0))
    sums = counts.groupBy("r").agg(F.sum("n").alias("all"))  # at most ``ranges`` rows
    lower = sums.select(F.col("r").alias("low"), F.col("all").alias("low_n"))
    before = sums.join(F.broadcast(lower), F.col("low") < F.col("r"), "left").groupBy("r").agg(F.coalesce(F.sum("low_n"), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.join(F.broadcast(before), "r").withColumn("wins", F.col("p") * (F.col("before") + within + F.col("n") / 2))
    total = parts.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("wins").alias("w"))
    value = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.round(F.col("w") / (F.col("positives") * F.col("negatives")), 6)).otherwise(F.lit(float("nan")))
    return total.select("positives", "negatives", value.alias("auc"))


def binary_metrics(rows: DataFrame, label: str, score: str, cut: float = 0.5, least_auc: float = 0.55) -> DataFrame:
    """One row: precision, recall and f1 of scores of ``cut`` or more, auc, and whether it is above ``least_auc``.

    A ratio without a denominator is 0; an auc of one class is NaN and does not pass.
    """
    said, true = F.col(score) >= cut, F.col(label) == 1
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    hit = F.count_if(said & true)
    one = rows.agg(ratio(hit, F.count_if(said)).alias("precision"), ratio(hit, F.count_if(true)).alias("recall"), ratio(2 * hit, F.count_if(said) + F.count_if(true)).alias("f1"))
    area = auc(rows, label, score).select("auc", (~F.isnan("auc") & (F.col("auc") > least_auc)).alias("passes"))
    return one.crossJoin(F.broadcast(area))  # one row each


def upper_median(values: Column) -> Column:
    """``sorted[n // 2]`` of an array."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def stratified(rows: DataFrame, cells: list[str], key: str, n: int, seed: int) -> DataFrame:
    """One row per cell by a seeded hash of the key, then n of them."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    one = rows.withColumn("_h", h).withColumn("_n", F.row_number().over(Window.partitionBy(*cells).orderBy("_h", key))).where("_n = 1")
    return one.orderBy("_h", key).limit(n).drop("_h", "_n")


def fold_summary(rows: DataFrame) -> DataFrame:
    """Tokens at fold, calls and payloads over telemetry rows, by kind."""
    t = "tokens_at_fold"
    return rows.groupBy("kind").agg(
        F.count("*").alias("folds"), F.min(t).alias("least"), F.floor(F.percentile(t, 0.5)).cast("long").alias("middle"), F.max(t).alias("most"),
        F.sum("tool_calls").alias("calls"), F.array_join(F.array_sort(F.collect_set("trigger")), ",").alias("triggers"),
        F.round(F.try_divide(F.sum("tool_calls").cast("double"), F.sum("distinct_payloads")), 2).alias("retouch_ratio"),
    )


def clause_grade(uncapped: Column, unilateral: Column, ambiguous: Column, abstained: Column, truncated: Column) -> Column:
    """high, medium or low; null when an answer was withheld or the clause cut off."""
    grade = F.when((uncapped >= 0.75) | (unilateral >= 0.5), "high").when(ambiguous >= 0.5, "medium").otherwise("low")
    return F.when((F.coalesce(F.size(abstained), F.lit(0)) <= 0) & ~truncated, grade)
