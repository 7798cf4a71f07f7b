"""Scores of predictions. Everything follows from counts per (label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.classes import best_code, blend, fog_probability, is_fog


def confusion(df: DataFrame, keys: Sequence[str], label: str = "code", pred: str = "pred") -> DataFrame:
    """Counts per key, label and prediction: at most 121 rows per key leave the partial aggregate."""
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and class in truth or prediction: support, predicted, hits and F1 (0 when undefined)."""
    sides = counts.select(*keys, F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))).alias("_s"))
    summed = sides.select(*keys, "_s.*").groupBy(*keys, "cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return summed.withColumn("f1", f1)


def scores(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, weighted F1, fog F1, macro F1, blend score and the one-class flag per key.

    Fog F1 averages over the fog codes present in the truth and is null without any; the
    blend score falls back to the mean over every class in truth or prediction.
    """
    per_class = class_scores(counts, keys)
    fog = F.when(is_fog("cls") & (F.col("support") > 0), F.col("f1"))
    out = per_class.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg(fog).alias("fog_f1"), F.avg("f1").alias("macro_f1"),
        (F.count_if(F.col("support") > 0) < 2).alias("one_class"))
    return out.withColumn("blend_score", F.coalesce("fog_f1", "macro_f1"))


def evaluate(df: DataFrame, keys: Sequence[str], label: str = "code", pred: str = "pred") -> DataFrame:
    return scores(confusion(df, keys, label, pred), keys)


def best_threshold(df: DataFrame, keys: Sequence[str], label: str = "code",
                   prob: str = "fog_prob") -> DataFrame:
    """Threshold with the best binary fog F1 per key, the lowest on a tie.

    Each row is reduced to how many thresholds it reaches; the counts per (reached, fog) are
    what is compared, so rows are not multiplied by the thresholds. Keys whose truth is all
    fog or no fog keep the default.
    """
    reached = None
    for t in K.THRESHOLDS:
        hit = F.when(F.col(prob) >= t, 1).otherwise(0)
        reached = hit if reached is None else reached + hit
    counts = (df.withColumn("_reached", reached).withColumn("_fog", is_fog(label))
              .groupBy(*keys, "_reached")
              .agg(F.count_if("_fog").alias("_f"), F.count_if(~F.col("_fog")).alias("_o")))
    aggs = [F.sum("_f").alias("n_fog"), F.sum(F.col("_f") + F.col("_o")).alias("n")]
    for i in range(1, len(K.THRESHOLDS) + 1):
        aggs += [F.sum(F.when(F.col("_reached") >= i, F.col("_f")).otherwise(0)).alias(f"_tp{i}"),
                 F.sum(F.when(F.col("_reached") >= i, F.col("_o")).otherwise(0)).alias(f"_fp{i}")]
    per_key = counts.groupBy(*keys).agg(*aggs)

    def f1(i):
        return F.coalesce(F.try_divide(2 * F.col(f"_tp{i}"),
                                       F.col(f"_tp{i}") + F.col(f"_fp{i}") + F.col("n_fog")), F.lit(0.0))

    # Largest F1 first; the negated threshold makes the lowest one win a tie.
    best = F.greatest(*[F.struct(f1(i).alias("f1"), F.lit(-t).alias("t"))
                        for i, t in enumerate(K.THRESHOLDS, start=1)])
    separable = (F.col("n_fog") > 0) & (F.col("n_fog") < F.col("n"))
    return (per_key.withColumn("_best", best)
            .select(*keys, F.when(separable, -F.col("_best.t")).otherwise(K.DEFAULT_THRESHOLD).alias("threshold"),
                    F.when(separable, F.col("_best.f1")).alias("threshold_f1")))


def weight_scores(df: DataFrame, keys: Sequence[str], forest: str, boosted: str,
                  label: str = "code") -> DataFrame:
    """Blend score of each candidate weight per key, from two slot arrays."""
    # Per row only the five predicted codes are listed, and rows with the same codes collapse
    # before anything is multiplied.
    codes = {f"_c{i}": best_code(blend(forest, boosted, w)) for i, w in enumerate(K.BLEND_WEIGHTS)}
    merged = df.withColumns(codes).groupBy(*keys, label, *codes).agg(F.count(F.lit(1)).alias("_n"))
    per_weight = merged.select(*keys, F.col(label).alias("label"), "_n", F.explode(F.array(*[
        F.struct(F.lit(w).alias("w"), F.col(c).alias("pred")) for c, w in zip(codes, K.BLEND_WEIGHTS)])).alias("_e"))
    counts = (per_weight.select(*keys, "_e.w", "label", "_e.pred", "_n")
              .groupBy(*keys, "w", "label", "pred").agg(F.sum("_n").alias("n")))
    return scores(counts, [*keys, "w"]).select(*keys, "w", F.col("blend_score").alias("score"))


def best_weight(df: DataFrame, keys: Sequence[str], forest: str, boosted: str,
                label: str = "code") -> DataFrame:
    """Weight with the best score, the larger forest weight on a tie."""
    scored = weight_scores(df, keys, forest, boosted, label)
    best = F.max(F.struct("score", "w"))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.w").alias("weight"),
                                                              F.col("_b.score").alias("score"))


def run_means(registry: DataFrame) -> DataFrame:
    """Means over locations; component means only over locations that have a fog F1."""
    scored = F.col("fog_f1").isNotNull()
    return registry.agg(
        F.count(F.lit(1)).alias("n_models"), F.count("fog_f1").alias("n_scored"),
        F.avg("accuracy").alias("mean_accuracy"), F.avg("fog_f1").alias("mean_fog_f1"),
        F.avg(F.when(scored, F.col("forest_fog_f1"))).alias("mean_forest_fog_f1"),
        F.avg(F.when(scored, F.col("boosted_fog_f1"))).alias("mean_boosted_fog_f1"))


def top_features(importances: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """The ``n`` largest blended importances per key; rows are (feature, forest, boosted, weight)."""
    blended = F.col("weight") * F.col("forest") + (1 - F.col("weight")) * F.col("boosted")
    # One row per feature, so a key holds as many rows as the model has features.
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), F.desc("position"))
    return (importances.withColumn("importance", blended).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))


__all__ = ["best_threshold", "best_weight", "class_scores", "confusion", "evaluate", "fog_probability",
           "run_means", "scores", "top_features", "weight_scores"]
