"""Training, selection and scoring of all locations together, with trees grown in one pass (``grouped``).

A location's fit rows and train rows are two groups of the same pass, and so are those of the pooled model: no fit is a job of
its own. Weights and thresholds of all locations come from one grouped query over the validation rows, scores from one over the test rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.classes import best_code, blend, fog_probability
from fogbank.models import grouped, store
from fogbank.models.components import BoostParams, ForestParams, draws
from fogbank.models.training import Plan, location_cuts, resolve_kind
from fogbank.operators import metrics, splits
from fogbank.operators.features import with_columns_for
from fogbank.session import materialise

KEY = ["location_id"]


@dataclass
class Fleet:
    """``models``: one row per model (``grouped.grow`` with weight and threshold). ``registry``: one row per location that
    has one, with the name of its model (``grp``). ``eligible``: counts, and the reason a location has no model of its own."""

    models: DataFrame
    registry: DataFrame
    eligible: DataFrame
    features: list[str]
    test_predictions: DataFrame | None = None

    @property
    def has_models(self) -> bool:
        return not self.registry.isEmpty()

    def predict(self, prepared: DataFrame) -> DataFrame:
        """Predictions (location_id, ts, code, fog_prob) of prepared rows of every location; the plan is the same for any number."""
        known = with_columns_for(prepared, self.features).join(self.registry.select("location_id", "grp"), KEY)
        scored = predicted(known, self.models, self.features, ["location_id", "ts"])
        return scored.select("location_id", "ts", F.col("pred").alias("code"), "fog_prob")

    def importances(self, n: int = 3) -> DataFrame:
        table = grouped.importances(self.models, self.features).join(
            self.registry.select("location_id", "grp", F.col("blend_weight").alias("weight")), "grp")
        return metrics.top_features(table, KEY, n).select("location_id", "rank", "feature", "importance")


def mixed_slots(scored: DataFrame, weight: Column | str) -> DataFrame:
    """The slot array ``mixed`` of what parts there are."""
    both = {"forest", "boosted"} <= set(scored.columns)
    return scored.withColumn("mixed", blend("forest", "boosted", weight) if both else F.col("forest" if "forest" in scored.columns else "boosted"))


def predicted(rows: DataFrame, models: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``grp, keep, pred, fog_prob`` and the predictions of the unmixed parts."""
    scored = grouped.slots(rows, models.drop("weight", "threshold", "features"), features, keep).join(models.select("grp", "weight"), "grp")
    out = mixed_slots(scored, "weight")
    alone = [(best_code(n) if n in out.columns else F.lit(None).cast("int")).alias(f"{n}_pred") for n in ("forest", "boosted")]
    return out.select("grp", *keep, best_code("mixed").alias("pred"), fog_probability("mixed").alias("fog_prob"), *alone)


def search(rows: DataFrame, features: Sequence[str], part: str, n: int, space: dict):
    """Best of ``n`` random settings by the mean blend score over forward-chaining folds of pooled rows (location_id, ts, code, features).

    The folds of a setting are groups of one pass.
    """
    total = rows.count()
    k = 3 if total >= 300 else 2
    size = total // (k + 1)
    if not size:
        return None
    ends = [splits.row_at(rows, total - (k - i) * size, "ts", KEY) for i in range(k)]
    fold = sum((F.when(~splits.up_to(end), 1).otherwise(0) for end in ends), F.lit(0))
    folds = materialise(rows.select(*KEY, "ts", "code", *features, fold.alias("_fold")), "search-folds")
    train = folds.withColumn("grp", F.explode(F.sequence(F.lit(1), F.lit(k)))).where("_fold < grp").withColumn("grp", F.col("grp").cast("string"))
    best, best_score = None, -1.0
    for setting in draws(space, ForestParams if part == "forest" else BoostParams, n):
        models = grouped.grow(train, features, "rf" if part == "forest" else "gbt", *((setting, BoostParams()) if part == "forest" else (ForestParams(), setting)))
        test = folds.where("_fold > 0").withColumn("grp", F.col("_fold").cast("string"))
        scored = mixed_slots(grouped.slots(test, models, features, ["code"]), F.lit(1.0))
        mean = metrics.evaluate(scored.withColumn("pred", best_code("mixed")), ["grp"]).agg(F.avg("blend_score")).first()[0]
        if mean is not None and mean > best_score:
            best, best_score = setting, mean
    return best


def searched(rows: DataFrame, features: Sequence[str], plan: Plan) -> tuple[Plan, bool]:
    kind = resolve_kind(plan.kind)
    forest = search(rows, features, "forest", plan.forest_draws, plan.forest_space) if kind != "gbt" and plan.forest_draws else None
    boosted = search(rows, features, "boosted", plan.boosted_draws, plan.boosted_space) if kind != "rf" and plan.boosted_draws else None
    return replace(plan, forest=forest or plan.forest, boosted=boosted or plan.boosted), bool(forest or boosted)


def pooled_part(table: DataFrame, plan: Plan) -> Column | None:
    """The part of a pooled row, by (ts, location); none with too few rows or codes."""
    n = table.count()
    if n < max(plan.pool_min_rows, 3):
        return None
    n_train = n - 1 if max(1, int(n * 0.8)) >= n else max(1, int(n * 0.8))
    n_fit = n_train - 1 if max(1, int(n_train * 0.8)) >= n_train else max(1, int(n_train * 0.8))
    train, fit = (splits.up_to(splits.row_at(table, at, "ts", KEY)) for at in (n_train, n_fit))
    # At most eleven codes.
    if table.where(train).select("code").distinct().count() < 2:
        return None
    return F.when(fit, "fit").when(train, "val").otherwise("test")


def train_fleet(rows: DataFrame, features: Sequence[str], plan: Plan = Plan(), locations: DataFrame | None = None) -> Fleet:
    """Models of all locations, and a pooled one for those short of data.

    ``rows``: (location_id, ts, code, features) of recorded hours, complete and unique per location and ts.
    """
    kind = resolve_kind(plan.kind)
    table = materialise(rows.select(*KEY, "ts", F.col("code").cast("int").alias("code"), *features), "training-rows")
    cuts = materialise(location_cuts(table, plan), "location-cuts")
    own_part = F.when(F.col("ts") <= F.col("fit_end"), "fit").when(F.col("ts") <= F.col("train_end"), "val").otherwise("test")
    own = table.join(cuts.where("reason IS NULL").select(*KEY, "fit_end", "train_end"), KEY).select(
        F.concat(F.lit("own/"), "location_id").alias("base"), *KEY, "ts", "code", *features, own_part.alias("part"))
    short = cuts.where("reason IS NOT NULL")
    parts, pooled = own, None if short.isEmpty() else pooled_part(table, plan)
    if pooled is not None:
        parts = own.unionByName(table.select(F.lit("pooled").alias("base"), *KEY, "ts", "code", *features, pooled.alias("part")))
    parts = materialise(parts, "fleet-parts")
    tuned = False
    if plan.forest_draws or plan.boosted_draws:
        # Fit rows alone: those a model is chosen or scored on are never searched.
        plan, tuned = searched(materialise(own.where("part = 'fit'").drop("base", "part"), "search-rows"), features, plan)
    # Groups without enough to choose on keep the defaults, and need no model of their fit rows.
    enough = parts.groupBy("base").agg(F.count_if(F.col("part") == "val").alias("v"), F.count_distinct(F.when(F.col("part") == "fit", F.col("code"))).alias("c"))
    enough = materialise(enough.select("base", ((F.col("v") >= plan.min_validation_rows) & (F.col("c") >= 2)).alias("selected")), "fleet-selected")
    staged = parts.join(enough, "base").where("part <> 'test'").withColumn("stage", F.explode(F.when(
        F.col("selected") & (F.col("part") == "fit"), F.array(F.lit("train/"), F.lit("fit/"))).otherwise(F.array(F.lit("train/")))))
    grown = grouped.grow(staged.select(F.concat("stage", "base").alias("grp"), "code", *features), features, kind, plan.forest, plan.boosted)
    chosen = choices(parts.join(enough.where("selected"), "base").where("part = 'val'"), grown, features, kind)
    models = grown.where("grp LIKE 'train/%'").withColumn("grp", F.substring("grp", 7, 1 << 30))
    models = models.join(enough.withColumnRenamed("base", "grp"), "grp").join(chosen.withColumnRenamed("base", "grp"), "grp", "left")
    weight = {"rf": F.lit(1.0), "gbt": F.lit(0.0)}.get(kind, F.coalesce("weight", F.lit(0.5)))
    models = materialise(models.withColumns({"features": F.array(*map(F.lit, features)), "weight": weight, "threshold": F.coalesce("threshold", F.lit(K.DEFAULT_THRESHOLD))}), "fleet-models")

    assigned = cuts.where("reason IS NULL").select(*KEY, F.concat(F.lit("own/"), "location_id").alias("grp"), F.lit(False).alias("pooled"))
    if pooled is not None:
        rescued = short.where((F.col("n") >= plan.rescue_min_rows) & (F.col("n_classes") >= 2) & (F.col("n_test_classes") > 0))
        assigned = assigned.unionByName(rescued.select(*KEY, F.lit("pooled").alias("grp"), F.lit(True).alias("pooled")))
    tests = table.join(cuts.select(*KEY, "train_end"), KEY).where("ts > train_end").join(assigned, KEY)
    tested = materialise(predicted(tests, models, features, [*KEY, "ts", "code", "pooled"]), "test-predictions")
    eligible = cuts.drop("fit_end", "train_end")
    if locations is not None:
        eligible = splits.with_lost_locations(eligible, locations, KEY)
    return Fleet(models, described(assigned, models, tested, table, kind, tuned), eligible, list(features), tested)


def choices(val: DataFrame, grown: DataFrame, features: Sequence[str], kind: str) -> DataFrame:
    """``base, weight, threshold`` of all groups at once, from their validation rows and the models of their fit rows."""
    scored = grouped.slots(val.withColumn("grp", F.concat(F.lit("fit/"), "base")), grown, features, ["base", "code"])
    scored = materialise(scored.drop("grp"), "validation-slots")
    if kind == "hybrid":
        scored = scored.join(metrics.best_weight(scored, ["base"], "forest", "boosted").select("base", "weight"), "base")
    else:
        scored = scored.withColumn("weight", F.lit(1.0 if kind == "rf" else 0.0))
    best = metrics.best_threshold(mixed_slots(scored, "weight").select("base", "code", fog_probability("mixed").alias("fog_prob")), ["base"])
    return scored.groupBy("base").agg(F.first("weight").alias("weight")).join(best.select("base", "threshold"), "base")


def described(assigned: DataFrame, models: DataFrame, tested: DataFrame, table: DataFrame, kind: str, tuned: bool) -> DataFrame:
    out = assigned.join(models.select("grp", F.col("weight").alias("blend_weight"), "threshold", "selected"), "grp")
    out = out.withColumns({"model_type":
                           F.when(F.col("pooled"), F.lit(f"pooled({kind})")).otherwise(F.lit(kind)), "tuned": F.lit(tuned)})
    main = metrics.evaluate(tested, KEY).select(*KEY, "accuracy", "weighted_f1", "fog_f1", F.col("one_class").alias("eval_trivial"))
    out = out.join(main, KEY, "left")
    for part in ("forest", "boosted"):
        alone = metrics.evaluate(tested.where(~F.col("pooled") & F.col(f"{part}_pred").isNotNull()), KEY, pred=f"{part}_pred")
        out = out.join(alone.select(*KEY, F.col("fog_f1").alias(f"{part}_fog_f1")), KEY, "left")
    sizes = table.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("code")).alias("codes"))
    return materialise(out.join(sizes, KEY, "left"), "model-registry")


# --- store ---------------------------------------------------------------------------------

TABLES = ("models", "registry", "eligible")


def save_fleet(fleet: Fleet, path: str) -> None:
    """A new version of the store (``store``): three tables."""
    def write(folder: str) -> None:
        for name in TABLES:
            getattr(fleet, name).write.parquet(f"{folder}/{name}")

    store.commit(fleet.models.sparkSession, path, write, {"learner": "grouped", "features": fleet.features})


def load_fleet(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Fleet | None:
    """The newest complete version (with these features), if there is one."""
    def read(folder: str) -> Fleet:
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
        known = tables["models"].select("features").first()["features"]
        return Fleet(**tables, features=list(known))

    return store.load(spark, path, read, {"learner": "grouped", **({"features": list(features)} if features else {})})
