"""Selection, per-location training, the pooled model, scoring and the model store."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml.classification import OneVsRestModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.classes import best_code, blend, fog_probability
from fogbank.models import store
from fogbank.models.components import (BOOST_SPACE, FOREST_SPACE, Boosted, BoostParams, Forest, ForestParams, assemble,
                                       draws, params_of)
from fogbank.operators import metrics, splits
from fogbank.operators.features import with_columns_for
from fogbank.operators.segments import time_segment
from fogbank.session import materialise, new_table_path


def resolve_kind(kind: str | None) -> str:
    chosen = (kind or K.DEFAULT_KIND).lower()
    if chosen not in K.MODEL_KINDS:
        raise ValueError(f"model kind must be one of {K.MODEL_KINDS}, not {kind!r}")
    return chosen


def kind_column(asked: Column) -> Column:
    """``resolve_kind`` of a column of names."""
    chosen = F.lower(F.coalesce(asked, F.lit(K.DEFAULT_KIND)))
    return F.when(chosen.isin(*K.MODEL_KINDS), chosen).otherwise(F.raise_error(F.concat(F.lit("no model kind: "), asked)))


@dataclass(frozen=True)
class Plan:
    """How models are fitted. ``learner``: ``grouped`` grows the trees of all locations in one pass (``fleet``), ``ml`` fits every
    location with Spark ML from a pool of threads.

    ``forest_draws`` and ``boosted_draws`` settings are tried per search; 10 and 8 is the full
    search, 0 takes the given parameters. ``search`` says where: once on the pooled rows, or
    again for every location (learner ``ml`` only), in the given spaces (learner ``grouped`` only). Either way it sees the fit rows alone, never those a model is
    later chosen or scored on. Weight and threshold are chosen when at least ``min_validation_rows``
    rows and two codes are there for it, and keep their defaults otherwise; the registry says so in ``selected``.
    """

    kind: str = K.DEFAULT_KIND
    learner: str = "grouped"
    forest: ForestParams = ForestParams()
    boosted: BoostParams = BoostParams()
    forest_draws: int = 0
    boosted_draws: int = 0
    search: str = "pooled"
    forest_space: dict = field(default_factory=lambda: FOREST_SPACE)
    boosted_space: dict = field(default_factory=lambda: BOOST_SPACE)
    threads: int = 4
    min_rows: int = K.MIN_ROWS
    min_classes: int = K.MIN_CLASSES
    pool_min_rows: int = K.POOL_MIN_ROWS
    rescue_min_rows: int = K.RESCUE_MIN_ROWS
    min_validation_rows: int = K.MIN_VALIDATION_ROWS


@dataclass
class FogModel:
    """A forest and boosted trees whose probabilities are mixed by ``weight``."""

    features: list[str]
    forest: Forest | None
    boosted: Boosted | None
    weight: float = 0.5
    threshold: float = K.DEFAULT_THRESHOLD
    tuned: bool = False
    medians: dict[str, float] = field(default_factory=dict)
    selected: bool = False

    def __post_init__(self):
        if self.forest is None and self.boosted is None:
            raise ValueError("a model needs a forest or boosted trees")
        if self.forest is None:
            self.weight = 0.0
        elif self.boosted is None:
            self.weight = 1.0

    @property
    def kind(self) -> str:
        return "gbt" if self.forest is None else "rf" if self.boosted is None else "hybrid"

    def slots(self, df: DataFrame) -> DataFrame:
        """Add the slot arrays ``forest`` and ``boosted`` (when there is one) and ``mixed``."""
        known = with_columns_for(df, self.features).withColumns({
            f: F.coalesce(F.col(f).cast("double"), F.lit(self.medians.get(f, 0.0))) for f in self.features})
        out = assemble(known, self.features)
        for part in (self.forest, self.boosted):
            if part is not None:
                out = part.slots(out)
        mixed = (F.col("boosted") if self.forest is None else F.col("forest") if self.boosted is None
                 else blend("forest", "boosted", self.weight))
        return out.withColumn("mixed", mixed).drop("features")

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` with pred, fog_prob, and the predictions of the unmixed parts."""
        scored = self.slots(df)
        alone = {f"{n}_pred": best_code(n) if part is not None else F.lit(None).cast("int")
                 for n, part in (("forest", self.forest), ("boosted", self.boosted))}
        return scored.select(*keep, best_code("mixed").alias("pred"), fog_probability("mixed").alias("fog_prob"),
                             *[e.alias(n) for n, e in alone.items()])


def _fit_parts(kind: str, df: DataFrame, features: Sequence[str], forest: ForestParams, boosted: BoostParams,
               classes: Sequence[int]) -> tuple[Forest | None, Boosted | None]:
    return (Forest.fit(df, features, forest) if kind != "gbt" else None,
            Boosted.fit(df, features, boosted, classes) if kind != "rf" else None)


def _class_counts(df: DataFrame, fit: Column) -> tuple[list[int], list[int], int]:
    """Classes of all rows, classes of the fit part, rows outside it: at most 22 counts."""
    rows = df.groupBy(F.coalesce(fit, F.lit(False)).alias("fit"), "code").count().collect()
    return (sorted({r.code for r in rows}), sorted({r.code for r in rows if r.fit}),
            sum(r["count"] for r in rows if not r.fit))


def search(df: DataFrame, features: Sequence[str], part: str, n: int, ties: Sequence[str] = ()):
    """Best of ``n`` random settings by mean blend score over forward-chaining folds.

    The folds are ranges of (ts, ties) whose ends are looked up in counts, so no row is ranked.
    """
    total = df.count()
    k = 3 if total >= 300 else 2
    size = total // (k + 1)
    ends = [splits.row_at(df, total - (k - i) * size, "ts", ties) for i in range(k if size else 0)]
    fold = sum((F.when(~splits.up_to(end), 1).otherwise(0) for end in ends), F.lit(0))
    if not size:
        return None
    folds = df.select("ts", *ties, "code", *features, fold.alias("_fold"))
    sizes = {r["_fold"]: r["classes"] for r in
             folds.groupBy("_fold").agg(F.collect_set("code").alias("classes")).collect()}
    best, best_score = None, -1.0
    space, params = (FOREST_SPACE, ForestParams) if part == "forest" else (BOOST_SPACE, BoostParams)
    for setting in draws(space, params, n):
        scores = []
        for f in sorted(k for k in sizes if k > 0):
            train, test = folds.filter(F.col("_fold") < f), folds.filter(F.col("_fold") == f)
            classes = sorted({c for k, cs in sizes.items() if k < f for c in cs})
            if part == "forest":
                fitted = FogModel(list(features), Forest.fit(train, features, setting), None)
            else:
                fitted = FogModel(list(features), None, Boosted.fit(train, features, setting, classes))
            scores.append(metrics.evaluate(fitted.predict(test, ["code"]), []).first().blend_score)
        mean = sum(scores) / len(scores)
        if mean > best_score:
            best, best_score = setting, mean
    return best


def fit_and_select(train: DataFrame, fit: Column, features: Sequence[str], plan: Plan,
                   ties: Sequence[str] = (), tune: bool = False, tuned: bool = False) -> FogModel:
    """Fit on the rows marked ``fit``, choose weight and threshold on the others, refit on all.

    ``tuned`` says that the plan's parameters already come from a search.
    """
    kind = resolve_kind(plan.kind)
    classes, fit_classes, n_val = _class_counts(train, fit)
    have_val = len(fit_classes) >= 2 and n_val >= plan.min_validation_rows
    inner = train.filter(fit) if have_val else train
    forest, boosted = plan.forest, plan.boosted
    if tune and kind != "gbt" and plan.forest_draws:
        forest, tuned = search(inner, features, "forest", plan.forest_draws, ties) or forest, True
    if tune and kind != "rf" and plan.boosted_draws:
        boosted, tuned = search(inner, features, "boosted", plan.boosted_draws, ties) or boosted, True
    weight, threshold = 0.5, K.DEFAULT_THRESHOLD
    if have_val:
        parts = _fit_parts(kind, inner, features, forest, boosted, fit_classes)
        trial = FogModel(list(features), *parts)
        val = trial.slots(train.filter(~fit)).select("code", *[
            n for n, p in zip(("forest", "boosted"), parts) if p is not None])
        if kind == "hybrid":
            weight = metrics.best_weight(val, [], "forest", "boosted").first().weight
            mixed = blend("forest", "boosted", weight)
        else:
            mixed = F.col("forest" if kind == "rf" else "boosted")
        chosen = metrics.best_threshold(val.select("code", fog_probability(mixed).alias("fog_prob")), [])
        threshold = chosen.first().threshold
    final = _fit_parts(kind, train, features, forest, boosted, classes)
    middle = train.agg(*[F.percentile_approx(f, 0.5).alias(f) for f in features]).first()
    return FogModel(list(features), *final, weight, threshold, tuned, {f: float(middle[f]) for f in features}, have_val)


@dataclass
class Trained:
    """``models`` by location (rescued ones share the pooled model), ``registry`` with one row per
    model location, ``eligible`` with counts and the reason a location has no model of its own."""

    models: dict[str, FogModel]
    registry: DataFrame
    eligible: DataFrame
    test_predictions: DataFrame | None

    @property
    def has_models(self) -> bool:
        return bool(self.models)

    def predict(self, prepared: DataFrame) -> DataFrame:
        return predict_forecast(self.models, prepared)

    def importances(self, n: int = 3) -> DataFrame:
        return feature_importances(self.registry.sparkSession, self.models, n)


def location_cuts(rows: DataFrame, plan: Plan) -> DataFrame:
    """Eligibility and the times at which a location's fit and train parts end.

    Works on (location_id, ts, code) alone. A location has one row per time, so the parts are
    time ranges, and later reads can filter by them.
    """
    split = splits.temporal_split(rows.select("location_id", "ts", "code"), ["location_id"])
    ends = split.groupBy("location_id").agg(
        F.max(F.when(F.col("part") == "fit", F.col("ts"))).alias("fit_end"),
        F.max(F.when(F.col("split") == "train", F.col("ts"))).alias("train_end"))
    return splits.eligibility(split, ["location_id"], min_rows=plan.min_rows, min_classes=plan.min_classes).join(
        ends, "location_id")


def train_locations(rows: DataFrame, features: Sequence[str], plan: Plan = Plan(),
                    locations: DataFrame | None = None) -> Trained:
    """One model per location, and a pooled one for the locations short of data.

    ``rows``: (location_id, ts, code, features) of recorded hours outside suspicious blocks,
    complete and unique per location and ts. They are written once, partitioned by location;
    every fit then reads its own partitions. Fits run from a small thread pool as ordinary
    Spark jobs, and all test predictions are scored together.
    """
    spark = rows.sparkSession
    kind = resolve_kind(plan.kind)
    table = materialise(rows.select("location_id", "ts", F.col("code").cast("int").alias("code"), *features)
                        .repartition("location_id", time_segment("ts")), "training-rows", ("location_id",))
    cuts = materialise(location_cuts(table, plan), "location-cuts")
    # One row per location: the list of models the driver has to fit.
    gates = cuts.collect()
    own = [g for g in gates if g.reason is None]
    short = [g for g in gates if g.reason is not None]
    searched = plan.search == "pooled" and bool(own) and bool(plan.forest_draws or plan.boosted_draws)
    if searched:
        known = cuts.filter(F.col("reason").isNull() & F.col("fit_end").isNotNull()).select("location_id", "fit_end")
        seen = table.join(known, "location_id").filter(F.col("ts") <= F.col("fit_end")).drop("fit_end")
        plan = _tuned_plan(materialise(seen, "search-rows"), features, plan)

    predictions = new_table_path(spark, "test-predictions")
    models: dict[str, FogModel] = {}

    # A folder per job: concurrent jobs must not commit into the same one.
    def fit(numbered) -> tuple[str, FogModel]:
        i, g = numbered
        mine = table.filter(F.col("location_id") == g.location_id)
        train = mine.filter(F.col("ts") <= F.lit(g.train_end))
        model = fit_and_select(train, F.col("ts") <= F.lit(g.fit_end) if g.fit_end else F.lit(False), features, plan,
                               tune=plan.search == "location", tuned=searched)
        model.predict(mine.filter(F.col("ts") > F.lit(g.train_end)), ["location_id", "ts", "code"]).withColumn(
            "pooled", F.lit(False)).write.parquet(f"{predictions}/own-{i}")
        return g.location_id, model

    with ThreadPoolExecutor(max(1, plan.threads)) as pool:
        models.update(pool.map(fit, enumerate(own)))

    pooled, rescued = None, []
    if short:
        pooled = _fit_pooled(table, features, plan, searched)
        rescued = [g for g in short if pooled and g.n >= plan.rescue_min_rows and g.n_classes >= 2 and g.n_test_classes]
    if rescued:
        known = cuts.filter(F.col("reason").isNotNull() & (F.col("n") >= plan.rescue_min_rows)
                            & (F.col("n_classes") >= 2)).select("location_id", "train_end")
        theirs = table.join(known, "location_id").filter(F.col("ts") > F.col("train_end"))
        pooled.predict(theirs, ["location_id", "ts", "code"]).withColumn("pooled", F.lit(True)).write.parquet(
            f"{predictions}/rescued")
        models.update({g.location_id: pooled for g in rescued})

    eligible = cuts.drop("fit_end", "train_end")
    if locations is not None:
        eligible = splits.with_lost_locations(eligible, locations, ["location_id"])
    if not models:
        # No location has enough rows and codes: a registry without rows, with the columns of any other.
        null = F.lit(None).cast("int")
        tested = table.filter(F.lit(False)).select("location_id", "ts", "code", null.alias("pred"), F.lit(0.0).alias("fog_prob"),
                                                   null.alias("forest_pred"), null.alias("boosted_pred"), F.lit(False).alias("pooled"))
        return Trained({}, _registry(spark, {}, set(), tested, table, kind), eligible, None)
    tested = spark.read.parquet(f"{predictions}/*")
    return Trained(models, _registry(spark, models, {g.location_id for g in rescued}, tested, table, kind),
                   eligible, tested)


def _tuned_plan(table: DataFrame, features: Sequence[str], plan: Plan) -> Plan:
    forest, boosted = plan.forest, plan.boosted
    if plan.kind != "gbt" and plan.forest_draws:
        forest = search(table, features, "forest", plan.forest_draws, ["location_id"]) or forest
    if plan.kind != "rf" and plan.boosted_draws:
        boosted = search(table, features, "boosted", plan.boosted_draws, ["location_id"]) or boosted
    return replace(plan, forest=forest, boosted=boosted)


def _fit_pooled(table: DataFrame, features: Sequence[str], plan: Plan, tuned: bool = False) -> FogModel | None:
    """One model from the rows of all locations, split by (ts, location).

    Only the two rows at which the parts end are looked up; no row is ranked.
    """
    n = table.count()
    if n < max(plan.pool_min_rows, 3):
        return None
    order = ("ts", ["location_id"])
    n_train = _head(n)
    train_end = splits.row_at(table, n_train, *order)
    fit_end = splits.row_at(table, _head(n_train), *order)
    train = table.filter(splits.up_to(train_end))
    # At most eleven codes.
    if len(train.select("code").distinct().collect()) < 2:
        return None
    return fit_and_select(train, splits.up_to(fit_end), features, plan, ties=["location_id"],
                          tune=plan.search == "location", tuned=tuned)


def _head(n: int) -> int:
    """``splits.train_rows`` of a number on the driver."""
    head = max(1, int(n * (1 - 0.2)))
    return n - 1 if head >= n else head


REGISTRY = ("location_id string, model_type string, blend_weight double, threshold double, tuned boolean, "
            "selected boolean, pooled boolean, features string, medians string, params string, classes string")


def _describe(location: str, model: FogModel, pooled: bool) -> tuple:
    params = {n: params_of(p.params) for n, p in (("forest", model.forest), ("boosted", model.boosted)) if p}
    classes = model.boosted.classes if model.boosted else []
    return (location, f"pooled({model.kind})" if pooled else model.kind, float(model.weight), float(model.threshold),
            bool(model.tuned), bool(model.selected), pooled, json.dumps(model.features), json.dumps(model.medians), json.dumps(params),
            json.dumps(classes))


def _registry(spark, models, rescued, tested, table, kind) -> DataFrame:
    """Descriptions of the models beside the scores of all of them from grouped queries."""
    described = spark.createDataFrame([_describe(k, m, k in rescued) for k, m in models.items()], REGISTRY)
    key = ["location_id"]
    main = metrics.evaluate(tested, key).select(*key, "accuracy", "weighted_f1", "fog_f1",
                                                F.col("one_class").alias("eval_trivial"))
    out = described.join(main, key, "left")
    for part in ("forest", "boosted"):
        if (part == "forest" and kind == "gbt") or (part == "boosted" and kind == "rf"):
            out = out.withColumn(f"{part}_fog_f1", F.lit(None).cast("double"))
            continue
        alone = metrics.evaluate(tested.filter(~F.col("pooled")), key, pred=f"{part}_pred")
        out = out.join(alone.select(*key, F.col("fog_f1").alias(f"{part}_fog_f1")), key, "left")
    sizes = table.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("code")).alias("codes"))
    return materialise(out.join(sizes, key, "left"), "model-registry")


def feature_importances(spark: SparkSession, models: dict[str, FogModel], n: int = 3) -> DataFrame:
    """The most important features per location. The input is a few numbers per model."""
    rows = []
    for location, m in models.items():
        forest = (m.forest and m.forest.importances()) or [0.0] * len(m.features)
        boosted = (m.boosted and m.boosted.importances()) or [0.0] * len(m.features)
        rows += [(location, f, i, a, b, float(m.weight)) for i, (f, a, b) in enumerate(zip(m.features, forest, boosted))]
    table = spark.createDataFrame(rows, "location_id string, feature string, position int, forest double, "
                                        "boosted double, weight double")
    return metrics.top_features(table, ["location_id"], n).select("location_id", "rank", "feature", "importance")


def predict_forecast(models: dict[str, FogModel], prepared: DataFrame) -> DataFrame:
    """Predictions (location_id, ts, code, fog_prob) of prepared forecast rows of every location.

    Locations that share a model are scored together. Without a model there is no prediction.
    """
    if not models:
        return prepared.filter(F.lit(False)).select("location_id", "ts", F.lit(None).cast("int").alias("code"), F.lit(None).cast("double").alias("fog_prob"))
    groups: dict[int, tuple[FogModel, list[str]]] = {}
    for location, model in models.items():
        groups.setdefault(id(model), (model, []))[1].append(location)
    parts = [m.predict(prepared.filter(F.col("location_id").isin(*names)), ["location_id", "ts"])
             for m, names in groups.values()]
    return reduce(DataFrame.unionByName, parts).select("location_id", "ts", F.col("pred").alias("code"), "fog_prob")


# --- store ---------------------------------------------------------------------------------

def save_models(trained: Trained, path: str) -> None:
    """A new version of the store (``store``): fitted parts as Spark ML folders, the registry as a table."""
    some = next(iter(trained.models.values()))
    store.commit(trained.registry.sparkSession, path, lambda folder: _write_models(trained, folder),
                 {"learner": "ml", "features": some.features})


def _write_models(trained: Trained, path: str) -> None:
    """Shared models are stored once."""
    stored: dict[int, str] = {}
    folders = []
    for i, (location, model) in enumerate(trained.models.items()):
        if id(model) not in stored:
            stored[id(model)] = f"model-{i}"
            for name, part in (("forest", model.forest), ("boosted", model.boosted)):
                if part is not None:
                    part.model.write().overwrite().save(f"{path}/{stored[id(model)]}/{name}")
        folders.append((location, stored[id(model)]))
    spark = trained.registry.sparkSession
    names = spark.createDataFrame(folders, "location_id string, folder string")
    trained.eligible.write.mode("overwrite").parquet(f"{path}/eligible")
    trained.registry.join(names, "location_id").write.mode("overwrite").parquet(f"{path}/registry")


def load_models(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Trained | None:
    """The newest complete version (with these features), if there is one."""
    return store.load(spark, path, lambda folder: _read_models(spark, folder),
                      {"learner": "ml", **({"features": list(features)} if features else {})})


def _read_models(spark: SparkSession, path: str) -> Trained:
    registry = spark.read.parquet(f"{path}/registry")
    shared: dict[str, FogModel] = {}
    models: dict[str, FogModel] = {}
    for r in registry.collect():  # one row per model location
        if r.folder not in shared:
            params = json.loads(r.params)
            forest = boosted = None
            if "forest" in params:
                forest = Forest(RandomForestClassificationModel.load(f"{path}/{r.folder}/forest"),
                                ForestParams(**params["forest"]))
            if "boosted" in params:
                boosted = Boosted(OneVsRestModel.load(f"{path}/{r.folder}/boosted"), json.loads(r.classes),
                                  BoostParams(**params["boosted"]))
            shared[r.folder] = FogModel(json.loads(r.features), forest, boosted, r.blend_weight, r.threshold, r.tuned,
                                        json.loads(r.medians), r.selected)
        models[r.location_id] = shared[r.folder]
    return Trained(models, registry.drop("folder"), spark.read.parquet(f"{path}/eligible"), None)


def load_or_train(spark: SparkSession, path: str | None, train, load=load_models, save=save_models, features: Sequence[str] | None = None):
    """Stored models when a complete version (with these features) can be read, else ``train()``, whose models are stored."""
    found = load(spark, path, features) if path else None
    if found is not None:
        return found
    trained = train()
    if path and trained.has_models:
        save(trained, path)
    return trained
