"""The two learners: a random forest and one-versus-rest boosted trees, both from Spark ML."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, \
    RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.operators.splits import class_weights, code_counts

SEED = 42


@dataclass(frozen=True)
class ForestParams:
    trees: int = 500
    depth: int = 14
    min_leaf: int = 2
    features: str = "sqrt"


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 300
    depth: int = 4
    rate: float = 0.1
    subsample: float = 1.0
    features: str = "all"
    min_leaf: int = 1


# What the random search draws from. A forest of unlimited depth is not offered by Spark ML,
# whose limit is 30; a column share of 0.8 per tree becomes 0.8 per node.
FOREST_SPACE = {"trees": (200, 300, 500), "depth": (6, 8, 10, 12, 14, 30), "min_leaf": (1, 2, 3, 5),
                "features": ("sqrt", "log2", "all")}
BOOST_SPACE = {"rounds": (200, 400), "depth": (3, 4, 6, 8), "rate": (0.05, 0.1, 0.2), "subsample": (0.8, 1.0),
               "features": ("0.8", "all"), "min_leaf": (1, 3, 5)}


def draws(space: dict, kind: type, n: int, seed: int = SEED) -> list:
    """``n`` different random settings of a search space."""
    grid = list(itertools.product(*space.values()))
    return [kind(**dict(zip(space, values))) for values in random.Random(seed).sample(grid, min(n, len(grid)))]


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def no_slots() -> Column:
    """The slots of a learner that saw no row: nothing is known of any code."""
    return F.array(*[F.lit(None).cast("double")] * K.CODE_SLOTS)


@dataclass
class Forest:
    """``model``: none if there was no row to fit."""

    model: RandomForestClassificationModel | None
    params: ForestParams

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], params: ForestParams, code: str = "code") -> Forest:
        """Balanced class weights; ``df`` has one row per observation and no null feature."""
        counts = code_counts(df, code)
        if not counts:
            return cls(None, params)
        rows = assemble(class_weights(df, [], code, counts=counts), features).select(
            F.col(code).cast("double").alias("label"), "weight", "features")
        learner = RandomForestClassifier(
            weightCol="weight", numTrees=params.trees, maxDepth=params.depth, minInstancesPerNode=params.min_leaf,
            featureSubsetStrategy=params.features, seed=SEED, cacheNodeIds=False, maxMemoryInMB=512)
        return cls(learner.fit(rows), params)

    def slots(self, df: DataFrame, name: str = "forest") -> DataFrame:
        """Add the probability of each code 0..10; codes the forest never saw have 0."""
        if self.model is None:
            return df.withColumn(name, no_slots())
        self.model.setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
        out = self.model.transform(df)
        p = vector_to_array("_p")
        return out.withColumn(name, F.array(*[
            F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(K.CODE_SLOTS)])).drop("_p")

    def importances(self) -> list[float]:
        return [float(x) for x in self.model.featureImportances.toArray()] if self.model else []


@dataclass
class Boosted:
    """``model``: none if there was no row to fit."""

    model: OneVsRestModel | None
    classes: list[int]
    params: BoostParams

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], params: BoostParams, classes: Sequence[int],
            code: str = "code") -> Boosted:
        """One binary booster per class. Codes may have gaps: they are numbered by ``classes``, of which those without a row drop out."""
        counts = code_counts(df, code)
        classes = [c for c in classes if c in counts]
        if not counts:
            return cls(None, classes, params)
        known = F.array(*[F.lit(int(c)) for c in classes])
        rows = assemble(class_weights(df, [], code, counts=counts), features).select(
            (F.array_position(known, F.col(code).cast("int")) - 1).cast("double").alias("label"), "weight", "features")
        booster = GBTClassifier(
            maxIter=params.rounds, maxDepth=params.depth, stepSize=params.rate, subsamplingRate=params.subsample,
            featureSubsetStrategy=params.features, minInstancesPerNode=params.min_leaf, seed=SEED)
        return cls(OneVsRest(classifier=booster, weightCol="weight", parallelism=4).fit(rows), list(classes), params)

    def slots(self, df: DataFrame, name: str = "boosted") -> DataFrame:
        """Each booster's probability of its class, scaled to sum 1 over the classes.

        The boosters are applied one by one: the combined model would pass every row through
        a Python function.
        """
        if self.model is None:
            return df.withColumn(name, no_slots())
        out = df
        for i, booster in enumerate(self.model.models):
            booster.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_raw{i}").setPredictionCol("")
            out = booster.transform(out).withColumn(f"_s{i}", F.get(vector_to_array(f"_p{i}"), F.lit(1)))
        shares = {c: F.col(f"_s{i}") for i, c in enumerate(self.classes)}
        total = sum(list(shares.values())[1:], list(shares.values())[0])
        return out.withColumn(name, F.array(*[
            shares[i] / total if i in shares else F.lit(0.0) for i in range(K.CODE_SLOTS)])
        ).drop(*[f"{c}{i}" for i in range(len(self.classes)) for c in ("_p", "_raw", "_s")])

    def importances(self) -> list[float]:
        """Mean over the boosters."""
        if self.model is None:
            return []
        per_class = [m.featureImportances.toArray() for m in self.model.models]
        return [float(x) for x in sum(per_class) / len(per_class)]


def params_of(p) -> dict:
    return asdict(p)
