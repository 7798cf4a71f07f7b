"""Trees of all groups at once: quality floors, plan size, scoring against a walk of the stored trees, the versioned store."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogbank.models import grouped, store
from fogbank.models.components import BoostParams, ForestParams
from fogbank.models.fleet import load_fleet, save_fleet, train_fleet
from fogbank.models.training import Plan, load_or_train

NAMES = ["a", "b", "c"]
START = dt.datetime(2024, 1, 1)


def made(spark, groups, n=240):
    u = random.Random(5).random
    rows = []
    for g, codes in groups.items():
        for i in range(n):
            code = codes[int(u() * len(codes))]
            rows.append((g, START + dt.timedelta(hours=i), 3.0 * codes.index(code) + 2 * u(), u(), u(), code))
    return spark.createDataFrame(rows, "location_id string, ts timestamp, a double, b double, c double, code int")


@pytest.fixture(scope="module")
def rows(spark):
    return made(spark, {"p": (0, 2, 7), "q": (1, 4, 9), "r": (0, 5)}).cache()


@pytest.fixture(scope="module")
def grown(spark, rows):
    return grouped.grow(rows.withColumnRenamed("location_id", "grp"), NAMES, "hybrid", ForestParams(trees=9, depth=4), BoostParams(rounds=5, depth=2, rate=0.3, subsample=0.8, features="0.8"))


def test_floors_and_probabilities(rows, grown):
    out = grouped.slots(rows.withColumnRenamed("location_id", "grp"), grown, NAMES, ["ts", "code"]).collect()
    assert len(out) == 720
    for part in ("forest", "boosted"):
        assert np.mean([int(np.argmax(r[part])) == r["code"] for r in out]) > 0.9
        assert max(abs(sum(r[part]) - 1) for r in out) < 1e-12
    codes = {"p": {0, 2, 7}, "q": {1, 4, 9}, "r": {0, 5}}
    assert all({i for i, v in enumerate(r["boosted"]) if v > 0} == codes[r["grp"]] for r in out)


def test_scores_equal_a_walk_of_the_trees(rows, grown):
    models = {m["grp"]: m for m in grown.collect()}
    data = {(r["location_id"], r["ts"]): [r["a"], r["b"], r["c"]] for r in rows.collect()}

    def leaf(tree, x):
        node = 0
        while tree["left"][node] >= 0:
            node = tree["left"][node] + (x[tree["feature"][node]] > tree["cut"][node])
        return node

    for r in grouped.slots(rows.withColumnRenamed("location_id", "grp"), grown, NAMES, ["ts"]).collect():
        x, m = data[r["grp"], r["ts"]], models[r["grp"]]
        forest = np.mean([t["value"][leaf(t, x) * 11: leaf(t, x) * 11 + 11] for t in m["forest_trees"]], axis=0)
        score = np.zeros(11)
        for t in m["boosted_trees"]:
            score[t["cls"]] += t["value"][leaf(t, x)]
        e = np.exp(score) * np.isin(np.arange(11), [t["cls"] for t in m["boosted_trees"]])
        assert np.allclose(r["forest"], forest, atol=1e-9) and np.allclose(r["boosted"], e / e.sum(), atol=1e-9)


def test_splits_are_the_best_ones_of_brute_force():
    """Root split of one tree without bootstrap, against all cuts of all features."""
    rng = np.random.default_rng(3)
    bins, codes = rng.integers(0, 20, (400, 3)).astype(np.uint8), rng.integers(0, 3, 400).astype(np.uint8)
    codes[bins[:, 1] > 11] = 2
    tree = {"feature": np.zeros(1, int), "cut": np.zeros(1, int), "left": np.array([-1]), "value": np.zeros(11), "active": np.array([0])}
    weights = np.array([1.0, 2.0, 0.5] + [0.0] * 8)
    key = (np.arange(3) * 256 + bins) * 16 + codes[:, None]
    keys, n = np.unique(key, return_counts=True)
    got = grouped.split_forest(keys.astype(np.int64), n.astype(float), tree, weights, 3, 5)

    def worth(c):
        w = np.bincount(c, minlength=11) * weights
        return (w * w).sum() / max(w.sum(), 1e-300)

    best = max((worth(codes[bins[:, f] <= b]) + worth(codes[bins[:, f] > b]), -f, -b) for f in range(3) for b in range(19)
               if min((bins[:, f] <= b).sum(), (bins[:, f] > b).sum()) >= 5)
    assert (got["feature"][0], got["cut"][0]) == (-best[1], -best[2]) and got["left"][0] == 1 and len(got["left"]) == 3


def test_plans_do_not_grow_with_locations(spark, rows, grown):
    def size(models, names):
        wide = rows.where("location_id = 'p'").withColumn("grp", F.explode(F.array(*map(F.lit, names))))
        plan = grouped.slots(wide, models, NAMES, ["ts"])._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("\n")

    many = grown.where("grp = 'p'").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(399)).cast("array<string>")))
    assert size(many, [str(i) for i in range(400)]) == size(many, [str(i) for i in range(4)])


def test_fleet_selects_rescues_and_stores(spark, rows, tmp_path):
    few = made(spark, {"s": (0, 2)}, 40)
    everything = rows.unionByName(few)
    plan = Plan(kind="hybrid", forest=ForestParams(trees=6, depth=3), boosted=BoostParams(rounds=2, depth=2), min_rows=100, pool_min_rows=100)
    path = str(tmp_path / "fleet")
    fleet = load_or_train(spark, path, lambda: train_fleet(everything, NAMES, plan), load_fleet, save_fleet, NAMES)
    found = {r["location_id"]: r for r in fleet.registry.collect()}
    assert set(found) == {"p", "q", "r", "s"} and found["s"]["pooled"] and not found["p"]["pooled"]
    assert all(r["accuracy"] > 0.8 for k, r in found.items() if k != "s") and all(r["selected"] for r in found.values())
    tested = fleet.test_predictions.groupBy("location_id").count().collect()
    assert {r["location_id"]: r["count"] for r in tested} == {"p": 48, "q": 48, "r": 48, "s": 8}
    predictions = fleet.predict(everything.drop("code", "c"))
    assert predictions.count() == everything.count() and predictions.filter("fog_prob < 0 or fog_prob > 1 or code is null").isEmpty()

    def broken(folder):
        fleet.registry.write.parquet(f"{folder}/registry")
        raise OSError

    with pytest.raises(OSError):
        store.commit(spark, path, broken, {"learner": "grouped", "features": NAMES})
    again = load_or_train(spark, path, None, load_fleet, save_fleet, NAMES)
    assert again.features == NAMES and {r["location_id"]: r["threshold"] for r in again.registry.collect()} == {k: r["threshold"] for k, r in found.items()}
    # A version that cannot be read is passed over, another feature list finds none.
    store.commit(spark, path, lambda folder: None, {"learner": "grouped", "features": NAMES})
    assert load_fleet(spark, path, NAMES) is not None and load_fleet(spark, path, NAMES[:2]) is None
    assert len(list(store.versions(spark, path, {"learner": "grouped"}))) == 2
