"""Training, rescue, store and publishing on a made-up valley where two evenings of three are saturated and foggy."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fogbank.models.components import BOOST_SPACE, BoostParams, Boosted, Forest, ForestParams, draws
from fogbank.models.training import FogModel, Plan, load_or_train, resolve_kind, search, train_locations
from fogbank.plans.prediction import publish, training_rows

START = dt.datetime(2025, 9, 3)
QUICK = Plan(kind="hybrid", learner="ml", forest=ForestParams(trees=15, depth=6), boosted=BoostParams(rounds=3, depth=3), threads=2)


def weather(spark, days, seed=11):
    u = random.Random(seed).random
    rows = []
    for hour in range(days * 24):
        day, clock = divmod(hour, 24)
        saturated = day % 3 and clock >= 20
        rh = 97 + 2 * u() if saturated else 50 + 30 * u()
        temp = 10 + min(clock, 24 - clock) / 2 + u()
        rows.append(("v", START + dt.timedelta(hours=hour), temp, 0.0, .3 + u(), temp - (100 - rh) / 5, rh))
    return spark.createDataFrame(rows, "file string, ts timestamp, temp double, rain double, wind double, dew double, rh double")


def recorded(obs, hours_of_k):
    """Location J is recorded throughout, K only for its first hours."""
    code = F.when(F.col("rh") > 96, 4).otherwise(0)
    known = F.col("ts") < F.lit(START + dt.timedelta(hours=hours_of_k))
    places = F.explode(F.array(F.struct(F.lit("v!J").alias("location_id"), code.alias("code")),
                               F.struct(F.lit("v!K").alias("location_id"), F.when(known, code).alias("code"))))
    return obs.select("file", "ts", places.alias("p")).select("file", "ts", "p.*")


@pytest.fixture(scope="module")
def station(spark):
    obs = weather(spark, 40).cache()
    labels = recorded(obs, 60).cache()
    places = spark.createDataFrame([("v", "v!J", 1, "北谷"), ("v", "v!K", 2, "南谷")],
                                   "file string, location_id string, ordinal int, name string")
    forecast = weather(spark, 3, seed=12).withColumn("ts", F.col("ts") + F.expr("INTERVAL 45 DAY")).drop("file")
    return obs, labels, places, forecast


@pytest.fixture(scope="module")
def published(station, tmp_path_factory):
    obs, labels, places, forecast = station
    path = str(tmp_path_factory.mktemp("models") / "store")
    return path, publish(obs, labels, places, forecast, plan=QUICK, model_path=path)


def test_kinds():
    assert resolve_kind(None) == "hybrid" and resolve_kind("RF") == "rf"
    with pytest.raises(ValueError):
        resolve_kind("lightgbm")
    with pytest.raises(ValueError):
        FogModel(["a"], None, None)


def test_draws_are_different_and_repeatable():
    assert draws(BOOST_SPACE, BoostParams, 8) == draws(BOOST_SPACE, BoostParams, 8)
    assert len(set(draws(BOOST_SPACE, BoostParams, 8))) == 8


def test_codes_with_gaps(spark):
    u = random.Random(5).random
    codes = (1, 4, 9)
    df = spark.createDataFrame([(3.0 * codes.index(c) + u(), u(), c) for c in codes for _ in range(50)], "a double, b double, code int")
    boosted = Boosted.fit(df, ["a", "b"], BoostParams(rounds=5, depth=3), codes)
    forest = Forest.fit(df, ["a", "b"], ForestParams(trees=5, depth=3))
    out = FogModel(["a", "b"], forest, boosted, .5).predict(df, ["code"])
    r = out.agg(F.avg((F.col("code") == F.col("boosted_pred")).cast("double")).alias("b"),
                F.avg((F.col("code") == F.col("forest_pred")).cast("double")).alias("f"),
                F.array_sort(F.collect_set("boosted_pred")).alias("c")).first()
    assert r.b > .9 and r.f > .9 and r.c == [1, 4, 9]


def test_a_measure_that_one_sheet_lacks_costs_no_row(spark):
    one = weather(spark, 12).withColumn("pressure", F.col("temp") + 980)
    other = weather(spark, 12, seed=3).withColumns({"file": F.lit("w"), "pressure": F.lit(None).cast("double")})
    obs = one.unionByName(other)
    labels = obs.select("file", "ts", F.concat("file", F.lit("!J")).alias("location_id"), F.when(F.col("rh") > 96, 4).otherwise(0).alias("code"))
    rows, names = training_rows(obs, labels)
    assert {"pressure", "has_pressure"} <= set(names)
    found = {r.location_id: (r.n, r.p) for r in rows.groupBy("location_id").agg(
        F.count("*").alias("n"), F.sum("has_pressure").alias("p")).collect()}
    assert found == {"v!J": (288, 288.0), "w!J": (288, 0.0)}


def test_registry(published):
    r = {x.location_id: x for x in published[1]["registry"].collect()}
    assert set(r) == {"v!J", "v!K"}
    assert r["v!J"].accuracy > .8 and r["v!J"].fog_f1 > .5 and not r["v!J"].pooled and r["v!J"].model_type == "hybrid"
    assert r["v!J"].fog_f1 >= min(r["v!J"].forest_fog_f1, r["v!J"].boosted_fog_f1) - .05
    assert r["v!K"].pooled and r["v!K"].model_type == "pooled(hybrid)" and r["v!K"].n == 60
    reasons = {x.location_id: x.reason for x in published[1]["eligible"].collect()}
    assert reasons["v!J"] is None and reasons["v!K"] == "too-few-rows"


def test_published_tables(published):
    tables = published[1]
    predictions = tables["predictions"].collect()
    assert len(predictions) == 144 and all(0 <= p.code <= 10 and 0 <= p.fog_prob <= 1 for p in predictions)
    long = tables["long"]
    assert long.columns == ["日時", "地点", "予測コード", "現象名", "霧確率(%)", "判定"]
    assert {r["地点"] for r in long.select("地点").distinct().collect()} == {"北谷", "南谷"}
    assert tables["wide"].columns == ["日時", "北谷_予測コード", "北谷_霧確率(%)", "南谷_予測コード", "南谷_霧確率(%)"]
    assert tables["wide"].count() == 72 and tables["top_features"].count() == 6
    assert [r.location_id for r in tables["skipped"].collect()] == ["v!K"]
    assert tables["load_report"].count() == 5 and tables["monthly_wind_rain"].filter("code is not null").count() > 0
    assert tables["daily"].count() == 3 and tables["grid"].count() == 6
    assert all(g.warn for g in tables["gaps"].filter("location_id = 'v!K'").collect())
    assert {r.segment for r in tables["panel"].filter("location_id = 'v!K' and kind = 'forecast'").collect()} == {1}


def test_store_is_read_back_without_training(spark, station, published):
    def never():
        raise AssertionError("trained again")

    again = load_or_train(spark, published[0], never)
    assert set(again.models) == {"v!J", "v!K"} and again.models["v!J"].kind == "hybrid"
    assert again.models["v!J"].threshold == published[1]["registry"].filter("location_id = 'v!J'").first().threshold


def test_search_and_single_kinds(station):
    obs, labels, _, _ = station
    rows, names = training_rows(obs, labels)
    assert "temp_change_1h" in names and "hours_to_sunrise" in names
    small = rows.filter(F.col("location_id") == "v!J").select("ts", "code", "dew_gap", "rh")
    from fogbank.models import training
    spaces = training.FOREST_SPACE
    training.FOREST_SPACE = {"trees": (3,), "depth": (3,), "min_leaf": (1, 2), "features": ("sqrt",)}
    try:
        best = search(small, ["dew_gap", "rh"], "forest", 2)
    finally:
        training.FOREST_SPACE = spaces
    assert best.trees == 3
    trained = train_locations(rows.filter(F.col("location_id") == "v!J"), names, Plan(kind="rf", forest=ForestParams(5, 4)))
    assert trained.models["v!J"].weight == 1.0 and trained.registry.first().boosted_fog_f1 is None


def test_search_never_sees_rows_that_are_scored_later(station, monkeypatch):
    from fogbank.models import training
    obs, labels, _, _ = station
    rows, names = training_rows(obs, labels)
    rows = rows.filter(F.col("location_id") == "v!J")
    seen = []

    def watched(df, features, part, n, ties=()):
        seen.append(df.agg(F.max("ts"), F.count("*")).first())

    monkeypatch.setattr(training, "search", watched)
    trained = train_locations(rows, names, Plan(kind="rf", forest=ForestParams(5, 4), forest_draws=2))
    n = rows.count()
    n_fit = int(int(n * .8) * .8)
    assert len(seen) == 1 and seen[0][1] == n_fit
    assert trained.registry.first().tuned and trained.registry.first().selected
    assert seen[0][0] < trained.test_predictions.agg(F.min("ts")).first()[0]
