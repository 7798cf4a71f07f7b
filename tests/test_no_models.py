"""Queries that fit models, on tables in which no hour is left to learn from."""

import datetime as dt

import pytest

from fogbank.gate.catalog import QUERIES
from fogbank.models.components import Boosted, BoostParams, Forest, ForestParams
from fogbank.models.training import FogModel


@pytest.fixture(scope="module")
def foggy(spark, tmp_path_factory):
    """Three days of two event types with a wide spread in every hour: one code throughout, so every location is one suspicious block."""
    d = str(tmp_path_factory.mktemp("foggy"))
    at = dt.datetime(2024, 1, 1)
    rows = [(4 * h + 2 * t + i, at + dt.timedelta(hours=h, minutes=i), t, ["view", "error"][t], 100.0 * i, '{"k": 50}')
            for h in range(72) for t in range(2) for i in range(2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


COLUMNS = {
    "m3_forest": "location_id code n known", "m4_boosted_trees": "location_id code n known",
    "m6_fit_and_select": "location_id n weight_ok threshold_ok",
    "m7_location_models": "location_id model_type n pooled threshold_ok accurate",
    "m8_pooled_rescue": "location_id model_type pooled n", "m9_forecast_predictions": "location_id ts code_ok prob_ok",
    "s9_model_store": "location_id model_type n same", "s9_versioned_store": "location_id model_type n same broke retrained"}


@pytest.mark.parametrize("name", COLUMNS)
def test_no_hour_to_learn_from(spark, foggy, name):
    found = QUERIES[name](spark, foggy)
    assert found.columns == COLUMNS[name].split() and found.collect() == []


def test_learners_without_rows_know_nothing(spark):
    none = spark.createDataFrame([], "code int, a double, b double")
    model = FogModel(["a", "b"], Forest.fit(none, ["a", "b"], ForestParams(trees=2, depth=2)), Boosted.fit(none, ["a", "b"], BoostParams(rounds=2), [0, 7]))
    row = model.predict(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), []).first()
    assert (row.pred, row.fog_prob, row.forest_pred, row.boosted_pred) == (None,) * 4


def test_boosting_without_rows_of_the_last_class(spark):
    rows = spark.createDataFrame([(i % 2 * 2, float(i % 2), float(i)) for i in range(40)], "code int, a double, b double")
    boosted = Boosted.fit(rows, ["a", "b"], BoostParams(rounds=2, depth=2), [0, 2, 7])
    assert boosted.classes == [0, 2]
    out = FogModel(["a", "b"], None, boosted).predict(rows, ["code"]).collect()
    assert all(r.pred == r.code for r in out)
