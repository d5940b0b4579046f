"""Price features on the hand-made series, and the shape of their plan."""

from __future__ import annotations

import re
from datetime import date

import pytest

from stayrate.config import Layout
from stayrate.operators import price, profile
from tests.helpers import by_key, plan_of

LAYOUT = Layout()
SCHEMA = "id string, price_date date, " + ", ".join(f"{c} double" for c in LAYOUT.price_columns)
ROWS = [
    ("c1", date(2015, 1, 1), 0.10, 0.08, 0.06, 40.0, 20.0, 10.0),
    ("c1", date(2015, 1, 1), 0.12, 0.08, 0.06, 40.0, 20.0, 10.0),
    ("c1", date(2015, 2, 1), 0.13, 0.15, 0.06, 41.0, 20.0, 10.0),
    ("c1", date(2015, 3, 1), None, 0.09, 0.07, 42.0, None, 10.0),
    ("c2", date(2015, 1, 1), None, 0.05, 0.04, 30.0, 15.0, 8.0),
    ("c2", date(2015, 2, 1), 0.20, 0.05, 0.04, 30.0, 15.0, 8.0),
    ("c3", date(2015, 6, 1), 0.30, 0.20, 0.10, 50.0, 25.0, 12.0),
]
EXPECTED = {
    "offpeak_diff_dec_january_energy": (0.02, 0.0, 0.0),
    "offpeak_diff_dec_january_power": (2.0, 0.0, 0.0),
    "off_peak_peak_var_mean_diff": (0.0166667, 0.15, 0.10),
    "peak_mid_peak_fix_mean_diff": (10.0, 7.0, 13.0),
    "off_peak_peak_var_max_monthly_diff": (0.03, 0.15, 0.10),
    "peak_mid_peak_fix_max_monthly_diff": (10.0, 7.0, 13.0),
}


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


def test_columns_are_the_fourteen_features(series):
    names = price.price_features(series).columns
    assert len(names) == 15 and len(set(names)) == 15


@pytest.mark.parametrize("feature", EXPECTED)
def test_values(series, feature):
    rows = by_key(price.price_features(series), "id")
    for id, expected in zip(("c1", "c2", "c3"), EXPECTED[feature]):
        assert rows[id][feature] == pytest.approx(expected, abs=1e-6), id


def test_single_feature_operators_agree_with_the_combined_one(series):
    together = by_key(price.price_features(series), "id")
    for part in (price.price_change, price.price_mean_spread, price.price_max_spread):
        for id, row in by_key(part(series), "id").items():
            for name, value in row.asDict().items():
                assert together[id][name] == pytest.approx(value), name


def test_an_entity_without_any_known_price_has_null_features(spark):
    row = ("c9", date(2015, 1, 1), None, None, None, 1.0, 1.0, 1.0)
    found = price.price_features(spark.createDataFrame([row], SCHEMA)).first()
    assert found["offpeak_diff_dec_january_energy"] is None
    assert found["off_peak_peak_var_mean_diff"] is None
    assert found["off_peak_peak_fix_mean_diff"] == 0.0


def test_null_ids_do_not_form_an_entity(spark):
    rows = [(None, *ROWS[0][1:]), ROWS[0]]
    assert price.price_features(spark.createDataFrame(rows, SCHEMA)).count() == 1


def test_monthly_prices_merge_duplicate_months(series):
    rows = by_key(price.monthly_prices(series), "id", "price_date")
    assert len(rows) == 6
    assert rows[("c1", date(2015, 1, 1))]["price_off_peak_var"] == pytest.approx(0.11)


def test_month_on_month_skips_unknown_months(series):
    monthly = price.monthly_prices(series)
    rows = by_key(price.month_on_month(monthly, ["price_off_peak_var"]), "id", "price_date")
    assert rows[("c1", date(2015, 1, 1))]["price_off_peak_var_change"] is None
    assert rows[("c1", date(2015, 2, 1))]["price_off_peak_var_change"] == pytest.approx(0.02)
    assert rows[("c1", date(2015, 3, 1))]["price_off_peak_var_change"] is None
    assert rows[("c2", date(2015, 2, 1))]["price_off_peak_var_change"] is None


def test_level_and_volatility(series):
    row = by_key(price.price_level(series), "id")["c1"]
    assert row["price_off_peak_var_level"] == pytest.approx((0.10 + 0.12 + 0.13) / 3)
    assert row["price_off_peak_var_volatility"] == pytest.approx(0.02 / 2**0.5)
    assert by_key(price.price_level(series), "id")["c3"]["price_off_peak_var_volatility"] is None


def test_rise_before(spark, series):
    clients = spark.createDataFrame([("c1", 1), ("c2", 0), ("c3", 0)], "id string, churn int")
    rows = by_key(price.rise_before(clients, series, ["price_off_peak_var"], 2), "churn")
    assert rows[1]["share_recent_rise"] == 1.0 and rows[0]["share_recent_rise"] == 0.0
    # One month back from March leaves only March, where the price is unknown.
    rows = by_key(price.rise_before(clients, series, ["price_off_peak_var"], 1), "churn")
    assert rows[1]["share_recent_rise"] == 0.0 and rows[1]["mean_rises"] == 1.0


def test_elasticity(spark):
    rows = [
        ("a", date(2015, 1, 1), 10.0, 100.0),
        ("a", date(2015, 2, 1), 11.0, 80.0),
        ("a", date(2015, 3, 1), 11.0, 70.0),
        ("b", date(2015, 1, 1), 10.0, 100.0),
        ("b", date(2015, 2, 1), 12.0, 90.0),
    ]
    monthly = spark.createDataFrame(rows, "id string, price_date date, p double, q double")
    found = price.elasticity(monthly, "p", "q")
    assert sorted(r["elasticity"] for r in found.collect()) == pytest.approx([-2.0, -0.5])
    clients = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, seg string")
    row = price.elasticity_by_segment(clients, found, "seg").first()
    assert row["median_elasticity"] == pytest.approx(-1.25)
    assert (row["n"], row["share_elastic"]) == (2, 0.5)


def test_price_by_label_weights_rows_not_entities(spark):
    clients = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", None)], "id string, churn int")
    rows = [("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 5.0), ("c", 3.0), ("d", 9.0), ("e", 9.0)]
    series = spark.createDataFrame(rows, "id string, price_x double")
    row = profile.price_by_label(clients, series, "id", "churn", "price_").first()
    assert (row["retained"], row["churned"], row["diff_pct"]) == (2.0, 3.0, 50.0)


def test_plan_combines_before_each_of_its_two_shuffles(series):
    plan = plan_of(price.price_features(series))
    assert len(re.findall(r"Exchange hashpartitioning\(id", plan)) == 2
    assert "Exchange hashpartitioning(id#" in plan
    # Map-side partial aggregation below both exchanges, no join, no window.
    assert plan.count("partial_sum") > 0 and plan.count("partial_max") > 0
    assert "Join" not in plan and "Window" not in plan and "Python" not in plan


def test_label_rate_by_number_of_rises(spark, series):
    clients = spark.createDataFrame([("c1", 1), ("c2", 0), ("c3", 0)], "id string, churn int")
    rows = price.rate_after_rises(clients, series, ["price_off_peak_var", "price_peak_var"], 2).collect()
    for name in ("price_off_peak_var", "price_peak_var"):
        own = [r for r in rows if r["variable"] == name]
        assert sum(r["n"] for r in own) == sum(r["n"] for r in rows) / 2
    assert {r["rises"]: r["label_rate"] for r in rows if r["variable"] == "price_off_peak_var"}[1] == 1.0
