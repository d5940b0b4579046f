"""The whole run from CSV files, as a user starts it."""

from __future__ import annotations

import csv
import glob
import os
import random
from dataclasses import replace
from datetime import date, timedelta

import pytest

from stayrate.config import Layout, Settings
from stayrate.operators import profile
from stayrate.plans import features, run
from stayrate.session import durable, tables_removed
from stayrate.sinks.files import write_counted
from tests.helpers import by_key, plan_of

LAYOUT = Layout()
SETTINGS = replace(Settings(), trees=5, max_depth=3, min_category_count=30)
CUSTOMERS = 240


def write(path, rows):
    with open(path, "w", newline="") as f:
        writer = csv.DictWriter(f, rows[0].keys())
        writer.writeheader()
        writer.writerows(rows)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    pick = random.Random(5)
    data = tmp_path_factory.mktemp("data")
    clients, prices = [], []
    for i in range(CUSTOMERS):
        start = date(2010, 1, 1) + timedelta(days=pick.randrange(1000))
        clients.append(
            {
                "Unnamed: 0": i,
                "id": f"c{i}",
                "churn": int(i % 9 == 0),
                "channel_sales": "MISSING" if i % 3 else f"rare{i % 20}",
                "origin_up": pick.choice(["k", "l"]) if i % 10 else "",
                "has_gas": "t" if i % 4 == 0 else "f",
                "date_activ": start,
                "date_end": date(2016, 6, 1) + timedelta(days=i),
                "date_modif_prod": "not a date" if i % 50 == 0 else start + timedelta(days=90),
                "date_renewal": start + timedelta(days=700),
                "nb_prod_act": 1 + i % 3,
                "num_years_antig": 2016 - start.year,
                "net_margin": round(pick.uniform(0, 300), 2),
                "pow_max": 13.2,
                "margin_gross_pow_ele": round(pick.uniform(0, 50), 2),
                "margin_net_pow_ele": "NA" if i % 40 == 7 else round(pick.uniform(0, 50), 2),
                **{c: round(pick.uniform(0, 5000), 1) for c in LAYOUT.log_columns},
            }
        )
        for month in range(1, 13):
            if i != 5:
                values = {c: round(pick.uniform(0.05, 0.2), 6) for c in LAYOUT.price_columns}
                prices.append({"id": f"c{i}", "price_date": date(2015, month, 1), **values})
    write(data / "client_data.csv", clients)
    write(data / "clean_data_after_eda.csv", clients)
    write(data / "price_data.csv", prices)
    return data


@pytest.fixture(scope="module")
def finished(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    return out, run.run_all(spark, str(folder), str(out), LAYOUT, SETTINGS)


def test_report_and_tables_are_written(spark, finished):
    out, text = finished
    assert text.startswith("CHURN REPORT") and "Strongest features" in text
    assert "MISSING" in text
    assert (out / "churn_report").is_dir()
    for name in ("overview", "class_share", "price_by_label", "histograms", "group_means", "rate_by_has_gas"):
        assert spark.read.parquet(str(out / "eda" / name)).count() > 0, name
    for name in ("confusion", "roc_points", "pr_points", "threshold_sweep", "class_report", "cross_validation"):
        assert spark.read.parquet(str(out / "model" / name)).count() > 0, name


def test_feature_table(spark, finished):
    out, _ = finished
    table = spark.read.parquet(str(out / "data_for_predictions"))
    # The customer without prices is gone.
    assert table.count() == CUSTOMERS - 1
    summary = features.feature_summary(table, LAYOUT).first()
    assert summary["n_price_features"] == 14 and summary["n_month_features"] == 4
    assert summary["n_log_features"] == 9 and summary["n_dummies"] == 3
    gone = {*LAYOUT.date_columns, *LAYOUT.category_columns, *LAYOUT.redundant_columns, "Unnamed: 0"}
    assert not gone & set(table.columns)
    assert {"channel_sales_MISSING", "origin_up_k", "origin_up_l", "tenure"} <= set(table.columns)
    assert all(t in ("int", "bigint", "double") for c, t in table.dtypes if c != "id")
    rows = by_key(table, "id")
    assert rows["c0"]["months_modif_prod"] is None and rows["c0"]["has_gas"] == 1
    assert rows["c10"]["origin_up_k"] == rows["c10"]["origin_up_l"] == 0


def test_predictions_cover_the_test_part(spark, finished):
    out, _ = finished
    found = spark.read.option("header", True).csv(str(out / "out_of_sample_predictions"))
    assert {"id", "actual_churn", "predicted_churn", "churn_probability"} <= set(found.columns)
    assert 55 <= found.count() <= 62


def test_a_single_stage_can_be_repeated(spark, finished, folder):
    out, _ = finished
    before = spark.read.parquet(str(out / "data_for_predictions")).collect()
    again = run.run_features(spark, str(folder), str(out), LAYOUT, SETTINGS)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, before), key=repr)


def test_a_bad_price_date_stops_the_run(spark, tmp_path):
    (tmp_path / "price_data.csv").write_text(
        "id,price_date," + ",".join(LAYOUT.price_columns) + "\nc1,2015-13-01" + ",1" * 6 + "\n"
    )
    with pytest.raises(Exception):
        run.read_prices(spark, str(tmp_path), LAYOUT).collect()


def test_price_join_is_reduced_before_it_shuffles(spark, folder):
    clients = run.read_clients(spark, str(folder), "client_data", LAYOUT)
    found = profile.price_by_label(clients, run.read_prices(spark, str(folder), LAYOUT), "id", "churn", "price_")
    plan = plan_of(found)
    assert plan.index("Join") < plan.index("partial_sum(price_")


def test_every_stage_leaves_its_tables(spark, finished):
    out, _ = finished
    rows = {
        f"{stage}/{name}": spark.read.parquet(str(out / stage / name)).count()
        for stage, names in {
            "eda": ["column_gaps", "overview"],
            "features": ["feature_summary", "rate_by_tenure", "rate_by_has_gas", "histogram_log", "bins_log", "density_log"],
            "sensitivity": [
                "price_level", "price_month_on_month", "rise_before_churn", "churn_after_rise", "churn_by_volatility", "segment_rates",
            ],
        }.items()
        for name in names
    }
    assert all(rows.values())
    assert rows["features/rate_by_tenure"] <= 5


def stored(spark):
    return set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/table-*"))


def test_stored_tables_are_removed_when_the_block_ends(spark):
    kept = durable(spark.range(3))
    before = stored(spark)
    with pytest.raises(RuntimeError), tables_removed(spark):
        durable(spark.range(5))
        assert len(stored(spark)) == len(before) + 1
        raise RuntimeError
    assert stored(spark) == before and kept.count() == 3


def test_a_whole_run_leaves_no_stored_table(spark, folder, tmp_path):
    before = stored(spark)
    run.run_all(spark, str(folder), str(tmp_path / "out"), LAYOUT, SETTINGS)
    assert stored(spark) == before
    assert os.path.isdir(tmp_path / "out" / "features" / "column_gaps")


def test_a_table_is_counted_while_it_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None), (None, None, "y")], "a int, `b c` double, d string").repartition(3)
    written = write_counted(df, str(tmp_path / "t"))
    assert (written.rows, written.nulls) == (3, {"a": 1, "b c": 3, "d": 1})
    assert sorted(map(tuple, written.gaps().collect())) == [(3, "a", 1), (3, "b c", 3), (3, "d", 1)]
    assert written.table.count() == 3
    empty = write_counted(df.limit(0), str(tmp_path / "none"))
    assert (empty.rows, set(empty.nulls.values())) == (0, {0})
