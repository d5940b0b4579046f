"""CSV scan, missing tokens, dates and sinks."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayrate.config import Layout
from stayrate.operators.model import feature_names
from stayrate.sinks.files import prediction_table, write_features, write_predictions, write_report
from stayrate.sources import files


def write(path, text):
    path.write_text(text)
    return str(path)


def test_missing_tokens_become_null(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,x\na,1.5\nb,\nc,NA\nd,NaN\ne,null\n")
    df = files.read_csv(spark, path, StructType().add("x", "double"))
    assert dict(df.dtypes) == {"id": "string", "x": "double"}
    assert {r["id"]: r["x"] for r in df.collect()} == {"a": 1.5, "b": None, "c": None, "d": None, "e": None}


def test_malformed_number_is_an_error(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,x\na,oops\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_csv(spark, path, StructType().add("x", "double")).collect()


def test_columns_match_by_name_in_any_order(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Unnamed: 0,churn,id,note\n0,1,c1,hello\n")
    df = files.drop_artefact(files.read_csv(spark, path, files.client_schema()))
    assert df.columns == ["churn", "id", "note"]
    assert df.first().asDict() == {"churn": 1, "id": "c1", "note": "hello"}


def test_a_category_called_missing_is_a_value(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,channel_sales\na,MISSING\n")
    assert files.read_csv(spark, path, files.client_schema()).first()["channel_sales"] == "MISSING"


def test_quotes_and_commas_in_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,note\n"a,1","say ""hi"""\n')
    assert tuple(files.read_csv(spark, path).first()) == ("a,1", 'say "hi"')
    out = str(tmp_path / "out")
    write_features(files.read_csv(spark, path), out, "csv")
    assert tuple(files.read_csv(spark, out).first()) == ("a,1", 'say "hi"')


def test_nan_is_null_after_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1.0,), (float("nan"),)], "x double").write.parquet(path)
    row = files.read_parquet(spark, path).agg(F.max("x"), F.avg("x"), F.count("x")).first()
    assert tuple(row) == (1.0, 1.0, 1)


def test_dates_lenient_and_strict(spark):
    df = spark.createDataFrame([("2015-02-28",), ("2015-02-30",), ("x",), (None,)], "d string").coalesce(1)
    lenient = files.parse_dates(df, ["d", "absent"])
    assert [r[0] for r in lenient.collect()] == [date(2015, 2, 28), None, None, None]
    with pytest.raises(Exception):
        files.parse_dates(df, ["d"], strict=True).collect()


def test_null_id_is_an_error(spark):
    df = spark.createDataFrame([("a",), (None,)], "id string")
    with pytest.raises(Exception, match="null id"):
        files.require_ids(df).collect()
    assert files.require_ids(df.where("id = 'a'")).count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feature_table_reads_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1, 0.25), ("b", 0, None)], "id string, churn int, x double")
    back = write_features(df, str(tmp_path / fmt), fmt)
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    again = write_features(df.limit(1), str(tmp_path / fmt), fmt)
    assert again.count() == 1


def test_prediction_table_rounds_half_even(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 1, 2.0, 0, 0.12345), ("b", 0, 3.0, 1, 0.9)],
        "id string, churn int, x double, prediction int, score double",
    )
    table = prediction_table(df, "churn", ["x"], Layout().id)
    assert table.columns == ["id", "x", "actual_churn", "predicted_churn", "churn_probability"]
    assert sorted(r["churn_probability"] for r in table.collect()) == [0.1234, 0.9]
    write_predictions(table, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_report_is_one_text_file(spark, tmp_path):
    write_report(spark, "line 1\nline 2\n", str(tmp_path / "r"))
    parts = [p for p in (tmp_path / "r").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1 and parts[0].read_text().startswith("line 1\nline 2")


def test_files_with_another_header_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y\nA,1,2\n")
    (tmp_path / "b.csv").write_text("id,y,x\nB,20,10\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path)).collect()


def test_whole_numbers_are_whole_in_every_integral_type(spark, tmp_path):
    for kind in ("integer", "long"):
        path = tmp_path / f"{kind}.csv"
        path.write_text("x\n1.0\n2\nNA\n")
        assert [r.x for r in files.read_csv(spark, str(path), StructType().add("x", kind)).collect()] == [1, 2, None]
        path.write_text("x\n1.7\n")
        with pytest.raises(Exception, match="not whole"):
            files.read_csv(spark, str(path), StructType().add("x", kind)).collect()


def test_undeclared_numbers_are_typed_and_reach_the_model(spark, tmp_path):
    text = "id,churn,amount,note,empty,mixed\na,1,7.25,x,,1\nb,0,NA,2,,1e3\nc,0,-3,y,,z\n"
    df = files.read_csv(spark, write(tmp_path / "a.csv", text), files.client_schema())
    assert dict(df.dtypes)["amount"] == "double" and dict(df.dtypes)["note"] == "string"
    assert dict(df.dtypes)["empty"] == "string" and dict(df.dtypes)["mixed"] == "string"
    assert feature_names(df, ["id", "churn"]) == ["amount"]
    assert [r["amount"] for r in df.collect()] == [7.25, None, -3.0]


def test_unlike_headers_are_read_by_name_and_broken_records_set_aside(spark, tmp_path):
    folder = tmp_path / "a b%20 {c}"
    folder.mkdir()
    write(folder / "1.csv", 'id,x,note\na,1,"p, ""q"""\nb,oops,n\nc,3\nd,4,n,more\n')
    write(folder / "2.csv", '"note","x","id"\nn,2.0,e\nn,2.5,f\nn,NA,g\n')
    write(folder / "3.csv", "id,_line\nh,7\n")
    write(folder / "4.csv", "")
    found = files.scan_csv(spark, str(folder).replace("{", "\\{").replace("}", "\\}"), StructType().add("id", "string").add("x", "integer"))
    assert dict(found.table.dtypes) == {"id": "string", "x": "int", "note": "string", "_line": "double"}
    assert sorted(map(tuple, found.table.collect())) == [
        ("a", 1, 'p, "q"', None), ("e", 2, "n", None), ("g", None, "n", None), ("h", None, None, 7.0),
    ]
    rejects = {r["record"]: (r["file"][-5:], r["reason"]) for r in found.rejects.collect()}
    assert rejects["c,3"] == ("1.csv", "number of cells") and rejects["d,4,n,more"] == ("1.csv", "number of cells")
    assert sorted(v for v in rejects.values() if v[1] != "number of cells") == [("1.csv", "x: oops"), ("2.csv", "x: 2.5")]
    assert len(rejects) == 4


def test_a_scan_without_rows_and_a_column_named_twice(spark, tmp_path):
    found = files.scan_csv(spark, write(tmp_path / "a.csv", "id,x\n"), StructType().add("x", "integer"))
    assert (found.table.count(), found.rejects.count(), found.table.columns) == (0, 0, ["id", "x"])
    empty = files.scan_csv(spark, write(tmp_path / "b.csv", ""), StructType().add("x", "integer"))
    assert (empty.table.columns, empty.table.count(), empty.rejects.count()) == (["x"], 0, 0)
    with pytest.raises(ValueError, match="names a column twice"):
        files.scan_csv(spark, write(tmp_path / "c.csv", "id,ID\na,b\n"))
