import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mastwire.sources import readers as R
from mastwire.sources import sinks as W


def test_ids_survive_as_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,aon,arpu_6,extra,date_of_last_rech_6\n0001,200,-1.5,z,6/8/2014\nNA,,bad,z,\n")
    rows = R.read_subscribers(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("0001", 200.0, -1.5, "6/8/2014"), ("NA", None, None, None)]


def test_kpi_headers_and_numbers(spark, tmp_path):
    (tmp_path / "k.csv").write_text('Date,"Handover Success Rate",Avg RRC Connected users\n1/2/25,99.5,"1,234.5"\n2025-01-03,x,7\n')
    rows = R.read_kpis(spark, str(tmp_path)).orderBy("date").collect()
    assert [(str(r["date"]), r["handover_sr"], r["connected_users"]) for r in rows] == [
        ("2025-01-02", 99.5, 1234.5), ("2025-01-03", None, 7.0),
    ]
    assert R.map_headers(["Handover Success Rate", "Handover Success Rate ( 4G Intra System)"]) == {
        "Handover Success Rate": "handover_sr", "Handover Success Rate ( 4G Intra System)": "handover_intra_sr",
    }


def test_cells_with_and_without_header(spark, tmp_path):
    line = "lte,606,1,2,3,0,13.1,32.8,1000,5,1,1600000000,1600000100,0\n"
    (tmp_path / "a.csv").write_text(",".join(R.CELL_COLUMNS) + "\n" + line)
    (tmp_path / "b.csv").write_text(line.replace("606", "?"))
    rows = R.read_cells(spark, str(tmp_path)).orderBy(F.col("mcc").asc_nulls_first()).collect()
    assert [(r["radio"], r["mcc"], r["lon"]) for r in rows] == [("LTE", None, 13.1), ("LTE", 606.0, 13.1)]


def test_radio_records_and_footprints(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "r.json").write_text(json.dumps({"rat": "LTE", "channels": [0, 5], "bandNumbers": [20], "attributes": {"x_LOC_TA": "1"}}) + "\n")
    row = R.read_radio_records(spark, str(tmp_path / "r")).first()
    assert (row["channels"], row["bands"], row["has_timing_advance"]) == ([5], [20], True)
    (tmp_path / "f").mkdir()
    ring = [[13.0, 32.0], [13.001, 32.0], [13.001, 32.001], [13.0, 32.001]]
    (tmp_path / "f" / "f.json").write_text(json.dumps({"id": "b", "geometry": {"type": "Polygon", "coordinates": [ring]}}) + "\n")
    from mastwire.operators.geo import polygon_area_m2

    area = R.read_footprints(spark, str(tmp_path / "f")).select(polygon_area_m2(F.col("ring")).alias("a")).first()["a"]
    assert abs(area - 111.195 * 94.3) / area < 0.01


def test_changed_required_inputs_are_refused(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lock = spark.createDataFrame(
        [("a", sha("a"), "g", True), ("b", sha("x"), "h", False), ("d", sha("d"), "i", False)],
        "file string, sha256 string, group string, required boolean",
    )
    checks = R.source_checks(spark, str(tmp_path), lock)
    assert {r["file"]: r["state"] for r in checks.collect()} == {"a": "ok", "b": "changed", "c": "undeclared", "d": "missing"}
    assert R.require_sources(checks) == ["h", "i"]
    with pytest.raises(ValueError, match="b: changed"):
        R.require_sources(checks.withColumn("required", F.lit(True)))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 13.0, 32.0, "train"), (2, 14.0, 33.0, "test")], "id int, lon double, lat double, split string")
    feature = json.loads(W.feature_lines(df).first()["value"])
    assert feature["geometry"]["coordinates"] == [13.0, 32.0] and feature["properties"]["id"] == 1
    W.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'test'").first()["id"] == 2
