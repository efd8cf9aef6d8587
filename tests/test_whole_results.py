import datetime as dt
import json

from pyspark.sql import functions as F

from mastwire.operators import models as D
from mastwire.sources import readers


def days(n, series):
    return [(series, dt.date(2024, 1, 1) + dt.timedelta(i), float(10 + i % 7)) for i in range(n)]


def test_short_series_keep_a_forecast_and_a_champion(spark):
    panel = spark.createDataFrame(days(5, "short") + days(80, "long"), "series string, date date, value double")
    out = D.forecast_series(panel, ["series"], "date", "value", F.lit(False), 7).toPandas()
    assert out.groupby("series").size().to_dict() == {"short": 7, "long": 7}
    short = out[out.series == "short"]
    assert set(short.method) == {"last_value"} and set(short.value) == {14.0}
    assert set(out[out.series == "long"].method) == {"ridge"}
    best = {r.series: r for r in D.select_champions(panel, ["series"], "date", "value", F.lit(False)).collect()}
    assert best["short"].champion == "last_value" and best["short"].test_mase is None and best["long"].test_mase is not None


def test_rows_with_gaps_stay(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "y double, x double")
    out, features = D.with_gaps_marked(rows, ["x"])
    assert features == ["x", "x_missing"] and sorted((r.x, r.x_missing) for r in out.collect()) == [(0.0, 1.0), (3.0, 0.0)]


def test_every_polygon_and_hole_is_read(spark, tmp_path):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    lines = [
        {"id": "one", "geometry": {"type": "Polygon", "coordinates": [square(0, 4), square(1, 2)]}},
        {"id": "two", "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 2)], [square(6, 8), square(6.5, 7)]]}},
        {"id": "point", "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, lines)))
    got = {(r.id, r.part): r for r in readers.read_footprints(spark, str(tmp_path / "b.json")).collect()}
    assert set(got) == {("one", 0), ("two", 0), ("two", 1)}
    assert len(got["one", 0].holes) == 1 and len(got["two", 1].holes) == 1 and got["two", 0].holes == []
    assert (got["two", 1].lon, got["two", 1].lat) == (7.0, 7.0)


def test_files_of_one_name_are_told_apart(spark, tmp_path):
    for folder, text in (("a", "x"), ("b", "y")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.csv").write_text(text)
    import hashlib

    lock = spark.createDataFrame(
        [("a/f.csv", hashlib.sha256(b"x").hexdigest(), "g", True), ("b/f.csv", hashlib.sha256(b"x").hexdigest(), "g", True)],
        "file string, sha256 string, group string, required boolean")
    assert {r.file: r.state for r in readers.source_checks(spark, str(tmp_path), lock).collect()} == {"a/f.csv": "ok", "b/f.csv": "changed"}


def test_trees_on_residuals_win_where_the_line_cannot_follow(spark):
    shape = lambda i: 40.0 if i % 7 in (5, 6) and i % 28 < 14 else 10.0 + (i * 37 % 11) / 10
    rows = [("steps", dt.date(2024, 1, 1) + dt.timedelta(i), shape(i)) for i in range(400)] + days(400, "plain")
    panel = spark.createDataFrame(rows, "series string, date date, value double")
    best = {r.series: r for r in D.select_champions(panel, ["series"], "date", "value", F.lit(False)).collect()}
    for r in best.values():
        assert None not in (r.ridge_validation_mase, r.hybrid_validation_mase, r.weekday_medians_validation_mase)
        if r.champion != "weekday_medians":
            assert r.validation_mase == min(r.ridge_validation_mase, r.hybrid_validation_mase) <= 1
    assert best["steps"].hybrid_validation_mase < best["steps"].ridge_validation_mase


def test_every_feature_has_its_importance(spark):
    names = [f"f{i}" for i in range(13)]
    got = [tuple(r) for r in D.importances([2.0] + [0.5] * 12, names, spark).collect()]
    assert got == [("f0", 0.25), *((n, 0.0625) for n in sorted(names[1:]))]
