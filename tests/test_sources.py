import json

from pyspark.sql import functions as F

from souqframe.sources import readers, writers


def test_settings_merge(tmp_path, monkeypatch):
    base = {"a": {"x": 1, "y": 2}, "b": 3}
    assert readers.merged(base, {"a": {"y": 5}, "c": 1}) == {"a": {"x": 1, "y": 5}, "b": 3, "c": 1}
    assert base == {"a": {"x": 1, "y": 2}, "b": 3}
    f = tmp_path / "s.json"
    f.write_text(json.dumps({"b": 9}))
    monkeypatch.setenv("SOUQFRAME_SETTINGS", str(f))
    assert readers.load_settings(base)["b"] == 9


def test_versions(spark, tmp_path):
    assert writers.latest_version(str(tmp_path / "none")) is None
    for v in ("v1", "v2"):
        (tmp_path / v).mkdir()
    assert writers.latest_version(str(tmp_path)) == "v2"
    (tmp_path / "latest").write_text("v1")
    assert writers.latest_version(str(tmp_path)) == "v1"


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from souqframe.ml import models

    rows = [(i, 20_000.0 + 1000 * (i % 50), float(i % 50), "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, price double, mark double, brand string")
    m = models.fit_regressor(df, "ridge", ["mark"], ["brand"])
    v = writers.save_model(m, {"rows": 200}, str(tmp_path))
    back = PipelineModel.load(f"{tmp_path}/{writers.latest_version(str(tmp_path))}/model")
    assert v == writers.latest_version(str(tmp_path))
    a, b = (models.predict(x, df).agg(F.sum("predicted")).first()[0] for x in (m, back))
    assert abs(a - b) < 1e-6


def test_map_extension(spark):
    known = spark.createDataFrame([("b", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 9), ("a", 2)], "k string, v int")
    assert [tuple(r) for r in writers.extend_map(known, new, "k").collect()] == [("a", 2), ("b", 1)]
    assert json.loads(writers.json_document({"x": known})) == {"x": [{"k": "b", "v": 1}]}


def test_json_rows(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert [tuple(r) for r in readers.read_json_rows(spark, ['{"a": 1}', '{"b": "x", "z": 0}', "not json"], schema).collect()] == [(1, None), (None, "x"), (None, None)]
