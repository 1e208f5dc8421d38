import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files


def test_a_set_must_be_what_its_file_says(spark, tmp_path):
    (tmp_path / "bank.json").write_text('{"name": "bank", "version": "1", "items": [{"id": "x"}, {"id": "y"}]}')
    (tmp_path / "other.json").write_text('{"name": "bank", "version": "1", "items": [{"id": "x"}]}')
    assert files.load_checked_set(spark, str(tmp_path / "bank.json"), "id:string", "id").count() == 2
    with pytest.raises(ValueError, match="does not say"):
        files.load_checked_set(spark, str(tmp_path / "other.json"), "id:string", "id")
    items = files.load_set(spark, str(tmp_path / "bank.json"), "id:string").drop("name", "version")
    files.write_manifest(items, "id", "1", str(tmp_path / "m"))
    manifest = spark.read.json(str(tmp_path / "m"))
    assert files.load_checked_set(spark, str(tmp_path / "bank.json"), "id:string", "id", manifest).count() == 2
    with pytest.raises(ValueError, match="manifest"):
        files.load_checked_set(spark, str(tmp_path / "bank.json"), "id:string", "id", manifest.withColumn("version", F.lit("2")))


def test_a_pool_is_built_once_and_checked(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")

    path = str(tmp_path / "pool")
    assert files.load_or_build(spark, path, "id", build).count() == files.load_or_build(spark, path, "id", build).count() == 2
    assert calls == [1]
    spark.createDataFrame([("a", 9)], "id string, n int").write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="hash"):
        files.load_or_build(spark, path, "id", build)


def test_logs_artifacts_and_hashes(spark, tmp_path):
    files.append_progress(spark.createDataFrame([("f1",)], "set_fingerprint string"), str(tmp_path / "log"))
    files.append_progress(spark.createDataFrame([("c", 1), ("c", 2)], "cell string, at int"), str(tmp_path / "log"))
    assert [tuple(r) for r in files.resume_checked(spark, str(tmp_path / "log"), "cell string, at int", "cell", "at", "f1").collect()] == [("c", 2)]
    with pytest.raises(ValueError, match="another set"):
        files.resume_checked(spark, str(tmp_path / "log"), "cell string, at int", "cell", "at", "f2")
    for name in ("20240101", "20240301", "20240201"):
        (tmp_path / "runs" / name).mkdir(parents=True)
    (tmp_path / "runs" / "20240201" / "r.csv").write_text("x")
    assert files.latest_artifact(spark, str(tmp_path / "runs"), "r.csv").endswith("20240201")
    assert files.latest_artifact(spark, str(tmp_path / "none"), "r.csv") is None
    (tmp_path / "a.txt").write_text("one")
    hashes = files.file_hashes(spark, str(tmp_path / "*.txt")).select(F.lit("a.txt").alias("name"), "sha256").collect()
    manifest = spark.createDataFrame(hashes)
    assert files.changed_files(spark, str(tmp_path / "*.txt"), manifest).count() == 0
    (tmp_path / "a.txt").write_text("two")
    assert files.changed_files(spark, str(tmp_path / "*.txt"), manifest).count() == 1


def test_vectors_of_another_model_are_refused_and_publishing_is_all_or_nothing(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.0], "m1")], "id int, vector array<double>, embedding_model string")
    v.write.parquet(str(tmp_path / "v"))
    assert files.open_vectors(spark, str(tmp_path / "v"), "m1").count() == 1
    with pytest.raises(ValueError, match="not m2"):
        files.open_vectors(spark, str(tmp_path / "v"), "m2")
    folder = tmp_path / "out"
    files.publish({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")}, str(folder))
    assert spark.read.parquet(str(folder / "a")).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        files.publish({"a": spark.range(9).toDF("x"), "b": spark.range(2).select(F.expr("assert_true(id < 0)"))}, str(folder))
    assert spark.read.parquet(str(folder / "a")).count() == 3
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["a", "b"]
    files.write_json(spark.createDataFrame([(None, 1)], "a string, b int"), str(tmp_path / "j"))
    assert '"a":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
