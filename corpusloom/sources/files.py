"""Question sets, pools, result files and manifests: JSON, JSON lines, CSV, Markdown, SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_json(*columns: Column | str) -> Column:
    """One compact JSON text of the columns by name, nulls kept: the base of fingerprints."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def set_fingerprint(items: DataFrame, key: str) -> DataFrame:
    """sha256, items: a hash of all rows, each as JSON with columns in the order of their names, in the order of `key`.

    A hash tree: rows fall into 4,096 leaves by the hash of their key, a leaf hashes
    its rows in order, the root the leaves, so no task holds all rows.
    """
    row = F.sha2(canonical_json(*sorted(items.columns)), 256)
    hashed = items.select(F.col(key).cast("string").alias("k"), row.alias("h")).withColumn("leaf", F.substring(F.sha2(F.coalesce("k", F.lit("")), 256), 1, 3))
    joined = lambda names: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*names))), lambda x: x["h"]), ""), 256)
    leaves = hashed.groupBy("leaf").agg(joined(["k", "h"]).alias("h"), F.count("*").alias("n"))
    return leaves.agg(joined(["leaf", "h"]).alias("sha256"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("items"))


def load_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of a question set file: {name, version, items: [...]}, one row an item."""
    return spark.read.schema(f"name string, version string, items array<struct<{schema}>>").json(path, multiLine=True).select("name", "version", F.inline("items"))


def write_manifest(items: DataFrame, key: str, version: str, path: str) -> None:
    """A freeze manifest: hash, version and number of items, as one JSON row."""
    set_fingerprint(items, key).withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").json(path)


def frozen(items: DataFrame, key: str, version: str, manifest: DataFrame) -> DataFrame:
    """`items`, or an error when hash or version differ from the manifest."""
    now = set_fingerprint(items, key).withColumn("version", F.lit(version))
    said = manifest.select(F.col("sha256").alias("_sha"), F.col("version").alias("_version"))
    bad = now.join(said, (F.col("sha256") == F.col("_sha")) & (F.col("version") == F.col("_version")), "left_anti")
    if not bad.isEmpty():
        raise ValueError("the set differs from its freeze manifest")
    return items


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """path, sha256 of each file's bytes."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def append_progress(rows: DataFrame, path: str) -> None:
    """Finished cells appended as JSON lines."""
    rows.write.mode("append").json(path)


def resume(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """The last entry of each cell."""
    df = spark.read.schema(schema).json(path)
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A CSV of fixed columns with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str, known: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Labels of known items, blank and unknown values as missing; a label for no item is an error."""
    labels = spark.read.schema(f"{key} string, label string").option("header", True).csv(path)
    if not labels.join(known.select(key), key, "left_anti").isEmpty():
        raise ValueError("labels name items that do not exist")
    return known.select(key).join(labels.select(key, F.when(F.trim("label").isin(*allowed), F.trim("label")).alias("label")), key, "left")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table; an error beyond `most` rows. A dash for null."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table to read")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("—" if v is None else str(v) for v in r) + " |" for r in rows)])


def load_checked_set(spark: SparkSession, path: str, schema: str, key: str, manifest: DataFrame | None = None) -> DataFrame:
    """`load_set`, or an error if the set's name is not its file's, or, with a manifest, if it is not the frozen one."""
    items = load_set(spark, path, schema)
    heads = items.select("name", "version").distinct().limit(2).collect()
    stem = path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]
    if len(heads) != 1 or heads[0]["name"] != stem:
        raise ValueError(f"the set in {path} does not say that it is {stem}")
    return items if manifest is None else frozen(items.drop("name", "version"), key, heads[0]["version"], manifest)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def load_or_build(spark: SparkSession, path: str, key: str, build) -> DataFrame:  # noqa: ANN001
    """A stored pool of rows, checked against its stored hash before use; built and stored only where there is none.

    A pool that no longer has its hash is an error and is never refreshed silently.
    """
    if not exists(spark, f"{path}/hash"):
        made = build()
        made.write.mode("overwrite").parquet(f"{path}/rows")
        set_fingerprint(spark.read.parquet(f"{path}/rows"), key).coalesce(1).write.mode("overwrite").json(f"{path}/hash")
    rows = spark.read.parquet(f"{path}/rows")
    said = spark.read.schema("sha256 string, items long").json(f"{path}/hash").first()
    if set_fingerprint(rows, key).first()["sha256"] != said["sha256"]:
        raise ValueError(f"the pool in {path} differs from its hash")
    return rows


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def resume_checked(spark: SparkSession, path: str, schema: str, key: str, order: str, fingerprint: str) -> DataFrame:
    """`resume`, or an error unless the log's provenance line (a row with `set_fingerprint`) is that of this set."""
    lines = spark.read.schema(f"set_fingerprint string, {schema}").json(path)
    if lines.filter(F.col("set_fingerprint") == fingerprint).isEmpty() or not lines.filter(F.col("set_fingerprint") != fingerprint).isEmpty():
        raise ValueError("the log is of another set")
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return lines.filter("set_fingerprint is null").drop("set_fingerprint").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_artifact(spark: SparkSession, folder: str, name: str) -> str | None:
    """The newest sub-folder, by its name, that holds a file `name`; None without one."""
    fs, place = _fs(spark, folder)
    found = [s.getPath() for s in fs.listStatus(place) if s.isDirectory()] if fs.exists(place) else []
    held = sorted(p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, name)))
    return f"{folder.rstrip('/')}/{held[-1]}" if held else None


def changed_files(spark: SparkSession, pattern: str, manifest: DataFrame) -> DataFrame:
    """Files (by name) whose hash is not the manifest's (name, sha256), or that either side lacks."""
    now = file_hashes(spark, pattern).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("sha256").alias("now"))
    j = now.join(manifest.select("name", F.col("sha256").alias("said")), "name", "full")
    return j.filter(~F.col("now").eqNullSafe(F.col("said")))


def open_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """A stored vector table, or an error if any of it was made by another embedding model."""
    rows = spark.read.parquet(path)
    others = [r["embedding_model"] for r in rows.select("embedding_model").distinct().limit(3).collect() if r["embedding_model"] != model]
    if others:
        raise ValueError(f"the vectors in {path} are of {others[0]}, not {model}")
    return rows


def publish(frames: dict[str, DataFrame], folder: str) -> None:
    """Several tables at once: all are staged first, then moved into place; a failure before that leaves nothing behind."""
    import uuid

    spark = next(iter(frames.values())).sparkSession
    stage = f"{folder.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    fs, staged = _fs(spark, stage)
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        for name, df in frames.items():
            df.write.parquet(f"{stage}/{name}")
        for name in frames:
            fs.delete(path(f"{folder}/{name}"), True)
            if not fs.rename(path(f"{stage}/{name}"), path(f"{folder}/{name}")):
                raise OSError(f"{name} could not be moved to {folder}")
    finally:
        fs.delete(staged, True)
