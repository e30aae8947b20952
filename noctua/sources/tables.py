"""Stored tables: feature files by night, nightly results, channel picks, cluster results, window labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noctua.schema import UNKNOWN_STAGE

NIGHT = r"night[=_]?(\d+)"
META = ("night", "epoch", "stage", "file", "cluster")


def write_features(df: DataFrame, path: str, kind: str = "parquet", digits: str | None = None) -> None:
    """A folder a night. Text may be cut to a number format such as %.6g."""
    if digits:
        df = df.withColumns({f.name: F.format_string(digits, f.name) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
    writer = df.write.mode("overwrite").partitionBy("night")
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def preferred_files(files: DataFrame) -> DataFrame:
    """night, path, kind: all binary files, and those csv files whose night has no binary one."""
    told = files.select(F.regexp_extract("path", NIGHT, 1).cast("int").alias("night"), "path", F.when(F.col("path").endswith(".csv"), "csv").otherwise("binary").alias("kind"))
    binary = told.filter("kind = 'binary'")
    return binary.unionByName(told.filter("kind = 'csv'").join(binary.select("night"), "night", "left_anti"))


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """One or many csv files; the night comes from the file's place where no column has it, unnamed columns go."""
    df = spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).csv(path)
    found = df.withColumn("_night", F.regexp_extract("_metadata.file_path", NIGHT, 1).cast("int"))
    night = F.coalesce(F.col("night").cast("int"), F.col("_night")) if "night" in df.columns else F.col("_night")
    named = [c for c in df.columns if c != "night" and not c.startswith(("Unnamed", "_c"))]
    return found.select(night.alias("night"), *[F.col(f"`{c}`") for c in named])


def load_features(spark: SparkSession, binary: str | None, text: str | None) -> DataFrame:
    """All nights of a folder of Parquet and one of csv; csv rows of a night that has Parquet rows are left out. A column
    that one kind lacks is null there; an epoch's array columns stay arrays.
    """
    parts = []
    if binary:
        parts.append(spark.read.option("mergeSchema", True).parquet(binary).withColumn("night", F.col("night").cast("int")))
    if text:
        rows = read_feature_csv(spark, text)
        parts.append(rows.join(parts[0].select("night").distinct(), "night", "left_anti") if parts else rows)
    if not parts:
        raise ValueError("no feature files")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def load_pipeline_csv(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """The csv files of a pipeline's nights; fewer than `least` files are an error."""
    df = read_feature_csv(spark, path)
    n = len(df.inputFiles())
    if n < least:
        raise ValueError(f"{n} files, at least {least} are needed")
    return df


def feature_columns(df: DataFrame, meta=META) -> list[str]:
    """Numeric columns that are not keys."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in meta]


def expanded(df: DataFrame, keys: list[str], column: str, most: int = 50) -> DataFrame:
    """An array column as name, value rows, one an element; arrays of more than `most` as their mean."""
    cells = F.when(F.size(column) <= most, F.transform(column, lambda x, i: F.struct(F.concat(F.lit(f"{column}_"), i.cast("string")).alias("name"), x.cast("double").alias("value"))))
    good = F.filter(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    mean = F.try_divide(F.aggregate(good, F.lit(0.0), lambda s, x: s + x), F.size(good))
    one = F.array(F.struct(F.lit(column).alias("name"), mean.alias("value")))
    return df.select(*keys, F.explode(F.coalesce(cells, one)).alias("c")).select(*keys, "c.name", "c.value")


def succeeded(results: DataFrame) -> DataFrame:
    """Nights that went well and have stages."""
    return results.filter(F.coalesce(F.col("ok"), F.lit(False)) & F.col("n_epochs").isNotNull() & (F.col("n_epochs") > 0))


def batch_totals(results: DataFrame) -> DataFrame:
    """nights, ok, epochs, gaps of a batch of nightly results."""
    return results.agg(F.count("*").alias("nights"), F.count_if(F.coalesce(F.col("ok"), F.lit(False))).alias("ok"), F.coalesce(F.sum("n_epochs"), F.lit(0)).alias("epochs"), F.coalesce(F.sum("n_gaps"), F.lit(0)).alias("gaps"))


def in_order(rows: DataFrame, starts: DataFrame, key: str, start: str) -> DataFrame:
    """rows with the start of their key and their place in its order; keys without one come last."""
    from pyspark.sql import window as W

    joined = rows.join(starts.select(key, start), key, "left")
    return joined.withColumn("place", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy(F.col(start).asc_nulls_last(), key)))  # a row a night


def write_clusters(rows: DataFrame, columns: list[str], path: str) -> None:
    """rows (with cluster) as csv, and the centres, a row a cluster."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    centres = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    centres.write.mode("overwrite").option("header", True).csv(f"{path}/centres")


def write_picks(picks: DataFrame, path: str) -> None:
    picks.write.mode("overwrite").parquet(path)


def load_picks(spark: SparkSession, path: str) -> DataFrame:
    """side, bin, name; a dimension of a row a pick. A folder without any is an error."""
    picks = spark.read.parquet(path)
    if picks.isEmpty():
        raise ValueError(f"no channels in {path}")
    return picks


def feature_summary(long: DataFrame) -> DataFrame:
    """tag, n, names of a long feature table (name, tag, value)."""
    return long.groupBy("tag").agg(F.count("value").alias("n"), F.count_distinct("name").alias("names"))


def write_window_labels(windows: DataFrame, path: str) -> None:
    """night, win, label as csv with a header."""
    windows.select("night", "win", "label").write.mode("overwrite").option("header", True).csv(path)


def with_stage(rows: DataFrame, stages: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(stages, keys, "left").withColumn("stage", F.coalesce("stage", F.lit(UNKNOWN_STAGE)))
