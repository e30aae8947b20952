"""Shared helpers: the cluster's shared folder, materialised tables and global ranks."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

SPACE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set and driver and tasks are one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = known.get() if known.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="noctua-shared-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    The table stays until its operator lets it go (`clear_stored`) or, since lazy results may still read it, until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noctua/{name}-{uuid.uuid4().hex}"
    # the shuffles of tables that are written are of no more use: Spark deletes their files once the driver's heap lets go of their plans
    spark._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    PLACES[out] = path
    return out


#: Intermediate tables of this driver, and where those that are still in use here lie.
STORED: list[str] = []
PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def passing(spark: SparkSession, path: str) -> None:
    """Has the file system delete what lies at path as the driver ends."""
    STORED.append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def clear_stored(spark: SparkSession, since: int = 0, kept: tuple = ()) -> None:
    """Deletes the intermediate tables written after the first `since`, but for those of kept; results that still read them must be written before."""
    jvm, conf, held = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {PLACES[t] for t in kept if t is not None}
    for at in STORED[since:]:
        if at not in held:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
            STORED.remove(at)


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column (in any case of letters)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def tucked(df: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns, and all others in one struct `_rest`, so that no working name can clash with them."""
    rest = [F.col(quoted(c)) for c in df.columns if c not in needed]
    return df.select(*needed, (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def untucked(df: DataFrame, like: DataFrame, needed: list[str], *more) -> DataFrame:
    """The columns of `like` again, in their order, and `more`."""
    return df.select(*[F.col(c) if c in needed else F.col(f"_rest.{quoted(c)}").alias(c) for c in like.columns], *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(df: DataFrame) -> int:
    """Partitions for an explicit repartition: follows spark.sql.shuffle.partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_total(df: DataFrame, order: list, value: str, out: str, name: str) -> DataFrame:
    """Adds the total of `value` over all rows before this one, in the order of `order`, without one task for all.

    Rows are ranged over partitions and stored, so that the ranges are fixed. Only one sum a partition meets in one
    place; within a partition the total runs in a window of that partition alone. Equal rows get some order.
    """
    ranged = stored(df.repartitionByRange(parts(df), *order).withColumn("_part", F.spark_partition_id()), name)
    sums = ranged.groupBy("_part").agg(F.sum(value).cast("long").alias("_sum"))
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.Window.partitionBy("_part").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    total = F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return ranged.join(F.broadcast(bases), "_part").withColumn(out, total.cast("long")).drop("_part", "_base")


def column_types(df: DataFrame, **more: str) -> T.StructType:
    """The schema of df with columns added or replaced."""
    fields = {f.name: f for f in df.schema.fields}
    for k, v in more.items():
        fields[k] = T.StructField(k, T._parse_datatype_string(v))
    return T.StructType(list(fields.values()))
