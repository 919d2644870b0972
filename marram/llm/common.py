"""What several operators share: written tables, skew-safe joins, ranks within groups."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word definition, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: At most so many keys of a join are treated as hot, each with more than so many rows.
HOT_KEYS, HOT_ROWS = 1000, 100

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir. Where all run in one process it may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        made = tempfile.TemporaryDirectory(prefix="marram-")
        atexit.register(made.cleanup)
        _own_folder.append("file://" + made.name)
    return _own_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors.

    The shuffle files of the write aren't needed after it, so Spark is told to delete them then, where it can (from 4.1 on).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marram-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this session has written; call it when results that read them are no longer needed."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, _tables):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _tables.clear()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from the given ones; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_keys(rows: DataFrame, key: str) -> list:
    """The HOT_KEYS keys with the most rows, if over HOT_ROWS: any other has less than 1/HOT_KEYS of the rows. No nulls."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
    return [r[key] for r in counts.orderBy(F.desc("_n"), key).limit(HOT_KEYS).collect()]


def skew_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join rows to facts, which has at most one narrow row a key, whatever share of the rows one key has.

    The facts of hot keys, HOT_KEYS at most, are broadcast; the rest is shuffled. rows is read up to three times, so pass a
    written table. hot gives the hot keys of rows where they are known.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(facts, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), key, how)
    return warm.unionByName(rows.where(~is_hot).join(facts.where(~is_hot), key, how))


def n_buckets(rows: int) -> int:
    """Into how many buckets to deal a group of so many rows: as many as a bucket has rows, but 1000 rows each at least."""
    return max(1, rows // max(1000, isqrt(rows)))


def running(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column | None = None, into: str = "_before") -> DataFrame:
    """Add, for each row, the sum of value over the group's rows before it, as a long; value is 1 if not given.

    Rows are ordered by bucket, a whole number that deals a group's rows out to many buckets, then by order, which must
    leave no ties. Sums run within a bucket; the totals of buckets, one row each, give where a bucket begins.
    So no task gets more than a bucket of rows or one row a bucket. Null groups are groups too. rows is read twice.
    """
    value = F.lit(1) if value is None else value
    rows = rows.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    starts = rows.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_total"))
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = rows.join(starts, same, "inner").withColumn(into, F.col("_start") + F.col("_inside"))
    return out.drop("_bucket", "_value", "_b", "_start", "_inside", *[f"_g{i}" for i in range(len(group))])
