"""Writers: Parquet first, CSV with a byte-order mark and JSON caches on request."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def csv_with_bom(df: DataFrame, path: str) -> None:
    """CSV with header whose first column name carries the byte-order mark spreadsheets look for."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def replace(df: DataFrame, path: str) -> str | None:
    """Write beside the target, keep the old version under a numbered backup name, then swap. Returns the backup's path.

    For tables that are replaced now and then; each call leaves one backup.
    """
    spark = df.sparkSession
    fs, target, jvm = _fs(spark, path)
    new, backup = f"{path}__new", None
    df.write.mode("overwrite").parquet(new)
    if fs.exists(target):
        n = 1
        while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}__backup{n}")):
            n += 1
        backup = f"{path}__backup{n}"
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(backup))
    fs.rename(jvm.org.apache.hadoop.fs.Path(new), target)
    return backup


def cache_name(key: str) -> str:
    """File name of a cache key."""
    return re.sub(r"[:,/]", "__", key)


def json_cache(df: DataFrame, path: str, key: str = "cache_key") -> None:
    """One JSON folder per cache key."""
    df.withColumn(key, F.regexp_replace(key, r"[:,/]", "__")).write.mode("overwrite").partitionBy(key).json(path)


def predictions(df: DataFrame, path: str) -> None:
    """Label, prediction and score per row, as Parquet."""
    df.select("key", "label", "prediction", "score").write.mode("overwrite").parquet(path)
