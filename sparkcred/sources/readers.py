"""Readers of the input formats; a missing path gives an empty table of the same schema."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = "title string, content string, media string, date string, label int"


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            return spark.createDataFrame([], schema)
        raise


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """CSV with header, quotes and line breaks in fields; only ``columns``, without rows that lack a required one."""
    out = _or_empty(spark, lambda: spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path), schema)
    out = out.select(*columns) if columns else out
    return out.na.drop(subset=required) if required else out


def english_by_file(spark: SparkSession, path: str, label: int) -> DataFrame:
    """title,text,subject,date files whose label is known from the file."""
    raw = csv(spark, path, "title string, text string, subject string, date string")
    return raw.select("title", F.col("text").alias("content"), F.col("subject").alias("media"), "date", F.lit(label).alias("label"))


def english_inline(spark: SparkSession, path: str) -> DataFrame:
    """title,text,date,label files; a label that contains FAKE is 1."""
    raw = csv(spark, path, "title string, text string, date string, label string")
    fake = F.upper(F.coalesce("label", F.lit(""))).contains("FAKE").cast("int")
    return raw.select("title", F.col("text").alias("content"), F.lit("News").alias("media"), "date", fake.alias("label"))


def _members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if not name.endswith(".json"):
                            continue
                        try:
                            d = json.loads(z.read(name).decode("utf-8-sig"))
                            src, lab = d.get("sourceDataInfo") or {}, d.get("labeledDataInfo") or {}
                            rows.append((path, name, src.get("newsTitle"), src.get("newsContent"), src.get("newsCategory"), 1 - int(lab.get("clickbaitClass", 1))))
                        except (ValueError, AttributeError, TypeError, KeyError, zipfile.BadZipFile):
                            continue
            except zipfile.BadZipFile:
                pass
            yield pd.DataFrame(rows, columns=["path", "member", "title", "content", "media", "label"])


def zipped_json(spark: SparkSession, folder: str) -> DataFrame:
    """Articles in *.zip archives of JSON files below a folder; unreadable archives and members are left out.

    One archive is read by one task. The label is 1 minus the stated class, which is 1 where it is missing.
    """
    files = _or_empty(spark, lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder), "path string, content binary")
    return files.select("path", "content").mapInPandas(_members, "path string, member string, title string, content string, media string, label int")


def section_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(cache_key, fetched_at, article fields...) of JSON cache files, one row per article."""
    item = "struct<title:string,press:string,category:string,time:string,url:string,image_url:string,summary:string,text:string,body_ready:boolean,fake_score:double,predicted_label:int>"
    schema = f"cache_key string, articles array<{item}>"
    raw = _or_empty(spark, lambda: spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("fetched_at", F.col("_metadata.file_modification_time")), schema + ", fetched_at timestamp")
    return raw.select("cache_key", "fetched_at", F.explode("articles").alias("a")).select("cache_key", "fetched_at", "a.*")


def log_metric(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """(file, value): the first ``metric: number`` line of each text log."""
    import re

    lines = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return lines.select("file", F.regexp_extract("value", rf"(?im)^\s*{re.escape(metric)}\s*:\s*([0-9.]+)", 1).try_cast("double").alias("value"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a text file, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> '' and not word like '#%'").distinct()


def contract(df: DataFrame, label: str = "label", non_negative: tuple[str, ...] = ()) -> DataFrame:
    """One row of checks: row count, whether labels are exactly 0 and 1, whether columns hold no negative value."""
    kinds = F.array_sort(F.collect_set(F.col(label).cast("int")))
    negatives = [F.coalesce(F.min(F.col(c)) >= 0, F.lit(True)).alias(f"{c}_ok") for c in non_negative]
    return df.agg(F.count("*").alias("n"), (kinds == F.array(F.lit(0), F.lit(1))).alias("labels_ok"), *negatives)


def missing_columns(df: DataFrame, schema: str) -> list[str]:
    """Columns of a schema that a table lacks."""
    return [f.name for f in T._parse_datatype_string(schema).fields if f.name not in df.columns]
