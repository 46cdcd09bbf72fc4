"""The live feed as a stream: polled files, late and repeated records, scores, an upserted view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkcred.functions import lexicons as L
from sparkcred.operators import serving, views
from sparkcred.session import cut
from sparkcred.sources import sinks


def news_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """Parquet files that arrive in a folder, a few at a time."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    # watermarks need instants; times without zone are read in the session's zone
    return raw.withColumns({c: raw[c].cast("timestamp") for c, kind in raw.dtypes if kind == "timestamp_ntz"})


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ingest_ts", delay: str = "7 days") -> DataFrame:
    """First record of each key within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def scored(stream: DataFrame, threshold: float = 50.0) -> DataFrame:
    return views.scored(stream, threshold)


def tumbling_counts(stream: DataFrame, time: str, width: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts per time window (an extension beside the batch views)."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def model_scored(stream: DataFrame, models: dict, threshold: float = 50.0) -> DataFrame:
    """Records scored by loaded models, each by the one of its language, then labelled as in the views."""
    return views.scored(serving.scored(stream, models), threshold)


def upsert(path: str, key: str, newest: str, buckets: int = 32) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: the newest row of each key stays, rows with a body before those without.

    The table lies in buckets of the key, and a batch rewrites only those it touches. What is to be written
    stands complete in a folder beside the table first; a writer that died is made up for from there, and
    replaying a batch changes nothing, so the sink is safe to restart.
    """
    pending = f"{path}__pending"

    def apply(spark: SparkSession) -> None:
        fs, p, jvm = sinks._fs(spark, pending)
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{pending}/_SUCCESS")):
            spark.read.parquet(pending).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        if fs.exists(p):
            fs.delete(p, True)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        apply(spark)
        batch = cut(batch.drop("bucket").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most all buckets
        if not touched:
            return
        fs, p, _ = sinks._fs(spark, path)
        both = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).unionByName(batch, allowMissingColumns=True) if fs.exists(p) else batch
        order = F.struct(F.coalesce("body_ready", F.lit(False)), newest) if "body_ready" in both.columns else F.struct(newest)
        best = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(pending)
        apply(spark)

    return write


def published(path: str, models: dict, key: str = "url", newest: str = "ingest_ts") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer in two phases: a record is scored on its headline at once, and again when its body has come."""
    into = upsert(path, key, newest)

    def write(batch: DataFrame, batch_id: int) -> None:
        into(model_scored(batch, models), batch_id)

    return write


def of_kind(pages: DataFrame, kind: str, page: str = "page") -> DataFrame:
    """Listing pages up to the depth its kind of view is read to."""
    return pages.filter(F.col(page) <= L.PAGE_DEPTH[kind])


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything that is there, then stop."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_polling(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], every: str = "5 minutes") -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
