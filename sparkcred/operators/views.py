"""Article views: timelines, filters, counts, pages, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcred.functions import lexicons as L
from sparkcred.functions import text as T
from sparkcred.operators.ranking import ranked


def timeline(df: DataFrame, time: str = "pub_time", order: str = "id") -> DataFrame:
    """Rows with ``position``: newest clock times first, then dates, then the rest; ties in the order they came."""
    kind, value = T.time_key(time)
    return ranked(df.withColumns({"_k": -kind, "_v": -value}), ["_k", "_v", order], name="position").drop("_k", "_v")


def display_order(df: DataFrame, score: str = "fake_score", order: str = "id") -> DataFrame:
    """Rows with ``position``: low scores first, null as 0."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    return ranked(df.withColumns({"_a": F.when(s < 50, 0).otherwise(1), "_b": s}), ["_a", "_b", order], name="position").drop("_a", "_b")


def view_filter(df: DataFrame, kind: str = "all") -> DataFrame:
    """all, real, fake, or the name of a flag (label 1 with the flag); anything else is all."""
    label = F.col("predicted_label")
    if kind == "real":
        return df.filter(label == 0)
    if kind == "fake":
        return df.filter(label == 1)
    return df.filter((label == 1) & (F.col(kind) == 1)) if kind in L.FLAGS else df


def page(df: DataFrame, order: list, number: int, size: int = L.PAGE_SIZE) -> DataFrame:
    """Rows of one page with ``position``, ``page`` and ``pages``; the number is kept between 1 and the last page."""
    all_rows = ranked(df, order, name="position")
    pages = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("pages"))
    at = all_rows.crossJoin(F.broadcast(pages)).withColumn("page", F.greatest(F.lit(1), F.least(F.lit(number), F.col("pages"))))  # one row
    return at.filter(F.ceil(F.col("position") / size) == F.col("page"))


def counts(df: DataFrame) -> DataFrame:
    """One row: records, real, fake, and flags among the fake."""
    fake = F.col("predicted_label") == 1
    return df.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("predicted_label") == 0, 1)).alias("real"), F.count(F.when(fake, 1)).alias("fake"),
        *[F.count(F.when(fake & (F.col(f) == 1), 1)).alias(f) for f in L.FLAGS],
    )


def scored(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Label, result text and whether there was a score at all; a missing score becomes a hash of the id."""
    fallback = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("double") / 65535 * 100
    score = F.coalesce("fake_score", F.round(fallback, 1))
    out = df.withColumns({"score_source": F.when(F.col("fake_score").isNull(), "fallback").otherwise("model"), "score": score})
    label = (F.col("score") >= threshold).cast("int")
    return out.withColumns({"predicted_label": label, "result_text": F.when(label == 1, "fake").otherwise("real")})


def status(groups: DataFrame, df: DataFrame, by: str) -> DataFrame:
    """Per wanted group: loading (nothing there yet), total, body_ready."""
    have = df.groupBy(by).agg(F.count("*").alias("total"), F.sum(F.coalesce("body_ready", F.lit(False)).cast("int")).alias("body_ready"))
    out = groups.select(by).distinct().join(have, by, "left")
    return out.select(by, F.col("total").isNull().alias("loading"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("body_ready", F.lit(0)).alias("body_ready"))


def results(df: DataFrame) -> DataFrame:
    """Rows of a result file as articles: texts without nulls, numbers coerced (0 where they are none), the first of each title, newest first.

    Scores without number are null; ``position`` is the place in the timeline.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).cast("int").alias(c)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = df.select("id", text("title"), text("media"), text("category"), text("pub_time"), F.when(F.lower("image_url") != "nan", F.col("image_url")).alias("image_url"), F.col("fake_score").cast("string").try_cast("double").alias("fake_score"), *[number(f) for f in L.FLAGS])
    first = rows.groupBy(T.trimmed("title").alias("_k")).agg(F.min_by(F.struct(*rows.columns), "id").alias("r")).select("r.*")
    return timeline(first)


def date_label(day) -> F.Column:
    """``MM.DD(weekday)`` with the weekday's short Korean name; null where there is no date."""
    names = F.array(*[F.lit(x) for x in L.WEEKDAYS])
    return F.when(F.col(day).isNotNull(), F.concat(F.date_format(day, "MM.dd"), F.lit("("), F.element_at(names, F.weekday(day) + 1), F.lit(")")))


def query_string(*names: str) -> F.Column:
    """``a=1&b=2`` of the columns that have a value, url-encoded."""
    some = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(c + "="), F.url_encode(F.col(c).cast("string")))) for c in names]
    return F.concat_ws("&", *some)


def stale(df: DataFrame, by: str, fetched: str, now, ttl: int = L.TTL_SECONDS) -> DataFrame:
    """Groups whose newest fetch is older than the limit, or that have none."""
    last = df.groupBy(by).agg(F.max(fetched).alias("fetched_at"))
    return last.filter(F.col("fetched_at").isNull() | (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("fetched_at") > ttl))


def page_cutoff(new_rows: DataFrame, page_no: str = "page", n: str = "n_new") -> DataFrame:
    """Pages up to the second of two empty ones in a row; page numbers are few, so one window holds them."""
    w = Window.orderBy(page_no)
    twice = ((F.col(n) == 0) & (F.coalesce(F.lag(n).over(w), F.lit(1)) == 0)).cast("int")
    stopped = F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return new_rows.withColumn("_t", twice).withColumn("_s", stopped).filter("_s = 0").drop("_t", "_s")


def article_text(*columns: str) -> F.Column:
    """Non-empty columns joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in columns])


def boosted_text(title: str, body: str, times: int = 5) -> F.Column:
    """The title several times, then the body."""
    return F.concat(F.repeat(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" ")), times), F.coalesce(F.col(body), F.lit("")))


def enriched(listing: DataFrame, bodies: DataFrame, key: str = "url") -> DataFrame:
    """Listing rows with their fetched body where it is not empty; body_ready is true afterwards."""
    one = bodies.groupBy(key).agg(F.max("body").alias("body"))
    out = listing.join(one, key, "left")
    return out.withColumns({"content": F.coalesce(F.nullif(F.coalesce("body", F.lit("")), F.lit("")), F.col("content")), "body_ready": F.lit(True)}).drop("body")
