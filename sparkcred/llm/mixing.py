"""Problem 8: mixing sources to target weights.

Efraimidis-Spirakis sampling: each record gets the key -ln(u) / w from a hashed uniform u and its quality
weight w; in the order of keys, a source's records are a weighted sample without replacement of any
length. A source's budget is filled by whole epochs first, then by the records with the smallest keys
until the prefix sum of tokens reaches what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcred.llm.tokenizer import FOLDER, sizer
from sparkcred.session import cut, maybe_broadcast

#: Steps of the cumulated key distribution; only the step in which a budget ends is sorted.
STEPS = 4096


def source_of(source: F.Column) -> F.Column:
    """Name of a source without case and padding; null and blank sources are ''."""
    return F.lower(F.trim(F.coalesce(source, F.lit(""))))


def sized(documents: DataFrame, seed: int = 42, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, tokens, weight, sort_key): size and sampling key of every document with text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sz = sizer(folder)
        for pdf in parts:
            n = [len(x) for t in range(0, len(pdf), 256) for x in sz.encoding.encode_ordinary_batch(list(pdf["text"][t : t + 256]), num_threads=1)]
            yield pdf.drop(columns="text").assign(tokens=n)

    # quality: share of letters times the share of words that are new in the text, at least 0.05
    words = F.split(F.trim("text"), r"\s+")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", "")) / F.greatest(F.length("text"), F.lit(1))
    weight = F.greatest(letters * F.sqrt(F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))), F.lit(0.05))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    base = documents.filter("text is not null and text <> ''").select(
        "doc_id", source_of(F.col("source")).alias("source"), F.round(weight, 9).alias("weight"), (-F.log(u)).alias("e"), "text"
    )
    return base.mapInPandas(run, "doc_id long, source string, weight double, e double, tokens long").select("doc_id", "source", "tokens", "weight", (F.col("e") / F.col("weight")).alias("sort_key"))


def budgets(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, epochs, rest) of every listed source or source with documents."""
    wanted = targets.select(source_of(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("records"))
    both = wanted.join(have, "source", "full").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("records", F.lit(0)).alias("records"))
    total = F.lit(total_tokens) if total_tokens is not None else F.col("total")
    both = both.crossJoin(both.agg(F.sum("available").alias("total")))  # one row
    budget = F.round(F.col("target_share") * total).cast("long")
    reach = F.least(budget, F.col("available") * F.col("max_repeats"))
    epochs = F.when(F.col("available") > 0, F.expr("floor(reach / available)")).otherwise(0).cast("int")
    return both.withColumn("budget", budget).withColumn("reach", reach).withColumn("epochs", epochs).withColumn("rest", F.col("reach") - F.col("epochs") * F.col("available")).drop("total", "reach")


def _fill(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """(row, source, tokens) of the records that come first by key and together stay within their source's gap.

    Token sums of key steps are cumulated first; only the step in which a gap ends is sorted.
    """
    fits = rows.join(gaps, "source").filter(F.col("tokens") <= F.col("gap"))
    sums = fits.groupBy("source", "step").agg(F.sum("tokens").alias("t"), F.first("gap").alias("gap"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("step"))
    over = sums.withColumn("upto", upto).filter("upto > gap").groupBy("source").agg(F.min(F.struct("step", (F.col("upto") - F.col("t")).alias("before"))).alias("at"))
    fits = fits.join(over, "source", "left")
    whole = fits.filter("at is null or step < at.step")
    inside = F.sum("tokens").over(Window.partitionBy("source").orderBy("sort_key", "doc_id", "row"))
    edge = fits.filter("step = at.step").withColumn("upto", F.col("at.before") + inside).filter("upto <= gap")
    return whole.select("row", "source", "tokens").unionByName(edge.select("row", "source", "tokens"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, folder: str = FOLDER, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(selection, plan): (doc_id, source, tokens, uses) of the records used, and the budgets.

    ``total_tokens`` defaults to the tokens of all documents. Where the next record by key is larger than
    what is left of a budget, further rounds fill the gap with the next records that fit. Null or empty
    texts have no size and are never used; sources that are not listed have target 0; listed sources
    without documents, and those whose repeats are used up, fall short.
    """
    docs = sized(documents, seed, folder).withColumn("row", F.monotonically_increasing_id())
    step = F.least(F.floor((1 - F.exp(-F.col("sort_key"))) * STEPS), F.lit(STEPS - 1)).cast("int")
    docs = cut(docs.withColumn("step", step))
    plan = cut(budgets(docs, targets, total_tokens))
    gaps = plan.filter("rest > 0").select("source", F.col("rest").alias("gap"))
    chosen, left = None, docs
    for _ in range(rounds):
        new = cut(_fill(left, maybe_broadcast(gaps, plan.count(), 100_000)))
        chosen = new if chosen is None else chosen.unionByName(new)
        used = new.groupBy("source").agg(F.sum("tokens").alias("u"))
        gaps = cut(gaps.join(used, "source", "left").select("source", (F.col("gap") - F.coalesce("u", F.lit(0))).alias("gap")).filter("gap > 0"))
        left = left.join(new.select("row"), "row", "left_anti")
    more = chosen.select("row", F.lit(1).alias("more"))
    rows = docs.join(maybe_broadcast(plan.select("source", "epochs"), plan.count(), 100_000), "source").join(more, "row", "left")
    uses = (F.col("epochs") + F.coalesce("more", F.lit(0))).alias("uses")
    return rows.select("doc_id", "source", "tokens", uses).filter("uses > 0"), plan


def selection(documents: DataFrame, targets: DataFrame, **more) -> DataFrame:
    return mix(documents, targets, **more)[0]


def report(documents: DataFrame, targets: DataFrame, **more) -> DataFrame:
    """(source, target_share, actual_share, budget, used_tokens, shortfall_tokens, used_records, most_uses) per source."""
    chosen, plan = mix(documents, targets, **more)
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count("*").alias("used_records"), F.max("uses").alias("most_uses"))
    out = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    out = out.crossJoin(out.agg(F.sum("used_tokens").alias("all_used")))  # one row
    return out.select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("used_tokens"), F.col("all_used")), F.lit(0.0)).alias("actual_share"), "budget", "used_tokens",
        F.greatest(F.col("budget") - F.col("used_tokens"), F.lit(0)).alias("shortfall_tokens"), F.coalesce("used_records", F.lit(0)).alias("used_records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
