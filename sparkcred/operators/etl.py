"""Corpus building: admission, duplicates, imputation, quality filters, balancing, splits, merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.functions import lexicons as L
from sparkcred.functions import text as T
from sparkcred.operators.ranking import ranked
from sparkcred.session import cut


def first_by(df: DataFrame, key, order: str) -> DataFrame:
    """The first row by ``order`` of each key; combines before the shuffle, so a frequent key is no hot task."""
    packed = df.select(T.col(key).alias("_k"), F.col(order).alias("_o"), F.struct(*df.columns).alias("_r"))
    return packed.groupBy("_k").agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def admitted(df: DataFrame) -> DataFrame:
    """Stripped title and content; rows with an empty pair or a content under 20 characters dropped; media and date set."""
    out = df.withColumn("title", T.strip("title")).withColumn("content", T.strip("content"))
    media = T.strip("media")
    out = out.filter(~((F.col("title") == "") & (F.col("content") == "")) & (F.length("content") >= L.MIN_CONTENT))
    return out.withColumn("media", F.when(media == "", "Unknown").otherwise(media)).withColumn("date", T.parse_date("date"))


def exact_dedup(df: DataFrame, order: str = "id") -> DataFrame:
    """First row of each text by content hash."""
    return first_by(df, T.content_hash("title", "content"), order)


def content_fallback(df: DataFrame) -> DataFrame:
    """A content under ten characters becomes the title; still shorter rows are dropped."""
    short = F.length(F.coalesce("content", F.lit(""))) < 10
    return df.withColumn("content", F.when(short, F.coalesce("title", F.lit(""))).otherwise(F.col("content"))).filter(F.length("content") >= 10)


def mode_impute(df: DataFrame, columns: list[str], default: str = "unknown") -> DataFrame:
    """Nulls of each column become its most frequent value (the smallest of several), or ``default`` if there is none."""
    row = [df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(f"_{c}")) for c in columns]
    for c, one in zip(columns, row):
        df = df.crossJoin(F.broadcast(one)).withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(default).try_cast(df.schema[c].dataType))).drop(f"_{c}")  # one row
    return df


def with_flags(df: DataFrame, text: str = "clean_message", lexicon: dict = L.ETL_LEXICON, case_sensitive: bool = False) -> DataFrame:
    """Flag columns from one pass over the text, in place of any flags the rows had."""
    return df.drop(*L.FLAGS).select("*", *T.flags(text, lexicon, case_sensitive))


def flag_score() -> F.Column:
    out = F.lit(0)
    for f in L.FLAGS:
        out = out + F.coalesce(F.col(f), F.lit(0))
    return out


def filters() -> dict[str, F.Column]:
    """Quality filters in their fixed order, as predicates on content, label and flags."""
    content = F.coalesce("content", F.lit(""))
    return {
        "length": F.length(content) >= L.LEAST_CONTENT,
        "special": T.special_ratio("content") <= L.SPECIAL_MAX,
        "boilerplate": ~T.boilerplate_dominant("content"),
        "foreign": T.foreign_ratio("content") <= L.FOREIGN_MAX,
        "flags": ~(F.coalesce(F.col("label") == 1, F.lit(False)) & (flag_score() == 0)),
    }


def truncated_content(df: DataFrame) -> DataFrame:
    """Content and clean text cut to the limit where the content is longer."""
    long = F.length("content") > L.MAX_CONTENT
    cut_to = lambda c: F.when(long, F.substring(c, 1, L.MAX_CONTENT)).otherwise(F.col(c))
    return df.withColumns({"clean_message": cut_to("clean_message"), "content": cut_to("content")})


def funnel(df: DataFrame) -> DataFrame:
    """(step, rows): how many rows are left after each filter, from one scan."""
    kept, aggs = F.lit(True), [F.count("*").alias("all")]
    for name, ok in filters().items():
        kept = kept & ok
        aggs.append(F.count(F.when(kept, 1)).alias(name))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(c).alias("step"), F.col(c).alias("rows_left")) for i, c in enumerate(one.columns)])).alias("x")).select("x.*")


def _jaccard(a: frozenset, b: frozenset) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def _islands(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mark rows that no predecessor can drop: distance to the row before is above twice the allowed one."""
    last_label = last_set = None
    first = True
    n = 0
    for pdf in parts:
        out = []
        for p, label, norm, row, grams in zip(pdf["p"], pdf["label_key"], pdf["norm"], pdf["row"], pdf["grams"]):
            g = frozenset(grams)
            sure = not first and (label != last_label or not g or _jaccard(g, last_set) < 2 * L.TITLE_SIMILARITY - 1 - 1e-12)
            n += sure
            out.append((p, n, label, norm, row, list(g), first))
            last_label, last_set, first = label, g, False
        yield pd.DataFrame(out, columns=["p", "n", "label_key", "norm", "row", "grams", "first"])


def _scan_islands(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep a title unless it is too similar to the last kept one of its label; islands come whole and in order."""
    island = label = last = None
    for pdf in parts:
        kept = []
        for q, m, lab, row, grams in zip(pdf["q"], pdf["m"], pdf["label_key"], pdf["row"], pdf["grams"]):
            g = frozenset(grams)
            drop = island == (q, m) and lab == label and bool(last) and _jaccard(g, last) >= L.TITLE_SIMILARITY - 1e-12
            island = (q, m)
            if not drop:
                kept.append(row)
                label, last = lab, g
        yield pd.DataFrame({"row": kept}).astype("int64")


def near_dup_titles(df: DataFrame, order: str = "id") -> DataFrame:
    """Rows whose title is not nearly that of the last kept row of the same label, in title order.

    Jaccard distance is a metric: a row more than twice the allowed distance from the row before it cannot
    be within it of the last kept row. Such rows cut the sorted titles into short, independent islands;
    only islands are scanned in order. Equal titles count once, so a frequent title is no long island.
    """
    norm = F.trim(F.lower(F.coalesce("title", F.lit(""))))
    base = df.select(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_key"), norm.alias("norm"), F.col(order).alias("row"), "title")
    grams = T.trigrams(F.regexp_replace("norm", r"[^가-힣a-z0-9]", ""))
    one = base.groupBy("label_key", "norm").agg(F.min("row").alias("row"))
    # titles without any letter are never dropped, so all their rows stay
    blank = base.join(one.drop("row"), ["label_key", "norm"], "left_semi").filter(F.regexp_replace("norm", r"[^가-힣a-z0-9]", "") == "").select("row")
    placed = one.withColumn("grams", grams).filter(F.size("grams") > 0).repartitionByRange("label_key", "norm").sortWithinPartitions("label_key", "norm").withColumn("p", F.spark_partition_id())
    marked = cut(placed.mapInPandas(_islands, "p int, n int, label_key string, norm string, row long, grams array<string>, first boolean"))
    # the first island of a partition goes on from the partition before, unless nothing stands there
    ends = marked.groupBy("p").agg(F.max("n").alias("last")).orderBy("p").collect()
    joined, target = {}, None
    for e in ends:
        joined[e.p] = target if target is not None else (e.p, 0)
        target = joined[e.p] if e["last"] == 0 else (e.p, e["last"])
    same = marked.sparkSession.createDataFrame([(p, 0, q, m) for p, (q, m) in joined.items()] or [(-1, 0, -1, 0)], "p int, n int, q int, m int")
    islands = marked.join(F.broadcast(same), ["p", "n"], "left").withColumn("q", F.coalesce("q", "p")).withColumn("m", F.coalesce("m", "n"))  # one row a partition
    # an island of one title needs no scan
    several = islands.groupBy("q", "m").agg(F.count("*").alias("c")).filter("c > 1").select("q", "m")
    single = islands.join(several, ["q", "m"], "left_anti").select("row")
    scan = islands.join(several, ["q", "m"], "left_semi").select("q", "m", "label_key", "norm", "row", "grams").repartition("q", "m").sortWithinPartitions("q", "m", "label_key", "norm", "row")
    kept = scan.mapInPandas(_scan_islands, "row long").unionByName(single).unionByName(blank)
    return df.join(kept.withColumnRenamed("row", order), order, "left_semi")


def listing_dedup(df: DataFrame, order: str = "id") -> DataFrame:
    """Rows kept one after the other: a row goes if its url or title was kept before.

    Every round settles the rows that come first for both their url and title, and drops those that
    share either with a settled row, until none is left; long chains of alternating keys take a round each.
    """
    left = cut(df.select(F.col(order).alias("o"), F.coalesce("url", F.lit("")).alias("u"), F.coalesce("title", F.lit("")).alias("t")))
    kept = None
    while True:  # every round settles the first row that is left
        fu, ft = left.groupBy("u").agg(F.min("o").alias("fu")), left.groupBy("t").agg(F.min("o").alias("ft"))
        now = cut(left.join(fu, "u").join(ft, "t").filter((F.col("o") == F.col("fu")) & (F.col("o") == F.col("ft"))).select("o", "u", "t"))
        kept = now if kept is None else kept.unionByName(now)
        left = cut(left.join(now.select("u"), "u", "left_anti").join(now.select("t"), "t", "left_anti"))
        if left.isEmpty():
            break
    return df.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def undersample(df: DataFrame, key: str = "id") -> DataFrame:
    """Both labels cut to the size of the smaller one: label 1 by flag score, label 0 by seeded order."""
    score = F.when(F.col("label") == 1, -flag_score()).otherwise(F.lit(0))
    order = ranked(df.filter("label in (0, 1)").withColumn("_s", score).withColumn("_h", T.seeded(key)), ["_s", "_h", key], ["label"], "_rank", key)
    sizes = df.filter("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).agg(F.when(F.count("*") == 2, F.min("n")).otherwise(0).alias("_target"))
    return order.crossJoin(F.broadcast(sizes)).filter("_rank <= _target").drop("_s", "_h", "_rank", "_target")  # one row


def balanced_subsets(df: DataFrame, size: int = 30_000, key: str = "id") -> DataFrame:
    """Rows with ``subset_no``: equal halves of both labels; a short tail joins the last subset, surplus rows go."""
    half = size // 2
    order = ranked(df.filter("label in (0, 1)").withColumn("_h", T.seeded(key)), ["_h", key], ["label"], "_rank", key)
    least = df.filter("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).agg(F.when(F.count("*") == 2, F.min("n")).otherwise(0).alias("per"))
    full = F.floor(F.col("per") / half)
    rest = F.col("per") - full * half
    full = F.greatest(F.when((rest > 0) & (rest < half), full - 1).otherwise(full), F.lit(0))
    out = order.crossJoin(F.broadcast(least.withColumn("_full", full.cast("int")))).filter(F.col("_rank") <= F.col("per"))  # one row
    return out.withColumn("subset_no", (F.least(F.floor((F.col("_rank") - 1) / half), F.col("_full")) + 1).cast("int")).drop("_h", "_rank", "per", "_full")


def stratified_split(df: DataFrame, shares: dict[str, float], key: str = "id", seed: int = 42) -> DataFrame:
    """Rows with ``split``: exact shares of every label in seeded order; the last part takes what is left."""
    order = ranked(df.withColumn("_h", T.seeded(key, seed)), ["_h", key], ["label"], "_rank")
    n = order.groupBy("label").agg(F.count("*").alias("_n")).withColumnRenamed("label", "_l")
    out = order.join(F.broadcast(n), F.col("label").eqNullSafe(F.col("_l")))  # one row a label
    split, upto = None, 0.0
    for name, share in list(shares.items())[:-1]:
        upto += share
        ok = F.col("_rank") <= F.floor(F.col("_n") * round(upto, 9) + 0.5)
        split = F.when(ok, name) if split is None else split.when(ok, name)
    last = list(shares)[-1]
    return out.withColumn("split", F.lit(last) if split is None else split.otherwise(last)).drop("_h", "_rank", "_n", "_l")


def kfold(df: DataFrame, k: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Rows with ``fold`` 0..k-1, even within every label."""
    return ranked(df.withColumn("_h", T.seeded(key, seed)), ["_h", key], ["label"], "_rank").withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_h", "_rank")


def merged(old: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Old then new rows on their common columns (in the old order), first of each title."""
    common = [c for c in old.columns if c in new.columns]
    both = old.select(*common, F.lit(0).alias("_src")).unionByName(new.select(*common, F.lit(1).alias("_src")))
    best = both.withColumn("_o", F.struct("_src", order))
    return first_by(best, "title", "_o").drop("_o", "_src")


def all_sources(*sources: DataFrame) -> DataFrame:
    """Rows of several sources with the columns of the first, null where a source lacks one; ``source_no`` and ``ord`` keep their order.

    Each source has ``ord``, its own order as text.
    """
    first, *rest = [s.withColumn("source_no", F.lit(n)) for n, s in enumerate(sources)]
    for s in rest:
        first = first.unionByName(s.select(*[F.col(c) if c in s.columns else F.lit(None).cast(first.schema[c].dataType).alias(c) for c in first.columns]))
    return first


def shared_dedup(df: DataFrame) -> DataFrame:
    """Admitted rows of all sources, the first of each text by one set of keys shared by all."""
    best = admitted(df).withColumn("_o", F.struct("source_no", "ord"))
    return exact_dedup(best, "_o").drop("_o")


def samples(df: DataFrame, key, most: int = 60) -> DataFrame:
    """Rows of label 1 in seeded order, at most ``most``, with a summary of verdict and beginning of the content."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    summary = F.concat(F.when(text("verdict") != "", F.concat(F.lit("["), text("verdict"), F.lit("] "))).otherwise(""), F.substring(text("content"), 1, 200))
    one = df.filter("label = 1").withColumn("_h", F.md5(F.concat(F.concat_ws("|", *[text(c) for c in key]), F.lit("|42"))))
    return one.orderBy("_h").limit(most).withColumn("summary", summary).drop("_h")


def not_cached(rows: DataFrame, cache: DataFrame, key: str = "text_key") -> DataFrame:
    """Rows whose content key is not in the cache yet."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def source_cap(df: DataFrame, source: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each source."""
    return ranked(df, order, [source], "_rank").filter(F.col("_rank") <= most).drop("_rank")
