"""Exact ranks and identifiers without sending a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcred.session import cut, maybe_broadcast


def ranked(df: DataFrame, order: list, by: list[str] | None = None, name: str = "rank", unique: str | None = None) -> DataFrame:
    """``df`` with the 1-based position of each row in the order, overall or within each group.

    Rows are range partitioned by group and order; positions inside a partition come from a running count
    and the partitions before it add an offset, so a group in a third of all rows is spread like any other.
    The order must end in a unique key to be deterministic; nulls stand first, null groups are one group.
    With ``unique``, a column without nulls or repeats, only it, the groups and the order are sorted and
    written; the other columns are joined to their ranks afterwards.
    """
    if unique is not None:
        cols = {f"_o{n}": o if isinstance(o, Column) else F.col(o) for n, o in enumerate(order)}
        keys_only = df.select(unique, *[c for c in by or [] if c != unique], *[c.alias(n) for n, c in cols.items()])
        return df.join(ranked(keys_only, list(cols), by, name).select(unique, name), unique).select(*df.columns, name)
    by = by or []
    keys = [F.col(c) for c in by] + [o if isinstance(o, Column) else F.col(o) for o in order]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_p", *by).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    w = Window.orderBy("_p") if not by else Window.partitionBy(*by).orderBy("_p")
    # one row per partition and group
    starts = cut(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n"))
    n = starts.count()
    right = maybe_broadcast(starts.select(F.col("_p").alias("_q"), "_first", "_before", *[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]), n)
    on = F.col("_p") == F.col("_q")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(right, on).withColumn(name, F.col("_before") + F.col("_i") - F.col("_first") + 1).select(*df.columns, name)


def with_ids(df: DataFrame, order: list, name: str = "id") -> DataFrame:
    """Consecutive identifiers from 1 on in the given order."""
    return ranked(df.drop(name), order, name=name)
