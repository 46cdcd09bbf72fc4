"""Problem 4 between jobs: the accepted history as stored graph shards, to which one batch after the other is held.

The store is a folder of Parquet tables:

- ``shards``: small-world graphs, one row a shard with its segment, the span of batches it holds and the
  graph itself; a merged shard supersedes those inside its span
- ``keys``: (h, id) hashes of addresses and headlines with the first record of each, in BUCKETS folders
- ``labels``: (node, component, version), the article of each linked record; the newest version holds

Accepting a batch reads the shards of the segments its titles are routed to and the key hashes of the
buckets it touches; no title or address of the history is read or signed again. Every batch writes its own folder under each
table, so a repeated attempt overwrites what a failed one left.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcred.llm import new_batches as nb
from sparkcred.llm.components import components
from sparkcred.llm.small_world import SmallWorld
from sparkcred.session import cut

SHARDS = "route int, segment int, part int, first int, last int, titles int, graph binary"
KEYS, LABELS = "h long, id long", "node long, component long, version int"
#: Folders of the key hashes.
BUCKETS = 64


class Shard:
    """A graph with what is needed to judge its titles."""

    def __init__(self, ids: np.ndarray, keys: list[str], bits: np.ndarray, hashes: np.ndarray):
        self.ids, self.keys, self.bits, self.hashes = ids, keys, bits, hashes
        self.graph = SmallWorld(bits, hashes)
        self.graph.tune(hashes, nb.RADIUS)

    def links(self, ids, keys, bits, hashes) -> set[tuple[int, int]]:
        x, y = self.graph.within(bits, nb.RADIUS, hashes)
        out = set()
        for q, r in zip(x.tolist(), y.tolist()):
            a, b = int(ids[q]), int(self.ids[r])
            if a != b and (min(a, b), max(a, b)) not in out and nb.same_headline(keys[q], self.keys[r]):
                out.add((min(a, b), max(a, b)))
        return out


def _segment(batch_no: int, compact_every: int):
    """Search a segment's stored shards for the batch's titles, add the batch's own shard, merge when there are many."""

    def run(new: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        cols = ["kind", "a", "b", *[x.split(" ")[0] for x in SHARDS.split(", ")]]
        if not len(new):
            return pd.DataFrame([], columns=cols)
        new = new.sort_values("id", kind="stable")
        route, segment, part = (int(new[c].iloc[0]) for c in ("route", "segment", "part"))
        ids, keys = new["id"].to_numpy(), new["title_key"].tolist()
        bits = np.frombuffer(b"".join(new["bits"]), "uint64").reshape(len(new), nb.BITS // 64)
        hashes = np.array(new["rings"].tolist(), "int64")
        shards = [pickle.loads(g) for g in stored["graph"]]
        links = set().union(*(s.links(ids, keys, bits, hashes) for s in shards))
        mine = np.flatnonzero((new["home"] == new["part"]).to_numpy())
        out = []
        if len(mine):
            own = Shard(ids[mine], [keys[i] for i in mine], bits[mine], hashes[mine])
            links |= own.links(ids, keys, bits, hashes)
            first = batch_no
            if len(shards) >= compact_every:
                every = [*shards, own]
                own = Shard(np.concatenate([s.ids for s in every]), [k for s in every for k in s.keys], np.concatenate([s.bits for s in every]), np.concatenate([s.hashes for s in every]))
                first = int(stored["first"].min())
            out.append(("shard", 0, 0, route, segment, part, first, batch_no, len(own.keys), pickle.dumps(own, protocol=5)))
        out += [("link", a, b, route, segment, part, 0, 0, 0, None) for a, b in links]
        return pd.DataFrame(out, columns=cols)

    return run


class History:
    """The store in a shared folder; ``segments`` is fixed when it is made and sets how many titles share a graph.

    A segment's shards are merged into one as soon as ``compact_every`` stand there.
    """

    def __init__(self, spark: SparkSession, path: str, segments: int = 64, compact_every: int = nb.COMPACT_EVERY):
        self.spark, self.path, self.segments, self.compact_every = spark, path.rstrip("/"), segments, compact_every

    def _table(self, name: str, schema: str) -> DataFrame:
        """All finished batches of a table; an empty one before the first."""
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema + ", batch int" + ", bucket int" * (name == "keys")).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
                raise
            return self.spark.createDataFrame([], schema + ", batch int, bucket int")

    def _write(self, df: DataFrame, name: str, batch_no: int, by: list[str] | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{self.path}/{name}/batch={batch_no}")

    def shards(self, batch_no: int) -> DataFrame:
        """Live shards of earlier batches: those no merged shard of their segment holds."""
        known = self._table("shards", SHARDS).filter(F.col("batch") < batch_no)
        spans = known.groupBy("route", "segment", "part").agg(F.max(F.when(F.col("first") < F.col("last"), F.struct("last", "first"))).alias("m"))
        live = known.join(spans, ["route", "segment", "part"])
        return live.filter(F.col("m").isNull() | (F.col("last") > F.col("m.last")) | ((F.col("last") == F.col("m.last")) & (F.col("first") == F.col("m.first")))).drop("m", "batch", "bucket")

    def accept(self, news: DataFrame, batch_no: int, known_outlets: frozenset[str] = frozenset()) -> DataFrame:
        """(id_a, id_b): the records of the batch that are an article of an earlier record, with its smallest id.

        Null and blank addresses and titles match nothing; records without id are left out. Accepting the
        same batch number again replaces what it wrote before.
        """
        base = cut(news.filter("id is not null").select("id", F.lit(batch_no).alias("batch_no"), "title", "media", nb.url_key("url").alias("url_key")))
        titles = cut(base.filter("title is not null").select("id", "batch_no", "title", "media").mapInPandas(nb._keys(known_outlets), "id long, batch_no int, title_key string").filter("title_key is not null"))
        # equal addresses and headlines: by hashes of the buckets that the batch touches
        hashes = base.filter("url_key is not null").select(F.xxhash64(F.lit("u"), "url_key").alias("h"), "id").unionByName(titles.select(F.xxhash64(F.lit("t"), "title_key").alias("h"), "id"))
        hashes = cut(hashes.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
        touched = [r["bucket"] for r in hashes.select("bucket").distinct().collect()]
        firsts = hashes.groupBy("bucket", "h").agg(F.min("id").alias("first"))
        old = self._table("keys", KEYS).filter((F.col("batch") < batch_no) & F.col("bucket").isin(touched)).join(firsts.select("bucket", "h"), ["bucket", "h"], "left_semi").groupBy("h").agg(F.min("id").alias("old"))
        equal = hashes.join(firsts, ["bucket", "h"]).join(old, "h", "left").select(F.least("first", F.coalesce("old", "first")).alias("a"), F.col("id").alias("b"), "first", "old")
        equal = equal.select("a", "b").unionByName(equal.filter("old is not null").select(F.col("old").alias("a"), F.col("first").alias("b"))).filter("a <> b").distinct()
        # nearly equal headlines: the first record of each, in the stored graphs of its segments
        signed = titles.groupBy("title_key").agg(F.min("id").alias("id"), F.min("batch_no").alias("batch_no")).mapInPandas(nb._signed, "title_key string, id long, batch_no int, bits binary, routes array<long>, rings array<long>")
        at = signed.select("id", "title_key", "bits", "rings", F.posexplode("routes").alias("route", "h")).withColumn("rings", F.slice("rings", F.col("route") * 2 + 1, 2))
        at = at.withColumn("segment", F.pmod(F.xxhash64("h", "route"), F.lit(self.segments)).cast("int")).drop("h")
        live = self.shards(batch_no)
        # a segment with far more titles than its share has parts; a title is stored in one and searched in all
        sizes = live.groupBy("route", "segment").agg(F.sum("titles").alias("have"), (F.max("part") + 1).alias("old_parts"))
        parts = at.groupBy("route", "segment").agg(F.count("*").alias("more")).join(sizes, ["route", "segment"], "left")
        want = F.ceil((F.col("more") + F.coalesce("have", F.lit(0))) / (3 * nb.SEGMENT_TITLES)).cast("int")
        parts = cut(parts.select("route", "segment", F.greatest(want, F.coalesce("old_parts", F.lit(1))).alias("parts")))
        at = at.join(parts, ["route", "segment"]).withColumn("home", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        key = ["route", "segment", "part"]
        live = live.join(parts.select("route", "segment"), ["route", "segment"], "left_semi")
        done = cut(at.groupBy(*key).cogroup(live.groupBy(*key)).applyInPandas(_segment(batch_no, self.compact_every), "kind string, a long, b long, " + SHARDS))
        near = done.filter("kind = 'link'").select("a", "b").distinct()
        changed = self._labels(equal.unionByName(near), batch_no)
        self._write(hashes.groupBy("bucket", "h").agg(F.min("id").alias("id")), "keys", batch_no, ["bucket"])
        self._write(done.filter("kind = 'shard'").select(*[x.split(" ")[0] for x in SHARDS.split(", ")]), "shards", batch_no)
        self._write(changed, "labels", batch_no)
        found = changed.join(base.select(F.col("id").alias("node")).distinct(), "node")
        return found.filter("component < node").select(F.col("component").alias("id_a"), F.col("node").alias("id_b"))

    def labels(self, batch_no: int) -> DataFrame:
        """(node, component) of all records linked before a batch."""
        return self._table("labels", LABELS).filter(F.col("batch") < batch_no).groupBy("node").agg(F.max_by("component", "version").alias("component"))

    def _labels(self, links: DataFrame, batch_no: int) -> DataFrame:
        """New and changed (node, component, version): links between articles as they stand join whole articles."""
        old = cut(self.labels(batch_no))
        of = lambda c: old.select(F.col("node").alias(c), F.col("component").alias(f"{c}_now"))
        links = cut(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("a_now", "a").alias("x"), F.coalesce("b_now", "b").alias("y")))
        merged = cut(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        ends = links.select(F.col("a").alias("node"), F.col("x").alias("was")).union(links.select("b", "y")).union(old.select("node", F.col("component")).join(merged.select(F.col("node").alias("component")), "component", "left_semi").select("node", F.col("component").alias("was")))
        new = ends.distinct().join(merged.select(F.col("node").alias("was"), "component"), "was", "left")
        return cut(new.select("node", F.coalesce("component", "was").alias("component"), F.lit(batch_no).alias("version")).distinct())
