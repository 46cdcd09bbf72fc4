"""Problem 5: lines repeated across one source's documents.

Each record is a sequence of line identifiers, and every line of it starts a suffix. The suffixes of all
records stand in one global order, source first: a distributed suffix array, cut into ranges of equal size
with a hash of the record as last key, so a line in a third of all records fills many ranges and not one
task. Neighbours' common prefixes give the intervals of repeated blocks; an interval that goes on beyond
its range is summed over the ranges it touches. A line is deleted if its suffix starts with a block that
spans enough records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.session import cut

#: A block is excessive from this many records of its media on.
LEAST_RECORDS = 8
#: Lines of a suffix that are compared; longer blocks are covered by overlapping ones, so no line is lost.
BLOCK_LINES = 16


def line_ids(news: DataFrame) -> DataFrame:
    """(id, h, media, ids): per record the 64-bit identifiers of its lines, null for lines without letters.

    A line's identity is its letters alone, ignoring case. ``h`` stands for media and content.
    """
    letters = lambda x: F.lower(F.upper(F.regexp_replace(x, r"[^\p{L}]+", "")))
    ids = F.transform(F.split("content", "\n", -1), lambda x: F.when(letters(x) != "", F.xxhash64(letters(x))))
    media = F.trim("media")
    return news.filter(F.col("content").isNotNull() & (media != "")).select("id", F.xxhash64("media", "content").alias("h"), media.alias("media"), ids.alias("ids"))


def fresh_from(line: list[int]) -> list[int]:
    """For each suffix the longest prefix it shares with an earlier suffix of its record; longer prefixes count the record anew."""
    out = [0] * len(line)
    if len(set(line)) < len(line):
        for i in range(len(line)):
            for j in range(i):
                if line[i] == line[j]:
                    k = 1
                    while k < BLOCK_LINES and i + k < len(line) and line[i + k] == line[j + k]:
                        k += 1
                    out[i] = max(out[i], k)
    return out


def _suffixes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        ids, hs, ats, lines, shared = [], [], [], [], []
        for i, h, source, line in zip(pdf["id"], pdf["h"], pdf["source"], pdf["ids"]):
            at = np.flatnonzero(~pd.isna(line))
            own = [source, *(int(line[k]) for k in at)]
            ids += [i] * len(at)
            hs += [h] * len(at)
            ats.append(at)
            lines += [own[:1] + own[k : k + BLOCK_LINES] for k in range(1, len(own))]
            shared += fresh_from(own[1:])
        at = np.concatenate([*ats, np.zeros(0, "int64")]).astype("int32")
        yield pd.DataFrame({"id": pd.array(ids, "Int64"), "h": np.array(hs, "int64"), "at": at, "suffix": pd.Series(lines, dtype=object), "shared": np.array(shared, "int32")})


class Range:
    """One range of the suffix array: rows in order, block counts per depth."""

    def __init__(self, suffix: list, shared: np.ndarray):
        size = np.array([len(x) for x in suffix], "int64")
        self.n, self.depths = len(size), int(size.max()) - 1 if len(size) else 0
        self.rows = np.zeros((self.n, self.depths + 1), "int64")
        if self.n:
            self.rows[np.arange(self.depths + 1)[None] < size[:, None]] = np.concatenate(suffix)
        self.size, self.shared = size - 1, shared
        both = np.minimum(size[1:], size[:-1]) if self.n else size
        same = (self.rows[1:] == self.rows[:-1]) & (np.arange(self.depths + 1)[None] < both[:, None])
        self.lcp = np.cumprod(same, axis=1).sum(axis=1) - 1 if self.n else size

    def intervals(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first rows, records) of the runs of suffixes that share a block of so many lines; rows shorter than it are runs of 0."""
        first = np.flatnonzero(np.r_[True, self.lcp < depth])
        return first, np.add.reduceat(((self.size >= depth) & (self.shared < depth)).astype("int64"), first)

    def block(self, row: int, depth: int) -> tuple[int, ...]:
        """Source and lines."""
        return tuple(self.rows[row, : depth + 1].tolist())

    def edges(self) -> Iterator[tuple[tuple[int, ...], int]]:
        """Blocks of the first and last row, which may go on in other ranges, with their records here."""
        for depth in range(1, self.depths + 1):
            first, n = self.intervals(depth)
            for k in {0, len(first) - 1}:
                if n[k] or self.size[first[k]] >= depth:
                    yield self.block(first[k], depth), int(n[k])

    def counted(self, edges: dict[tuple[int, ...], int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, first rows, records) with the sums over all ranges."""
        for depth in range(1, self.depths + 1):
            first, n = self.intervals(depth)
            for k in {0, len(first) - 1}:
                n[k] = edges.get(self.block(first[k], depth), n[k]) if self.size[first[k]] >= depth else 0
            yield depth, first, n

    def reach(self, edges: dict, least: int) -> np.ndarray:
        """For each row the lines of the longest block of enough records its suffix starts with."""
        out = np.zeros(self.n, "int32")
        for depth, first, n in self.counted(edges):
            often = np.repeat(n >= least, np.diff(np.append(first, self.n)))
            out[often & (self.size >= depth)] = depth
        return out

    def blocks(self, edges: dict, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Blocks of enough records that do not go on alike in all their occurrences here."""
        for depth, first, n in self.counted(edges):
            last = np.append(first[1:], self.n) - 1
            for k in np.flatnonzero(n >= least):
                inner = self.lcp[first[k] : last[k]]
                if (self.size[first[k]] == depth) or (inner == depth).any() or first[k] == last[k] and depth == self.size[first[k]]:
                    yield self.block(first[k], depth), int(n[k])


def _ranges(make, columns: list[str]):
    """Apply ``make(pdf, Range)`` to each partition of the suffix array as a whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [p for p in parts if len(p)]
        if every:
            pdf = pd.concat(every, ignore_index=True)
            yield pd.DataFrame(make(pdf, Range(pdf["suffix"].tolist(), pdf["shared"].to_numpy())), columns=columns)

    return run


class SuffixArray:
    """The suffixes of all records in order, and the records of the blocks that cross ranges.

    Per range at most two blocks a depth reach the driver.
    """

    def __init__(self, docs: DataFrame):
        rows = docs.select("id", "h", F.xxhash64("media").alias("source"), "ids").mapInPandas(_suffixes, "id long, h long, at int, suffix array<long>, shared int")
        order = [F.col("suffix"), F.xxhash64("id", "at")]
        self.rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
        edges = self.rows.select("suffix", "shared").mapInPandas(_ranges(lambda _, r: [(list(b), n) for b, n in r.edges()], ["block", "n"]), "block array<long>, n long")
        self.edges: dict[tuple[int, ...], int] = {}
        for r in edges.collect():
            self.edges[tuple(r["block"])] = self.edges.get(tuple(r["block"]), 0) + r["n"]

    def marks(self, least: int) -> DataFrame:
        """(id, h, at, reach): lines that start a block of enough records, with its length."""
        edges = self.edges

        def make(pdf: pd.DataFrame, r: Range) -> pd.DataFrame:
            reach = r.reach(edges, least)
            return pdf.assign(reach=reach)[reach > 0]

        cols = ["id", "h", "at", "reach"]
        return self.rows.mapInPandas(_ranges(make, cols), "id long, h long, at int, reach int")

    def blocks(self, least: int) -> DataFrame:
        """(source, block, records), each block once."""
        edges = self.edges
        found = self.rows.select("suffix", "shared").mapInPandas(_ranges(lambda _, r: [(b[0], list(b[1:]), n) for b, n in r.blocks(edges, least)], ["source", "block", "records"]), "source long, block array<long>, records long")
        return found.distinct()


def repeated_blocks(news: DataFrame, least: int = LEAST_RECORDS) -> DataFrame:
    """(media, block, records): blocks of line identifiers repeated in at least ``least`` records of a media.

    Blocks of more than BLOCK_LINES lines are reported by their first lines. Records with null or blank
    media or null content have none.
    """
    docs = line_ids(news)
    names = docs.select("media").distinct().select("media", F.xxhash64("media").alias("source"))
    return SuffixArray(docs).blocks(least).join(names, "source").select("media", "block", "records")


def repeated_lines(news: DataFrame, least: int = LEAST_RECORDS) -> DataFrame:
    """(id, line_no): lines that stand in a block repeated in at least ``least`` records of their media.

    A block may be a single line. Records with null or blank media or null content, and lines without
    letters, give no rows; repeated rows are records of their own.
    """
    return SuffixArray(line_ids(news)).marks(least).select("id", (F.col("at") + 1).alias("line_no"))


def without_repeated(news: DataFrame, least: int = LEAST_RECORDS) -> DataFrame:
    """(id, content, n_removed, n_blocks): each record with media or without, its repeated blocks deleted.

    Null content stays null; records without media keep their content.
    """
    lines = F.split("content", "\n", -1)
    # a block that goes on with the next line is one with it; equal records of a media have equal marks
    marks = SuffixArray(line_ids(news)).marks(least).select("h", "at", "reach").distinct()
    found = marks.groupBy("h").agg(F.collect_list("at").alias("at"), F.count(F.when(F.col("reach") == 1, 1)).cast("int").alias("n_blocks"))
    rows = news.select("id", "content", F.when(F.trim("media") != "", F.xxhash64("media", "content")).alias("h"))
    return rows.join(found, "h", "left").select(
        "id",
        F.when(F.col("at").isNull(), F.col("content")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("at", i.cast("int"))), "\n")).alias("content"),
        F.coalesce(F.size("at"), F.lit(0)).alias("n_removed"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )
