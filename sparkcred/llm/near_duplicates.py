"""Problem 3: near-duplicate records with small edits.

Bodies are sets of distinct five-character sequences. Each set is folded into a 1024-bit map. For two
sets, the bits in which their maps differ number at most the size of the symmetric difference, and a
similarity of s means a symmetric difference of at most (1 - s) / (1 + s) of both sizes together. So
exclusive-or and a bit count reject pairs without ever losing one, and so does the difference of two
population counts, which skips whole tiles of sorted rows. What is left is compared exactly.

Which rows meet in a tile is decided by banded min-hashes (40 bands of 4): a pair with similarity 0.6
misses all of them with probability 0.4 %, one with 0.7 with 1e-5. Copies with equal text are one class
from the start and take part once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.llm.components import components
from sparkcred.llm.pages import Marker, Memo, pages_of
from sparkcred.session import cut

SIMILARITY, LEAST_CHARS, GRAM = 0.6, 150, 5
BITS, BANDS, ROWS = 1024, 40, 4
#: Rows of one tile; a bucket with more rows is cut into tiles that meet pair by pair in separate cells.
TILE = 256

_rng = np.random.default_rng(20240101)
_A = (_rng.integers(1, 1 << 31, BANDS * ROWS, dtype="int64") * 2 + 1).astype("uint32")
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype="int64").astype("uint32")
_NOT_ALNUM = re.compile(r"[\W_]+")


def alnum(text: str) -> str:
    """Letters and digits only, ignoring case and character width."""
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).casefold())


def _hashes(text: str) -> np.ndarray:
    """Hashes of all five-character sequences of a text of at least five characters, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    h = c[: len(c) - GRAM + 1].copy()
    for k in range(1, GRAM):
        h *= np.uint64(0x100000001B3)
        h += c[k : len(c) - GRAM + 1 + k]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def grams(text: str) -> np.ndarray:
    """Distinct hashes of the five-character sequences of a normalised text, sorted."""
    if len(text) < GRAM:
        return np.zeros(0, "uint64")
    h = _hashes(text)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def bitmap(g: np.ndarray) -> bytes:
    bits = np.zeros(BITS, "uint8")
    bits[(g & np.uint64(BITS - 1)).astype("int64")] = 1
    return np.packbits(bits).tobytes()


def _least(x: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """Min-hashes of a set given by 32-bit hashes; repeated ones change nothing."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, "uint32")
    for i in range(0, len(x), len(buffer)):
        c = x[i : i + len(buffer), None]
        h = np.multiply(c, _A, out=buffer[: len(c)])
        h += _B
        np.minimum(least, h.min(axis=0), out=least)
    return least


#: Texts whose signatures are made together.
TEXTS_AT_ONCE = 512


def signatures_of(texts: list[str]) -> list[tuple[bytes, int, int, list[int]]]:
    """(bit map, its population count, number of distinct sequences, bands) of normalised texts of at least five characters."""
    out = []
    buffer = np.empty((256, BANDS * ROWS), "uint32")
    salt = np.arange(1, BANDS + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    for s in range(0, len(texts), TEXTS_AT_ONCE):
        some = texts[s : s + TEXTS_AT_ONCE]
        every = _hashes("".join(some))
        size = np.array([len(t) for t in some])
        starts = np.cumsum(size) - size
        bits, least, sizes = np.zeros((len(some), BITS), "uint8"), np.empty((len(some), BANDS * ROWS), "uint32"), []
        place, high = (every & np.uint64(BITS - 1)).astype("int64"), (every >> np.uint64(32)).astype("uint32")
        for n, (at, end) in enumerate(zip(starts.tolist(), (starts + size - GRAM + 1).tolist())):
            bits[n, place[at:end]] = 1
            least[n] = _least(high[at:end], buffer)
            g = np.sort(every[at:end])
            sizes.append(1 + int(np.count_nonzero(g[1:] != g[:-1])))
        m = least.reshape(len(some), BANDS, ROWS).astype("uint64")
        h = np.broadcast_to(salt, m.shape[:2])
        for k in range(ROWS):
            h = (h ^ m[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        out += zip(map(bytes, np.packbits(bits, axis=1)), bits.sum(axis=1, dtype="int64").tolist(), sizes, h.view("int64").tolist())
    return out


def signatures(news: DataFrame) -> DataFrame:
    """(id, text_key, text, bits, pop, size, bands) of every record whose body is long enough."""
    pages = pages_of(news).filter("content is not null and id is not null")
    marker = Marker(pages)

    def make(model):
        def row(row, lines, marks):
            text = alnum("".join(x for x, m in zip(lines, marks) if m == 0))
            if len(text) >= LEAST_CHARS:
                yield row.id, text

        return row

    def signed(rows):
        coded = [t.encode("utf-8", "surrogatepass") for _, t in rows]
        return [(i, hashlib.md5(c).digest(), c, *s) for (i, _), c, s in zip(rows, coded, signatures_of([t for _, t in rows]))]

    return marker.apply(pages, make, "id long, text_key binary, text binary, bits binary, pop int, size int, bands array<long>", signed)


def tile_pairs(ids: np.ndarray, bits: np.ndarray, pop: np.ndarray, size: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one cell within the radius. side 0: one tile against itself, 1 and 2: two tiles."""
    share = (1 - similarity) / (1 + similarity)
    order = np.argsort(pop, kind="stable")
    ids, bits, pop, size, side = ids[order], bits[order], pop[order], size[order], side[order]
    out, step = [], 64
    for i in range(0, len(ids), step):
        a = slice(i, min(i + step, len(ids)))
        # partners beyond this population count cannot be within the radius of any row of the tile
        reach = pop[a].max() + share * size[a].max() * (1 + 1 / similarity)
        for j in range(i, int(np.searchsorted(pop, reach, "right")), step):
            b = slice(j, min(j + step, len(ids)))
            apart = np.bitwise_count(bits[a][:, None, :] ^ bits[b][None, :, :]).sum(axis=2, dtype="int32")
            near = apart <= share * (size[a][:, None] + size[b][None, :]) + 1e-9
            if i == j:
                near &= np.triu(np.ones(near.shape, bool), 1)
            near &= (side[a][:, None] != side[b][None, :]) | (side[a][:, None] == 0)
            x, y = np.nonzero(near)
            if len(x):
                out.append((ids[a][x], ids[b][y]))
    return out


def _cells(similarity: float):
    cols = ["band", "i", "j"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, pop, size, side = (pdf[c].to_numpy() for c in ("id", "pop", "size", "side"))
            bits = np.frombuffer(b"".join(pdf["bits"]), "uint64").reshape(len(pdf), BITS // 64)
            new = np.flatnonzero((pdf[cols].to_numpy()[1:] != pdf[cols].to_numpy()[:-1]).any(axis=1)) + 1
            out = [p for s, e in zip([0, *new], [*new, len(pdf)]) for p in tile_pairs(ids[s:e], bits[s:e], pop[s:e], size[s:e], side[s:e], similarity)]
            a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, "int64")
            b = np.concatenate([y for _, y in out]) if out else np.zeros(0, "int64")
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf[cols] == pdf[cols].iloc[-1]).all(axis=1) if len(pdf) else None
            cut_at = int(last.to_numpy().argmax()) if len(pdf) else 0
            if cut_at:
                yield pairs(pdf.iloc[:cut_at].reset_index(drop=True))
            rest = pdf.iloc[cut_at:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield pairs(rest)

    return run


def _tiles(tile: int):
    """Tiles of the buckets of several rows, one row each, from rows in the order of their band.

    ``who`` names the members of the bucket: buckets with equal members have equal tiles.
    """

    def buckets(ids: np.ndarray, band: np.ndarray, starts: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        mixed = ids.view("uint64") * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
        who = np.add.reduceat(mixed, starts).view("int64") if len(starts) else starts
        out = []
        for k in np.flatnonzero(n > 1).tolist():
            at, m = starts[k], int(n[k])
            own, tiles = ids[at : at + m], -(-m // tile)
            t = mixed[at : at + m] % np.uint64(tiles)
            out += [(m, who[k], int(x), tiles, band[at], own[t == x] if tiles > 1 else own) for x in (np.unique(t) if tiles > 1 else (0,))]
        return pd.DataFrame(out, columns=["n", "who", "t", "tiles", "band", "ids"]).astype({"n": "int32", "who": "int64", "t": "int32", "tiles": "int32", "band": "int64"})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # the bucket that may go on in the next batch
        at = None
        for pdf in parts:
            ids, band = pdf["id"].to_numpy("int64"), pdf["band"].to_numpy("int64")
            if not len(ids):
                continue
            if held and band[-1] == at:
                held.append(ids)
                continue
            starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            if held:
                size = sum(map(len, held))
                ids, band = np.concatenate([*held, ids]), np.concatenate([np.full(size, at), band])
                starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            held, at = [ids[starts[-1] :]], band[-1]
            if len(starts) > 1:
                yield buckets(ids[: starts[-1]], band, starts[:-1], np.diff(starts))
        if held:
            ids = np.concatenate(held)
            yield buckets(ids, np.full(len(ids), at), np.zeros(1, "int64"), np.array([len(ids)]))

    return run


def _exact(similarity: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(lambda t: grams(t.decode("utf-8", "surrogatepass")), 20_000)
        for pdf in parts:
            sims = []
            for ta, tb in zip(pdf["ta"], pdf["tb"]):
                x, y = memo[ta], memo[tb]
                z = np.concatenate([x, y])
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                sims.append(both / max(1, len(x) + len(y) - both))
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": sims})
            yield out[out["similarity"] >= similarity]

    return run


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links) of signatures: (id, rep) per record, (a, b, similarity) between the representatives of different texts."""
    docs = cut(docs)
    members = docs.groupBy("text_key").agg(F.min("id").alias("rep")).join(docs.select("id", "text_key"), "text_key").select("id", "rep").distinct()
    sigs = cut(docs.groupBy("text_key").agg(F.min("id").alias("id"), F.first(F.struct("bits", "pop", "size", "bands")).alias("s")).select("id", "s.bits", "s.pop", "s.size", "s.bands"))
    # one shuffle of the bands; buckets with equal members need one comparison
    in_band = sigs.select("id", F.explode("bands").alias("band")).repartition("band").sortWithinPartitions("band")
    tiles = in_band.mapInPandas(_tiles(TILE), "n int, who long, t int, tiles int, band long, ids array<long>")
    tiles = tiles.groupBy("n", "who", "t").agg(F.min("band").alias("band"), F.first("tiles").alias("tiles"), F.first("ids").alias("ids"))
    cells = tiles.withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)")))
    side = F.when(F.col("t") == F.col("o"), 0).when(F.col("t") < F.col("o"), 1).otherwise(2)
    cells = cells.select("band", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), side.alias("side"), F.explode("ids").alias("id"))
    rows = cells.join(sigs.select("id", "bits", "pop", "size"), "id")
    near = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(_cells(similarity), "a long, b long").distinct()
    near = cut(near)
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    texts = docs.select("id", "text").join(ids, "id", "left_semi").dropDuplicates(["id"])
    pairs = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return members, pairs.select("a", "b", "ta", "tb").mapInPandas(_exact(similarity), "a long, b long, similarity double")


def near_pairs(news: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records with similar bodies, copies included.

    Records without id or with null content, and bodies under 150 letters and digits, are in no pair.
    """
    members, links = similar_classes(signatures(news), similarity)
    members = cut(members)
    a, b = (members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(x)) for x in "ab")
    across = links.select("a", "b").join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    copies = a.join(b.withColumnRenamed("b", "a"), "a").filter("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(copies).distinct()


def near_groups(news: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, group_id, n_links): one row per record with a body long enough; n_links counts similar different texts."""
    members, links = similar_classes(signatures(news), similarity)
    members, links = cut(members), cut(links.select("a", "b"))
    found = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
