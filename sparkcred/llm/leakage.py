"""Problem 7: evaluation texts leaking into training text.

A generalised suffix automaton of the normalised items reads every document character by character and
gives, along its suffix links, the longest match with each item at each position. Maximal matches of an item that go on along one
diagonal, with no more than a word between two of them, form a stretch; an item has leaked if a stretch
holds the required share of its text.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item in one stretch, shortest match that counts, longest altered word, least exact share of a stretch.
SHARE, LEAST_MATCH, WORD_CHARS, EXACT_SHARE = 0.5, 8, 24, 0.6
#: Items are read in blocks of at most this many characters; each block is one automaton.
BLOCK_CHARS = 2_000_000

_NOT_ALNUM = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).casefold())


def raw_positions(raw: str, text: str):
    """Function from a position of the normalised text to that of the raw character it comes from."""
    sizes = {c: len(normal(c)) for c in set(raw)}
    ends = np.cumsum([sizes[c] for c in raw])
    if len(ends) and ends[-1] == len(text):
        return lambda at: int(np.searchsorted(ends, at, "right"))
    # characters that only join with their neighbours: by the sizes of normalised beginnings
    return lambda at: bisect.bisect_right(range(len(raw) - 1), at, key=lambda i: len(normal(raw[: i + 1])))


class Automaton:
    """Generalised suffix automaton; ``items[state]`` has a bit for each text a state's strings occur in."""

    def __init__(self, texts: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.items = [-1], [0], [0]
        for n, text in enumerate(texts):
            last = 0
            for c in text:
                last = self._extend(last, c)
                self.items[last] |= 1 << n
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.items[self.link[s]] |= self.items[s]
        self.items[0] = 0
        self.levels: dict[int, list[int]] = {}

    def _new(self, length: int) -> int:
        self.next.append({}), self.link.append(0), self.length.append(length), self.items.append(0)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: str) -> int:
        s = self._new(self.length[p] + 1)
        self.next[s], self.link[s] = dict(self.next[q]), self.link[q]
        self.link[q] = s
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = s
            p = self.link[p]
        return s

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        s = self._new(self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = s
            p = self.link[p]
        if p == -1:
            self.link[s] = 0
        else:
            q = self.next[p][c]
            self.link[s] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return s

    def matches(self, text: str, least: int = LEAST_MATCH) -> list[tuple[int, int, int]]:
        """(start, end, items) of the maximal matches: they cannot be made longer on either side."""
        nxt, link, length = self.next, self.link, self.length
        out, s, n = [], 0, 0
        for i, c in enumerate(text):
            t = nxt[s].get(c)
            if t is None:
                if n >= least:
                    out.append((i - n, i, self.items[s]))
                while t is None and s:
                    s = link[s]
                    t = nxt[s].get(c)
                n = length[s]
                if t is None:
                    continue
            s = t
            n += 1
        if n >= least:
            out.append((len(text) - n, len(text), self.items[s]))
        return out

    def _levels(self, least: int) -> list[int]:
        """For each state the nearest state along its suffix links that more items hold, 0 below ``least``."""
        up = [0] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            p = self.link[s]
            if self.length[p] >= least:
                up[s] = p if self.items[p] != self.items[s] else up[p]
        return up

    def item_matches(self, text: str, least: int = LEAST_MATCH, mask: int = -1) -> list[tuple[int, int, int]]:
        """(start, end, items) of the maximal matches of each item by itself; of the items of the mask at least.

        An item whose match ends is reported there, though another item goes on; so is one that holds only
        a suffix of what another item holds.
        """
        nxt, link, length, items = self.next, self.link, self.length, self.items
        if least not in self.levels:
            self.levels[least] = self._levels(least)
        up = self.levels[least]
        out, s, n = [], 0, 0
        for i, c in enumerate(text):
            t = nxt[s].get(c)
            if n >= least and (t is None or items[t] & mask != items[s] & mask or up[s]):
                u, size, seen = s, n, 0
                while u:
                    v = nxt[u].get(c)
                    gone = items[u] & mask & ~seen if v is None else items[u] & mask & ~seen & ~items[v]
                    if gone:
                        out.append((i - size, i, gone))
                    seen, u = items[u], up[u]
                    size = length[u]
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(c)
            if t is None:
                continue
            s = t
            n += 1
        if n >= least:
            u, size, seen = s, n, 0
            while u:
                if gone := items[u] & mask & ~seen:
                    out.append((len(text) - size, len(text), gone))
                seen, u = items[u], up[u]
                size = length[u]
        return out

    def matches_of(self, text: str, k: int, least: int = LEAST_MATCH) -> list[tuple[int, int]]:
        """(start, end) of the maximal matches of item k: the walk stays in states whose strings occur in it."""
        nxt, link, length, items, mask = self.next, self.link, self.length, self.items, 1 << k
        out, s, n = [], 0, 0
        for i, c in enumerate(text):
            t = nxt[s].get(c)
            if t is None or not items[t] & mask:
                if n >= least:
                    out.append((i - n, i))
                while s:
                    s = link[s]
                    t = nxt[s].get(c)
                    if t is not None and items[t] & mask:
                        break
                n = length[s]
                if t is None or not items[t] & mask:
                    continue
            s = t
            n += 1
        if n >= least:
            out.append((len(text) - n, len(text)))
        return out


def stretches(text: str, item: str, found: list[tuple[int, int]], share: float = SHARE) -> list[tuple[int, int, float]]:
    """(start, end, share of the item) of the stretches of a document that hold enough of an item.

    Matches are chained where both the document and the item go on within one word's length.
    """
    chains: list[list[int]] = []  # document start, document end, item start, item end, exact characters
    for a, b in found:
        part = text[a:b]
        at = item.find(part)
        places = []
        while at != -1:
            places.append(at)
            at = item.find(part, at + 1)
        grown = []
        for p in places:
            best = None
            for ch in chains:
                gap_d, gap_i = a - ch[1], p - ch[3]
                over = max(0, -gap_d, -gap_i)  # matches may overlap by a few characters
                if -len(part) < gap_d <= WORD_CHARS and -len(part) < gap_i <= WORD_CHARS and abs(gap_d - gap_i) <= WORD_CHARS // 2 and over < len(part):
                    new = [ch[0], b, ch[2], p + len(part), ch[4] + len(part) - over]
                    if best is None or new[4] > best[4]:
                        best = new
            grown.append(best or [a, b, p, p + len(part), len(part)])
        chains = [ch for ch in chains if a - ch[1] <= WORD_CHARS or ch[3] - ch[2] >= share * len(item)] + grown
    out: list[tuple[int, int, float]] = []
    for ch in sorted(chains, key=lambda ch: (ch[2] - ch[3], ch[0])):
        if ch[3] - ch[2] >= share * len(item) and ch[4] >= EXACT_SHARE * (ch[3] - ch[2]) and all(ch[1] <= a or ch[0] >= b for a, b, _ in out):
            out.append((ch[0], ch[1], (ch[3] - ch[2]) / len(item)))
    return out


class Seeds:
    """Which items a document may hold, from all its character sequences of the least match length at once.

    A stretch that counts has at least ``share * EXACT_SHARE`` of its item in matches no more than a word
    apart, and every match is covered by sequences of the least length, so an item whose sequences cover less
    in any such run cannot have leaked. The rest of the items is left to the automaton.
    """

    TABLE = 1 << 22

    def __init__(self, texts: list[str], share: float = SHARE, least: int = LEAST_MATCH):
        self.least, self.n = least, len(texts)
        grams = [self.hashes(t) for t in texts]
        every = np.concatenate([*grams, np.zeros(0, "uint64")])
        order = np.argsort(every, kind="stable")
        # item and place in it of every sequence, in the order of the sequences
        self.owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams]).astype("int32")[order]
        self.place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, "int64")])[order]
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every)).astype("int64")
        low = (self.grams & np.uint64(self.TABLE - 1)).astype("int64")
        self.there = np.zeros(self.TABLE, bool)
        self.there[low] = True
        self.slot = np.zeros(self.TABLE, "int32")
        self.slot[low] = np.arange(len(low))
        self.need = np.array([share * EXACT_SHARE * len(t) for t in texts])

    def hashes(self, text: str) -> np.ndarray:
        h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out, base, have, left, at = None, 0x100000001B3, 1, self.least, 0
        # sequences of doubled lengths; those that make up the least length are put together
        while left:
            if left & 1:
                part = h[at:]
                out = part if out is None else out[: len(part)] * np.uint64(base) + part[: len(out)]
                at += have
            left >>= 1
            if left:
                h = h[:-have] * np.uint64(base) + h[have:] if len(h) > have else h[:0]
                base, have = base * base & 0xFFFFFFFFFFFFFFFF, have * 2
        return (out if len(text) >= self.least else out[:0]) * np.uint64(0xFF51AFD7ED558CCD)

    def candidates(self, docs: list[str]) -> list[tuple[int, int, int, int]]:
        """(document, item, start, end) of the runs that may count, in order; all of an item's matches there lie inside."""
        if not len(self.grams) or not docs:
            return []
        size = np.array([len(t) for t in docs], "int64") + 1
        end = np.cumsum(size)
        h = self.hashes("\0".join(docs) + "\0")
        low = (h & np.uint64(self.TABLE - 1)).astype("int64")
        at = np.flatnonzero(self.there[low])
        own, place = h[at], self.slot[low[at]].astype("int64")
        # slots that sequences share are looked up
        other = np.flatnonzero(self.grams[place] != own)
        place[other] = np.minimum(np.searchsorted(self.grams, own[other]), len(self.grams) - 1)
        ok = self.grams[place] == own
        at, place = at[ok], place[ok]
        many = self.first[place + 1] - self.first[place]
        row = np.repeat(np.arange(len(at), dtype="int32"), many)
        source = (self.first[place] - (np.cumsum(many) - many)).astype("int32")[row]
        source += np.arange(len(row), dtype="int32")
        pair = (np.searchsorted(end, at, "right") * self.n).astype("int32")[row]
        pair += self.owner[source]
        # a sequence covers at most its length, so pairs with too few are out before anything is sorted
        need = np.tile(self.need, len(docs)) - 1e-9
        n = np.bincount(pair, minlength=len(docs) * self.n)
        some = (n * self.least >= need)[pair]
        if (chains := self.chains(at, source, row, end, size)) is not None:
            some &= chains
        some = np.flatnonzero(some)
        pair, pos, source = pair[some], at.astype("int32")[row[some]], source[some]
        # in the order of pairs and positions; a batch has fewer than 2**31 characters
        low, mid = len(self.owner).bit_length(), len(h).bit_length()
        if low + mid + (len(docs) * self.n).bit_length() < 64:
            key = pair.astype("int64")
            key <<= mid
            key |= pos
            key <<= low
            key |= source
            key.sort()
            source = key & ((1 << low) - 1)
            key >>= low
            pair, pos = key >> mid, key & ((1 << mid) - 1)
        else:
            pair, pos = pair.astype("int64"), pos.astype("int64")
            order = np.argsort((pair << 32) | pos)
            pair, pos, source = pair[order], pos[order], source[order]
        if not len(pair):
            return []
        starts, held = self.covered(pair, pos, self.least + WORD_CHARS)
        good = held >= self.need[pair[starts] % self.n] - 1e-9
        # what a run covers of the item itself must be enough too
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pair))))
        some = good[run]
        key = np.sort((run[some] << 32) | self.place[source[some]])
        firsts, own = self.covered(key >> 32, key & 0xFFFFFFFF, 1 << 40)
        runs = (key >> 32)[firsts]
        good = runs[own >= self.need[pair[starts[runs]] % self.n] - 1e-9]
        last = np.append(starts[1:], len(pair))[good] - 1
        doc, at = pair[starts[good]] // self.n, end - size
        return list(zip(doc.tolist(), (pair[starts[good]] % self.n).tolist(), (pos[starts[good]] - at[doc]).tolist(), (pos[last] + self.least - at[doc]).tolist()))

    def chains(self, at: np.ndarray, source: np.ndarray, row: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        """Which sequences stand where a run may count, by counts over places as long as a run may pause; None where that is no less work.

        Neighbours in a run stand in the same place or in the next one, so a run lies in a chain of places that
        all have a sequence of its item. Every place covers no more than its sequences, and its length and a rest.
        """
        long = self.least + WORD_CHARS
        places = size // long + 2  # the last one of a document stays empty
        total = int(places.sum())
        if total * self.n > 4 * len(row) or total * self.n * (long + self.least) >= 1 << 31:
            return None
        doc = np.searchsorted(end, at, "right")
        own = (np.cumsum(places) - places)[doc] + (at - (end - size)[doc]) // long
        cell = own.astype("int32")[row]
        cell += (np.arange(self.n, dtype="int32") * np.int32(total))[self.owner][source]
        held = np.minimum(np.bincount(cell, minlength=total * self.n).astype("int32") * self.least, long + self.least - 1)
        # the items stand one after the other; an empty place ends every chain
        chain = np.cumsum(held, dtype="int32")
        chain -= np.maximum.accumulate(np.where(held == 0, chain, 0))
        enough = np.ceil(self.need - 1e-9).astype("int32")
        good, reached = np.zeros(len(held), bool), -1
        for p in np.flatnonzero(chain.reshape(self.n, total) >= np.maximum(enough, 1)[:, None]).tolist():
            if p <= reached:
                continue
            first = reached = p
            while first and held[first - 1]:
                first -= 1
            while held[reached + 1]:
                reached += 1
            good[first : reached + 1] = True
        return good[cell]

    def covered(self, group: np.ndarray, pos: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(first row, characters covered) of each run of sorted positions no further than ``most`` apart."""
        if not len(group):
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        step = np.diff(pos, prepend=pos[0])
        new = np.r_[True, (group[1:] != group[:-1]) | (step[1:] > most)]
        starts = np.flatnonzero(new)
        return starts, np.add.reduceat(np.where(new, self.least, np.minimum(step, self.least)), starts)


_built: dict[tuple, tuple[Automaton, Seeds]] = {}


def _automaton(texts: tuple[str, ...], share: float) -> tuple[Automaton, Seeds]:
    """One per worker process and block of items."""
    key = (texts, share)
    if key not in _built:
        _built.clear()
        _built[key] = (Automaton(list(texts)), Seeds(list(texts), share))
    return _built[key]


#: Characters of documents that are looked at together.
BATCH_CHARS = 400_000


def _read_block(ids: list[int], texts: list[str], share: float):
    texts = tuple(texts)

    def leaks_of(raw: str, text: str, runs: list[tuple[int, int, int]], auto: Automaton):
        places = None
        for k, first, last in runs:
            found = auto.matches_of(text[first:last], k)
            for a, b, held in stretches(text[first:last], texts[k], found, share):
                places = places or raw_positions(raw, text)
                yield ids[k], places(first + a), places(first + b - 1) + 1, held

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, seeds = _automaton(texts, share)
        for pdf in parts:
            rows, raws, norm, out, size = list(zip(pdf["doc_id"].tolist(), pdf["h"].tolist())), pdf["text"].tolist(), [], [], 0
            start = 0
            for i, raw in enumerate(raws):
                norm.append(normal(raw))
                size += len(norm[-1])
                if size < BATCH_CHARS and i + 1 < len(raws):
                    continue
                runs: dict[int, list[tuple[int, int, int]]] = {}
                for d, *at in seeds.candidates(norm):
                    runs.setdefault(d, []).append(at)
                for d, at in runs.items():
                    out += [(item, *rows[start + d], *found) for item, *found in leaks_of(raws[start + d], norm[d], at, auto)]
                start, norm, size = i + 1, [], 0
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "h", "start", "end", "share"])

    return run


def _spans(documents: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """Leaks with ``h``, the hash of the text they stand in, since ids may repeat."""
    rows = [(r.item_id, normal(r.text)) for r in items.select("item_id", "text").filter("item_id is not null and text is not null").dropDuplicates().toLocalIterator()]
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for i, t in sorted(r for r in rows if r[1]):
        if size + len(t) > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((i, t))
        size += len(t)
    docs = documents.select("doc_id", F.xxhash64("text").alias("h"), "text").filter("text is not null")
    out = None
    for block in blocks:
        one = docs.mapInPandas(_read_block([i for i, _ in block], [t for _, t in block], share), "item_id long, doc_id long, h long, start long, end long, share double")
        out = one if out is None else out.unionByName(one)
    return out


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, doc_id, start, end, share): stretches of documents that hold at least ``share`` of an item.

    Items and documents with null text, or without letters and digits, give no rows. The items are held-out
    test material of bounded size; they are read in blocks, so no block's automaton exceeds its bound.
    """
    return _spans(documents, items, share).drop("h")


def leaked_pairs(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, doc_id) of all leaks."""
    return leaks(documents, items, share).select("item_id", "doc_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, most_removed: float = 0.8) -> DataFrame:
    """(doc_id, text, n_spans): every document without its leaked spans; null text where more than ``most_removed`` would go.

    Documents without a leak keep their text, with 0 spans; null texts stay null. Repeated rows stay.
    """
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    spans = _spans(documents, items, share).select(F.xxhash64("doc_id", "h").alias("k"), "start", "end").distinct()
    spans = spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    both = docs.withColumn("k", F.xxhash64("doc_id", "h")).join(spans, "k", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, counts = [], []
            for text, sp in zip(pdf["text"], pdf["spans"]):
                kept, at, n = [], 0, 0
                for s in sp:
                    kept.append(text[at : max(at, s["start"])])
                    at, n = max(at, s["end"]), n + 1
                rest = "".join(kept) + text[at:]
                texts.append(rest if len(rest) >= (1 - most_removed) * len(text) else None)
                counts.append(n)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pd.Series(texts, dtype=object), "n_spans": counts})

    cleaned = both.filter("spans is not null").select("doc_id", "text", "spans").mapInPandas(run, "doc_id long, text string, n_spans int")
    return cleaned.unionByName(both.filter("spans is null").select("doc_id", "text", F.lit(0).alias("n_spans")))
