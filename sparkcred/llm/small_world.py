"""Navigable small-world graphs over bit vectors, built and searched for many rows at once with numpy."""

from __future__ import annotations

import numpy as np

NEAR, BACK, LONG = 6, 8, 2
#: Shards of up to this many nodes, as many as tuning compares with all others, are always compared as a whole.
FEW = 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits along the last axis."""
    one = np.bitwise_count(a ^ b)
    if one.shape[-1] != 4:
        return one.sum(axis=-1, dtype="int16")
    # four counts at once in the lanes of a word
    v = np.ascontiguousarray(one).view("uint32")[..., 0]
    v = (v & np.uint32(0x00FF00FF)) + ((v >> np.uint32(8)) & np.uint32(0x00FF00FF))
    return ((v + (v >> np.uint32(16))) & np.uint32(0xFFFF)).astype("int16")


class SmallWorld:
    """Graph of one shard over bit vectors.

    A node keeps links to the nearest nodes found at its insertion, links back from later nodes, two links
    along the order of each of its hashes ([n, rings]), and two random far ones. Searches enter at the nodes
    next to the query in the order of each hash and at a few spread over the shard.
    """

    def __init__(self, bits: np.ndarray, hashes: np.ndarray, beam: int = 8):
        self.bits, self.beam, self.size, self.exact = np.ascontiguousarray(bits), beam, 0, len(bits) <= FEW
        n, rings = hashes.shape
        self.links = np.full((n, NEAR + BACK + 2 * rings + LONG), -1, "int32")
        self.rng = np.random.default_rng(n)
        self.orders = [np.argsort(hashes[:, k], kind="stable").astype("int32") for k in range(rings)]
        self.hashes = [hashes[o, k] for k, o in enumerate(self.orders)]
        if n > 1:
            for k, o in enumerate(self.orders):
                self.links[o[1:], NEAR + BACK + 2 * k], self.links[o[:-1], NEAR + BACK + 2 * k + 1] = o[:-1], o[1:]
            self.links[:, -LONG:] = self.rng.integers(0, n, (n, LONG))
        step = 256
        while self.size < n and not self.exact:
            self._insert(min(step, n - self.size), hashes)
            step = max(256, self.size)
        self._tidy()

    def _tidy(self) -> None:
        """Leave one of equal links in each row."""
        links = np.sort(self.links, axis=1)
        links[:, 1:][links[:, 1:] == links[:, :-1]] = -1
        self.final = links

    def _insert(self, m: int, hashes: np.ndarray) -> None:
        """Connect the next rows; ring and far links let their searches pass through rows not connected yet."""
        new = np.arange(self.size, self.size + m)
        self.final = self.links
        found, dist = self.search(self.bits[new], self.beam, hashes[new])
        found = np.where(found == new[:, None], -1, found)
        order = np.argsort(np.where(found < 0, 1 << 14, dist), axis=1, kind="stable")[:, :NEAR]
        near = np.take_along_axis(found, order, 1)
        self.links[new, : near.shape[1]] = near
        src, dst = np.repeat(new, near.shape[1]), near.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, int)
        rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.r_[first, len(dst)]))
        slot = (self.links[dst, NEAR : NEAR + BACK] >= 0).sum(axis=1) + rank if len(dst) else rank
        full = slot >= BACK
        slot[full] = self.rng.integers(0, BACK, int(full.sum()))
        self.links[dst, NEAR + slot] = src
        self.size += m

    def search(self, q: np.ndarray, beam: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) [queries, beam], nearest first; -1 where there are fewer."""
        out_i, out_d = [], []
        for s in range(0, len(q), 2048):
            i, d = self._search(q[s : s + 2048], min(beam, max(1, len(self.bits))), hashes[s : s + 2048])
            out_i.append(i), out_d.append(d)
        return np.concatenate(out_i), np.concatenate(out_d)

    def _entries(self, hashes: np.ndarray, beam: int) -> np.ndarray:
        n, side = len(self.bits), max(2, beam // 4)
        reach = np.arange(-side, side)[None]
        near = [o[np.clip(np.searchsorted(h, hashes[:, k])[:, None] + reach, 0, n - 1)] for k, (o, h) in enumerate(zip(self.orders, self.hashes))]
        spread = np.linspace(0, n - 1, min(n, 4)).astype("int32")
        out = np.sort(np.concatenate([*near, np.broadcast_to(spread, (len(hashes), len(spread)))], 1), axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        return out

    def _search(self, q: np.ndarray, beam: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.int16(1 << 14)
        ids, dist = np.full((len(q), beam), -1, "int32"), np.full((len(q), beam), far)
        starts = self._entries(hashes, beam)
        d = np.where(starts < 0, far, distances(q[:, None], self.bits[np.maximum(starts, 0)]))
        best = np.argsort(d, axis=1, kind="stable")[:, :beam]
        ids[:, : best.shape[1]], dist[:, : best.shape[1]] = np.take_along_axis(starts, best, 1), np.take_along_axis(d, best, 1)
        todo = ids >= 0  # beam entries not expanded yet
        live = np.arange(len(q))
        while len(live):
            # a query expands its nearest entry until none is left
            pick = np.where(todo[live], dist[live], far).argmin(axis=1)
            has = todo[live, pick]
            live, pick = live[has], pick[has]
            if not len(live):
                break
            todo[live, pick] = False
            nb = self.final[ids[live, pick]]
            dn = distances(q[live][:, None], self.bits[np.maximum(nb, 0)])
            dn = np.where((nb < 0) | (dn >= dist[live][:, -1:]), far, dn)
            hot = np.flatnonzero((dn < far).any(axis=1))
            if not len(hot):
                continue
            rows, nb, dn = live[hot], nb[hot], dn[hot]
            dn[(nb[:, :, None] == ids[rows][:, None, :]).any(axis=2)] = far
            all_i, all_d = np.concatenate([ids[rows], nb], 1), np.concatenate([dist[rows], dn], 1)
            all_t = np.concatenate([todo[rows], dn < far], 1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            i, d, t = (np.take_along_axis(x, keep, 1) for x in (all_i, all_d, all_t))
            ids[rows], dist[rows], todo[rows] = np.where(d >= far, -1, i), d, t & (d < far)
        return ids, dist

    def within(self, q: np.ndarray, radius: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, nodes) within the radius; exact for queries whose beam may have left some out."""
        out, rest = [], np.arange(len(q))
        if not self.exact:
            found, dist = self.search(q, self.beam, hashes)
            full = self.overfull(found, dist, radius)
            x, y = np.nonzero((found >= 0) & (dist <= radius) & ~full[:, None])
            out, rest = [(x, found[x, y])], np.flatnonzero(full)
        block = max(1, (1 << 16) // max(1, len(self.bits)))
        for i in range(0, len(rest), block):
            x, y = np.nonzero(distances(q[rest[i : i + block]][:, None], self.bits[None]) <= radius)
            out.append((rest[i + x], y))
        none = np.zeros(0, "int64")
        return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(y for _, y in out)])

    def overfull(self, found: np.ndarray, dist: np.ndarray, radius: int) -> np.ndarray:
        """Queries to be compared with the whole shard: their beam ends within the radius, or beams are too narrow here."""
        return np.full(len(found), True) if self.exact else (found[:, -1] >= 0) & (dist[:, -1] <= radius)

    def tune(self, hashes: np.ndarray, radius: int, sample: int = FEW, recall: float = 0.92, most: int = 128) -> int:
        """Widen the beam until searches from a sample of nodes find what an exhaustive search finds within the radius.

        All neighbours count. Queries that ``within`` compares with the whole shard are left out; if the widest
        beam is still below the recall, all of them are. A title is searched in several segments, so the share
        found by all of them together is far higher.
        """
        n = len(self.bits)
        if self.exact:
            return self.beam
        at = np.unique(np.linspace(0, n - 1, min(sample, n)).astype(int))
        near = [np.flatnonzero(distances(self.bits[i][None], self.bits) <= radius) for i in at]
        while True:
            ids, dist = self.search(self.bits[at], self.beam, hashes[at])
            beam = [(x, i) for x, i, full in zip(near, ids, self.overfull(ids, dist, radius)) if not full]
            if sum(np.isin(x, i).sum() for x, i in beam) >= recall * sum(len(x) for x, _ in beam):
                break
            if self.beam >= most:
                self.exact = True
                break
            self.beam *= 2
        return self.beam
