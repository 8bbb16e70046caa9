"""SimHash fingerprints of sets, and links of those that may be alike, from an inverted index of byte positions.

At a Jaccard similarity of 0.8 about 10 of 64 bits differ, too many for one fingerprint: a set has so many fingerprints
that, but for a probability of ``MISS``, a pair at the similarity shares two bytes in place in at least one of them. The
index lists sets by each pair of byte positions of each fingerprint. The shared positional bytes of two sets of one list
are then tallied over all fingerprints, and their differing bits counted.

Sets at a similarity have sizes in proportion, so they are dealt by classes of sizes, each class with the next; the lists
are made inside a class. A class of more than ``BLOCK`` sets is dealt by blocks, each block with each.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import giving_back, mix, shuffle_parts

#: Share of pairs just at the similarity that may share no list.
MISS = 1e-5
#: Sets of a block: a task holds two blocks of one class at a time.
BLOCK = 1 << 18
#: Lists of up to so many sets are compared pair by pair, longer ones by components.
SHORT = 64
#: Fingerprints that are compared before all others are.
FIRST = 3
#: Sizes for which bits are counted exactly; larger sets lie below the last of them.
_SIZES = 64


def near(a: np.ndarray, b: np.ndarray, shared: int, max_bits: int | np.ndarray) -> np.ndarray:
    """Count filtering of aligned or broadcast fingerprints (last axis: words): shared positional bytes first, then
    differing bits."""
    x = np.ascontiguousarray(a ^ b).view(np.uint64)
    out = (x.view(np.uint8) == 0).sum(-1, dtype=np.uint16) >= shared
    out[out] = np.bitwise_count(x[out]).sum(-1, dtype=np.int64) <= (max_bits[out] if isinstance(max_bits, np.ndarray) else max_bits)
    return out


def bits(hashes: np.ndarray, width: int) -> np.ndarray:
    """``width`` fingerprints of a set of hashes: a bit is 1 if it is set in over half of them, or of them mixed anew."""
    k = np.arange(width, dtype=np.uint64)
    counts = np.zeros(64 * width, np.int64)
    for at in range(0, len(hashes), 255):
        h = hashes[at : at + 255, None] * (2 * k + np.uint64(1)) + k
        mix(h[:, 1:])
        # sums of at most 255 bits, eight in a word
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").view(np.uint64).sum(0, dtype=np.uint64).view(np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def _differing(both: int, a: int, b: int) -> float:
    """Probability that a bit differs between sets that share ``both`` members and have ``a`` and ``b`` more."""

    def one(more: int, size: int) -> np.ndarray:  # by the number of shared members that have the bit
        tails = np.cumsum([math.comb(more, k) / 2**more for k in range(more, -1, -1)])[::-1]
        need = size // 2 + 1 - np.arange(both + 1)
        return np.where(need <= 0, 1.0, np.where(need > more, 0.0, tails[np.clip(need, 0, more)]))

    p, q = one(a, both + a), one(b, both + b)
    return float(np.dot([math.comb(both, k) / 2**both for k in range(both + 1)], p * (1 - q) + q * (1 - p)))


@lru_cache
def differing_at(similarity: float) -> np.ndarray:
    """By the size of the larger set, the greatest probability that a bit differs between two sets at the similarity. The
    last entry is for all larger sets: beyond small sizes, whose ties matter, it falls towards its limit."""
    limit = math.acos(2 * similarity / (1 + similarity)) / math.pi
    out = np.zeros(_SIZES + 1)
    for n in range(1, _SIZES + 1):
        for m in range(math.ceil(similarity * n - 1e-9), n + 1):
            both = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            if both <= m:
                out[n] = max(out[n], _differing(both, n - both, m - both))
    out[_SIZES] = max(limit, out[_SIZES // 2 :].max())
    return out


def width_at(similarity: float, miss: float = MISS) -> int:
    """Fingerprints of which, at this similarity, at least one shares two bytes in place, but for this probability."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity is above 0 and at most 1")
    byte = (1 - differing_at(similarity).max()) ** 8
    alone = (1 - byte) ** 8 + 8 * byte * (1 - byte) ** 7
    return max(8, math.ceil(math.log(miss) / math.log(alone))) if alone > 0 else 8


def _most(n: int, p: float, miss: float) -> int:
    """Of ``n`` trials at ``p``, more succeed only with a probability of ``miss``."""
    above = 0.0
    for k in range(n, -1, -1):
        above += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) if 0 < p < 1 else 0.0
        if above > miss:
            return k
    return 0


@lru_cache
def bounds_at(similarity: float) -> tuple[int, np.ndarray, int]:
    """Shared bytes at least; differing bits at most, by the larger size; and those of the fingerprints compared first. A pair at the similarity fails them with a probability of some ten-thousandths of ``MISS``."""
    width, p, miss = width_at(similarity), differing_at(similarity), MISS / 1e4
    shared = 8 * width - _most(8 * width, 1 - (1 - p.max()) ** 8, miss)
    return max(shared, 2), np.array([_most(64 * width, x, miss) for x in p]), _most(64 * min(FIRST, width), p.max(), miss)


def fingerprint_matrix(column: pa.Array) -> np.ndarray:
    """Binaries of one length as the rows of a matrix of bytes."""
    flat = column.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(flat), -1)


class _Class:
    """Sets of one class, and the components of those found near so far."""

    def __init__(self, fps: np.ndarray, sizes: np.ndarray, own: np.ndarray, similarity: float):
        self.fps, self.sizes, self.own, self.similarity = fps, sizes, own, similarity
        self.shared, self.most, self.most_first = bounds_at(similarity)
        self.words = np.ascontiguousarray(fps.T)
        self.roots, self.links = np.arange(len(fps)), []

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of sets, aligned, are near."""
        small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        # sets of the lower class meet each other elsewhere
        at = np.flatnonzero((small >= self.similarity * large - 1e-6) & (self.own[a] | self.own[b]))
        out = np.zeros(len(small), bool)
        out[at] = near(self.fps[a[at]], self.fps[b[at]], self.shared, self.most[np.minimum(large[at], _SIZES)])
        return out

    def short_lists(self, rows: np.ndarray, lists: np.ndarray, first: int) -> list[tuple[int, int]]:
        """Links of rows whose lists, numbered, lie one after another. Most pairs fail already by some fingerprints."""
        width = self.fps.shape[1]
        some = [self.words[(first + k) % width][rows] for k in range(min(FIRST, width))]
        at, out = np.arange(len(rows)), []
        for lag in range(1, SHORT):
            at = at[: np.searchsorted(at, len(rows) - lag)]
            at = at[lists[at] == lists[at + lag]]
            if not len(at):
                break
            close = [part[sum(np.bitwise_count(f[part] ^ f[part + lag]) for f in some) <= self.most_first] for part in np.split(at, range(1 << 16, len(at), 1 << 16))]
            a = np.concatenate(close)
            a, b = rows[a], rows[a + lag]
            open_ = self.roots[a] != self.roots[b]
            a, b = a[open_], b[open_]
            hit = self.near(a, b)
            out += zip(a[hit].tolist(), b[hit].tolist(), strict=True)
        return out

    def long_list(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect what is connected among the rows of a list."""
        out = []
        while len(rows):
            mine = self.roots[rows] == self.roots[rows[0]]
            root, front, rows = int(rows[0]), rows[mine], rows[~mine]
            while len(front) and len(rows):
                hit = np.zeros(len(rows), bool)
                if len(front) <= len(rows):
                    for x in front:
                        left = np.flatnonzero(~hit)
                        if not len(left):
                            break
                        hit[left] = self.near(np.full(len(left), x), rows[left])
                else:
                    for i, y in enumerate(rows):
                        hit[i] = self.near(front, np.full(len(front), y)).any()
                out += ((root, y) for y in rows[hit].tolist())
                # with those found goes all that they are connected to
                hit = np.isin(self.roots[rows], self.roots[rows[hit]])
                front, rows = rows[hit], rows[~hit]
        return out

    def unite(self, found: list[tuple[int, int]]) -> None:
        parent = self.roots

        def find(x: int) -> int:
            while parent[x] != x:
                x = int(parent[x])
            return x

        for a, b in found:
            u, v = find(a), find(b)
            if u != v:
                parent[max(u, v)] = min(u, v)
                self.links.append((a, b))
        while found and (parent[parent] != parent).any():
            parent[:] = parent[parent]

    def search(self) -> list[tuple[int, int]]:
        """Links that connect all near sets that share a list."""
        if len(self.fps) < 2:
            return []
        for first, word in enumerate(self.words):
            places = [word.view(np.uint8)[k::8].astype(np.uint16) for k in range(8)]
            for i, j in combinations(range(8), 2):
                key = places[i] << np.uint16(8) | places[j]
                rows = np.argsort(key, kind="stable")
                ordered = key[rows]
                starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                sizes = np.diff(np.append(starts, len(rows)))
                roots = self.roots[rows]
                several = np.minimum.reduceat(roots, starts) < np.maximum.reduceat(roots, starts)
                found = []
                for k in np.flatnonzero(several & (sizes > SHORT)):
                    found += self.long_list(rows[starts[k] : starts[k] + sizes[k]])
                short = np.repeat(several & (sizes <= SHORT), sizes)
                found += self.short_lists(rows[short], np.repeat(np.arange(len(starts)), sizes)[short], first)
                self.unite(found)
        return self.links


def links(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of ``sets`` (a long; n, the size, above 0; fps, the bytes of ``width_at`` fingerprints): links that connect
    sets at the similarity, and others down to about 0.6; pairs just at it are missed with a probability of ``MISS``."""
    if similarity == 1:  # equal sets are one
        return sets.select(F.col("a").alias("u"), F.col("a").alias("v")).limit(0)
    size_class = F.floor(F.log("n") / (math.log(1 / similarity) * (1 + 1e-9)))
    listed = sets.select("a", "n", "fps", F.explode(F.array(size_class, size_class + 1)).alias("class"), size_class.alias("own"))
    listed = listed.select("class", (F.col("class") == F.col("own")).alias("own"), "a", "n", "fps")
    # so many rows as there are classes of sizes
    large = sets.select(F.explode(F.array(size_class, size_class + 1)).alias("class")).groupBy("class").count().where(F.col("count") > BLOCK)
    large = F.broadcast(large.select("class", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    tasks = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, block) * F.col("blocks") + F.greatest(j, block))
    )
    dealt = listed.join(large, "class", "left").select("class", F.explode(tasks).alias("task"), "a", "n", "own", "fps")
    dealt = dealt.repartition(shuffle_parts(sets.sparkSession), "class", "task").sortWithinPartitions("class", "task")

    def linked(held):
        names, sizes, own, fps = (np.concatenate([h[k] for h in held]) for k in range(4))
        held.clear()
        found = np.array(_Class(fps, sizes, own, similarity).search() if own.any() else [], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(names[found[:, k]]) for k in (0, 1)], ["u", "v"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            names, sizes, own = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            fps = np.ascontiguousarray(fingerprint_matrix(batch.column(5))).view(np.uint64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(keys[a]) != at:
                    yield linked(held)
                at = tuple(keys[a])
                held.append((names[a:b], sizes[a:b], own[a:b], fps[a:b]))
        if held:
            yield linked(held)

    return dealt.mapInArrow(giving_back(run), "u long, v long")
