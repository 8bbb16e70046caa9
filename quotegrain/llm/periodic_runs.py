"""Periodic runs of words, by a suffix automaton whose link tree is accessed as a link-cut tree.

Words are appended one by one. The suffix links of the automaton form a tree; the path from the state of the whole
prefix to the root has all its suffixes. Paths are kept as splay trees, each with the end of the last prefix that was
accessed through it. Appending a word accesses its state: the path is recoloured, and each segment of another colour
that it crosses gives the last end of the longest suffix there. If the distance of both ends is at most that
suffix's length, the two occurrences touch: a square. A run gives such a pair, with one distance and one start, at each
of its words from the second period's end on, so pairs of one start and distance extend each other to the whole run.

A run of the least length has six words that come again one period later, so a word stands for the six words that it
ends, and stretches of a text that hold no six words twice are left out first: none of their words is in a run.
Everything happens inside a document, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of a symbol. A run has at least twice as many words.
GRAM = 6
LEAST = 2 * GRAM
#: A stretch that loses words may lose more in the next pass. Passes only save work: what is left out is in no run.
PASSES = 6


class LastEnds:
    """The automaton of a growing sequence; ``append`` returns the pairs (last end, length) of touching occurrences."""

    def __init__(self, slack: int = 0):
        self.slack = slack  # a suffix of m symbols has m + slack words
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        # of the splay trees: parent (of a tree's root: the state above the path), children, colour (of the root)
        self.up, self.left, self.right, self.colour = [-1], [-1], [-1], [-1]
        self.last, self.n = 0, 0

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.up.append(link or -1)  # paths end below the root
        self.left.append(-1)
        self.right.append(-1)
        self.colour.append(-1)
        return len(self.length) - 1

    def append(self, symbol: int) -> list[tuple[int, int]]:
        following, link, length = self.next, self.link, self.length
        i, p = self.n, self.last
        while p >= 0 and symbol not in following[p]:
            p = link[p]
        if p < 0:
            under = 0
        else:
            under = following[p][symbol]
            if length[p] + 1 < length[under]:
                under = self._split(p, symbol, under)
        state, p = self._state(i + 1, under, {}), self.last
        while p >= 0 and symbol not in following[p]:
            following[p][symbol] = state
            p = link[p]
        self.last, self.n = state, i + 1
        return self._access(state, i) if under else self._first(state, i)

    def _first(self, state: int, i: int) -> list:
        self.colour[state] = i
        return []

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A copy of state q for its shorter suffixes: it stands right above q in q's path."""
        following, link, up, left = self.next, self.link, self.up, self.left
        copy = self._state(self.length[p] + 1, link[q], dict(following[q]))
        self._splay(q)
        if (above := left[q]) >= 0:
            up[above] = copy
        left[copy], left[q], up[copy] = above, copy, q
        link[q] = copy
        while p >= 0 and following[p].get(symbol) == q:
            following[p][symbol] = copy
            p = link[p]
        return copy

    def _access(self, state: int, i: int) -> list[tuple[int, int]]:
        up, right, colour, length, slack, out = self.up, self.right, self.colour, self.length, self.slack, []
        below, u = state, up[state]
        while u >= 0:
            self._splay(u)
            end = colour[u]
            if i - end <= length[u] + slack:
                out.append((end, length[u] + slack))
            if (cut := right[u]) >= 0:
                colour[cut] = end
            right[u] = below
            up[below] = u
            below, u = u, up[u]
        colour[below] = i
        return out

    def _splay(self, x: int) -> None:
        """Makes x the root of its splay tree."""
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self.colour[x] = self.colour[g]  # that of the tree, once g is its root
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
                self._rotate(x)
            else:
                self.colour[x] = self.colour[p]
                self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x


def _stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """(first, end) of stretches of words in which every word is in six words that the stretch holds twice."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    gram = h[: len(h) - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram *= np.uint64(0x9E3779B97F4A7C15)
        gram += h[k : len(h) - GRAM + 1 + k]
    at = np.arange(len(gram))
    for _ in range(PASSES):
        # six words that begin after a gap belong to another stretch, and so are other words than those before
        stretch = np.cumsum(np.diff(at, prepend=at[:1]) > GRAM).astype(np.uint64)
        key = gram[at] + stretch * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.sort(key)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return []
        stay = np.isin(key, twice)
        if stay.all():
            break
        at = at[stay]
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > GRAM)
    firsts, lasts = at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]] + GRAM
    return [(a, b) for a, b in zip(firsts.tolist(), lasts.tolist()) if b - a >= LEAST]


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least twelve words and two periods, by start and period."""
    if len(words) < LEAST:
        return []
    found: dict[tuple[int, int], int] = {}
    for a, b in _stretches(words):
        names: dict[tuple, int] = {}
        part = words[a:b]
        ends, first = LastEnds(GRAM - 1), a + GRAM - 1
        for k, gram in enumerate(zip(*(part[j:] for j in range(GRAM)))):
            for end, length in ends.append(names.setdefault(gram, len(names))):
                found[first + end - length + 1, k - end] = first + k
    out = [(start, end - start + 1, period) for (start, period), end in found.items()]
    return sorted((s, n, p) for s, n, p in out if n >= max(LEAST, 2 * p))


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words of a document of the periodic tenth: from a place on, which its id gives, a part of them repeats."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, keep: bool = True) -> DataFrame:
    """Returns id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256 of
    every row and, with ``keep``, runs (all of them) and collapsed (the text with one period of each run).

    Words are parted by ASCII white space. A run is a maximal stretch of words with a smallest period q, of at least 12
    and 2 q words. Of equally long runs that of the smallest start, then period, is given. A word goes if any run has
    it after that run's first q words. Null and empty texts have no words and no runs. Rows of one id are judged each;
    an empty table gives an empty result; other columns are ignored. With ``plant`` the documents of a tenth of the ids
    are made periodic first, by ``planted``; those without an id are not.
    """
    kind = dict(df.dtypes)[id_col]
    longs = ["n_runs", "start", "length", "period", "exponent_milli"]
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in longs)}, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string" * keep
    many = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def judged(doc_id, text):
        words = (text or "").encode().split()
        if plant and doc_id is not None:
            words = planted(words, doc_id)
        every = runs(words)
        best = min(every, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        if every:
            gone = bytearray(len(words))
            for start, length, period in every:
                gone[start + period : start + length] = b"\1" * (length - period)
            words = [w for w, g in zip(words, gone) if not g]
        collapsed = b" ".join(words)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in every)
        row = [len(every), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
        return row + [[{"start": s, "length": n, "period": p} for s, n, p in every], collapsed.decode()] * keep

    def run(batches):
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [many, pa.string()] * keep
        names = ["doc_id", *longs, "runs_sha256", "collapsed_sha256"] + ["runs", "collapsed"] * keep
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = [judged(i.as_py(), t.as_py()) for i, t in zip(some.column(0), some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
