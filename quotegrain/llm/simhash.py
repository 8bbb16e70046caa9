"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has eight bytes; two that differ in at most d < 8 bits share at least 8 - d bytes in place. Lists of
single bytes would hold a 256th of all rows each, so the index is keyed by sets of ``WIDTH`` positions, chosen such
that any four shared positions contain one of the sets; no qualifying pair is missed. A list that grows longer than ``BLOCK``
is split by one more position, which qualifying pairs share too. In each list the shared positional bytes of a pair are tallied, pairs with at least 8 - d stay, and their
differing bits are counted. Equal fingerprints are one node of the index, so copies cost nothing. A list gives a
spanning forest of its links, never all pairs of a group; lists still longer than ``BLOCK`` are compared block by block.

``near_duplicates`` links at a number of bits. For links at a similarity of shingle sets, ``similar`` finds candidates by
several fingerprints (``simhash_index``) and then compares the sets themselves (``shingle_sets``).
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import mix, shuffle_parts, written
from .components import components
from .shingle_sets import SIMILARITY, similar, without_similar  # noqa: F401
from .simhash_index import near

MAX_BITS = 4
WORDS = 4
SEED = 42
#: Fingerprints of one list that a task compares at a time.
BLOCK = 4096


def position_sets(need: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any ``need`` shared positions contain at least one.

    For four: triples within one of three groups, or two of a group and one of the next. Else all sets of that size.
    """
    if need != 4:
        return list(combinations(range(8), need))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        g = sorted(group[i] for i in t)
        if g[0] == g[2] or g in ([0, 0, 1], [1, 1, 2], [0, 2, 2]):
            out.append(t)
    return out


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Of one text in UTF-8: A-Z lower-cased, shingles of ``words`` words; 0 without words."""
    return _fingerprint(text, words, seed, 1)[0]


def _fingerprint(text: bytes, words: int, seed: int, width: int) -> list[int]:
    """``width`` fingerprints: of the shingles' hashes, and of these mixed anew."""
    parts = text.lower().split()
    if not parts:
        return [0] * width
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    out = []
    for k in range(width):
        h = mix(hashes * np.uint64(2 * k + 1) + np.uint64(k)) if k else hashes
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]))
    return out


def _names(width: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, width))]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED, width: int = 1) -> DataFrame:
    """(id, fp as a signed long, and fp1... with more ``width``) of each row; a null or empty text has fingerprint 0."""
    kind, names = dict(df.dtypes)[id_col], _names(width)

    def run(batches):
        for batch in batches:
            out = np.array([_fingerprint((t.as_py() or "").encode(), words, seed, width) for t in batch.column(1)], np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], ["doc_id", *names])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def _forest(fps: np.ndarray, shared: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among these fingerprints: each to the first of its component."""
    rest, roots, nodes = fps, [fps[:0]], [fps[:0]]
    while len(rest) > 1:
        root, front, rest = rest[:1], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                open_ = np.flatnonzero(~hit)
                hit[open_] |= near(front[at : at + 64, None], rest[None, open_], shared, max_bits).any(0)
            front, rest = rest[hit], rest[~hit]
            nodes.append(front)
            roots.append(np.repeat(root, len(front), axis=0))
    return np.concatenate(roots), np.concatenate(nodes)


def _links_of(fps: np.ndarray, firsts: np.ndarray, shared: int, max_bits: int):
    """Of lists laid end to end; ``firsts`` are their starts. Short lists pair by distance, long ones by a forest."""
    us, vs = [fps[:0]], [fps[:0]]
    sizes = np.diff(np.append(firsts, len(fps)))
    group = np.repeat(np.arange(len(firsts)), sizes)
    short = sizes[group] <= 8
    for lag in range(1, 8):
        i = np.flatnonzero(short[:-lag] & (group[:-lag] == group[lag:])) if len(fps) > lag else np.zeros(0, np.int64)
        close = i[near(fps[i], fps[i + lag], shared, max_bits)] if len(i) else i
        us.append(fps[close])
        vs.append(fps[close + lag])
    for g in np.flatnonzero(sizes > 8):
        u, v = _forest(fps[firsts[g] : firsts[g] + sizes[g]], shared, max_bits)
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) links of distinct fingerprints ``fp`` that connect all pairs at ``max_bits`` or fewer differing bits."""
    if not 0 <= max_bits < 8:
        raise ValueError("0 to 7 differing bits keep at least one byte in place")
    found = _links(nodes, ["fp"], position_sets(8 - max_bits), 8 - max_bits, max_bits)
    return found.select(F.col("u0").alias("u"), F.col("v0").alias("v"))


def _links(nodes: DataFrame, names: list[str], sets: list[tuple[int, ...]], shared: int, max_bits: int) -> DataFrame:
    """(u0..., v0...) of distinct fingerprints in the columns ``names``, listed by ``sets`` of byte positions."""
    spark, width = nodes.sparkSession, len(names)

    def byte(i):
        return F.shiftrightunsigned(names[i // 8], 8 * (i % 8)).bitwiseAND(255)

    def key(k, t):
        value = F.lit(k).cast("long")
        for i in t:
            value = F.shiftleft(value, 8).bitwiseOR(byte(i)) if len(t) < 7 else F.xxhash64(value, byte(i))
        return value

    lists = [F.struct(F.lit(k).alias("k"), key(k, t).alias("key")) for k, t in enumerate(sets)]
    index = nodes.select(*names, F.explode(F.array(*lists)).alias("l")).select(*names, "l.k", "l.key")
    # members of a long list are listed anew by one more position: pairs that qualify share one outside the set
    long = written(index.groupBy("key").count().where(F.col("count") > BLOCK).select("key"), "lists")
    more = [F.array(*(F.xxhash64("key", F.lit(i), byte(i)) for i in range(8 * width) if i not in t)) if len(t) < shared else F.array(F.col("key")) for t in sets]
    anew = index.join(long, "key", "left_semi").select(*names, F.explode(F.get(F.array(*more), F.col("k"))).alias("key"))
    index = index.join(long, "key", "left_anti").select(*names, "key").unionByName(anew)
    large = index.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = written(large, "lists")
    own = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
    # each block meets each: task (i, j), i <= j, holds the rows of both
    tasks = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * F.col("blocks") + F.greatest(j, own))
    )
    dealt = index.join(large, "key", "left").select("key", *names, F.explode(tasks).alias("task"))
    # in one order in every list, so that lists of one group have the same first and give the same links
    dealt = dealt.repartition(shuffle_parts(spark), "key", "task").sortWithinPartitions("key", "task", *names)
    columns = [f"{side}{k}" for side in "uv" for k in range(width)]

    def run(batches):
        held_at, held = np.zeros((0, 2), np.int64), np.zeros((0, width), np.int64)

        def emit(at, fps):
            firsts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(1))) if len(fps) else np.zeros(0, np.int64)
            u, v = _links_of(fps, firsts, shared, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*u.T, *v.T)], columns)

        for batch in batches:
            at = np.concatenate([held_at, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)])
            fps = np.concatenate([held, np.stack([batch.column(2 + k).to_numpy() for k in range(width)], 1)])
            if not len(fps):
                continue
            other = np.flatnonzero((at != at[-1]).any(1))
            last = int(other[-1]) + 1 if len(other) else 0
            yield emit(at[:last], fps[:last])
            held_at, held = at[last:], fps[last:]
        yield emit(held_at, held)

    return dealt.select("key", F.col("task").cast("long").alias("task"), *names).mapInArrow(run, ", ".join(f"{c} long" for c in columns)).distinct()


def bits_at(similarity: float, bits: int) -> int:
    """Differing bits, rounded up, that two sets of one size and this Jaccard similarity lead one to expect."""
    return math.ceil(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Returns id, fingerprint (16 hex digits), component_id (the smallest id reachable) for every row.

    A null or empty text has fingerprint 0, which links like any other. Rows with the same id are fingerprinted each.
    A null id is returned with the component of its fingerprint, null if all ids there are null. An empty table gives
    an empty result; other columns are ignored.
    """
    docs = written(fingerprints(df, id_col, text_col, words, seed), "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), max_bits))
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = member.join(least, "component").select("fp", "component_id")
    return docs.join(classes, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
