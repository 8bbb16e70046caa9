"""Benchmark decontamination by spaced seeds.

A text's words are runs of letters, marks and digits of any script, lower-cased; in scripts that are written without
spaces each letter is a word. A document leaks an item if ``WINDOW`` words in a row of
one equal as many of the other, place by place, but for at most ``SUBSTITUTIONS``; an item of ``LEAST_WORDS`` words or
more, but fewer than a window, must occur whole but for one; a shorter one is no evidence. Spaced seeds find these
windows: a mask names the places of a window that are hashed and ignores the others, so a substituted word at an ignored
place doesn't matter. ``masks`` builds a family of which every pattern of substitutions leaves one mask untouched, so
nothing is lost. Seeds of training texts are first looked up in a filter of all test seeds, of a bounded number of bits;
those that pass are joined with the test seeds, and the words around each hit are compared.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import IS_SPACE, mix, ranges, text_chunks, word_bounds, word_hashes, written

WINDOW = 13
SUBSTITUTIONS = 2
#: Places of a window that a mask hashes.
WEIGHT = 6
#: Items of fewer words than this are left out; from here to a window they may differ in ``SHORT_SUBSTITUTIONS`` words.
LEAST_WORDS = 8
SHORT_SUBSTITUTIONS = 1
#: The filter has so many bits (a power of two) for each test seed, but 2 ** FILTER_MOST (16 MB) at most.
FILTER_EACH = 1 << 10
FILTER_MOST = 27

_APART = IS_SPACE.copy()
_APART[:128] = [not chr(c).isalnum() for c in range(128)]
#: Beyond ASCII: what parts words, and letters that are words by themselves.
APART = r"[^\x00-\x7F\p{L}\p{M}\p{N}]+"
ALONE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


@lru_cache(maxsize=8)
def masks(window: int = WINDOW, substitutions: int = SUBSTITUTIONS, weight: int = WEIGHT) -> tuple[tuple[int, ...], ...]:
    """Offsets of each mask, greedily: the mask of ``weight`` places that avoids most of the patterns not avoided yet."""
    left = set(combinations(range(window), substitutions))
    weight = min(weight, window - substitutions)
    spaced = [m for m in combinations(range(window), weight) if m[-1] - m[0] >= weight or weight == window - substitutions]
    out = []
    while left:
        best = max(spaced, key=lambda m: sum(not set(m) & set(p) for p in left))
        out.append(best)
        left = {p for p in left if set(p) & set(best)}
    return tuple(out)


def _seed(hashes: np.ndarray, starts: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    value = np.full(len(starts), salt, np.uint64)
    for k in mask:
        value = (value ^ hashes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
    return mix(value)


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts whose words beyond ASCII have spaces between them; ASCII texts, of which there is nothing to do, stay."""
    ascii_only = pc.fill_null(pc.string_is_ascii(texts), True)
    if pc.all(ascii_only).as_py() is not False:
        return texts
    other = pc.filter(texts, pc.invert(ascii_only))
    other = pc.replace_substring_regex(pc.replace_substring_regex(other, APART, " "), ALONE, r" \1 ")
    return pc.replace_with_mask(texts, pc.invert(ascii_only), other)


def _words(batch, column: str):
    """(first row, bytes, starts and ends of all words, their hashes, index of each row's first word) of runs of rows."""
    lower = pa.RecordBatch.from_arrays([_spaced(pc.utf8_lower(batch.column(column)))], [column])
    for a, _, data, offsets in text_chunks(lower, column):
        starts, ends, firsts = word_bounds(data, offsets, _APART)
        yield a, data, starts, ends, word_hashes(data, starts, ends), firsts


def shapes(lengths, window: int, substitutions: int, weight: int, least: int) -> list[tuple[int, int, tuple[int, ...], int]]:
    """(words of the window, substitutions, mask, salt) that items of these lengths are looked for with."""
    out = []
    for n in sorted({min(n, window) for n in lengths if n >= least or n >= window}):
        most = substitutions if n == window else min(SHORT_SUBSTITUTIONS, n - 1)
        out += [(n, most, mask, n * 1024 + i) for i, mask in enumerate(masks(n, most, weight))]
    return out


def _seed_rows(batch, plan, passes=None):
    """(row, word in row, shape, seed, words) of the windows of each row whose seed ``passes``."""
    for a, data, starts, ends, hashes, firsts in _words(batch, "text"):
        lengths = np.diff(firsts)
        for shape, (n, _, mask, salt) in enumerate(plan):
            rows = np.flatnonzero(lengths >= n)
            at = ranges(firsts[rows], lengths[rows] - n + 1)
            if not len(at):
                continue
            seeds = _seed(hashes, at, mask, salt)
            on = np.arange(len(at)) if passes is None else passes(seeds)
            if not len(on):
                continue
            row = np.searchsorted(firsts, at[on], "right") - 1
            texts = [b" ".join(data[x:y].tobytes() for x, y in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist(), strict=True)) for k in at[on].tolist()]
            yield a + row, at[on] - firsts[row], np.full(len(on), shape), seeds[on].view(np.int64), texts


def _positions(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of ``2 ** bits`` bits."""
    shift = np.uint64(64 - bits)
    return seeds >> shift, mix(seeds * np.uint64(0xD6E8FEB86659FD93)) >> shift


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Words of 64 bits; what reaches the driver is ``2 ** bits`` bits at most, however many seeds there are."""

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_positions(batch.column(0).to_numpy().view(np.uint64), bits)))
            word, value = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
            merged = np.bitwise_or.reduceat(value, firsts) if len(firsts) else value
            yield pa.RecordBatch.from_arrays([pa.array(word[firsts]), pa.array(merged.view(np.int64))], ["word", "value"])

    found = seeds.select("seed").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(1 << max(bits - 6, 0), np.uint64)
    out[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return out


_SEEDS = "seed long, shape int, words binary"


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          window: int = WINDOW, substitutions: int = SUBSTITUTIONS, weight: int = WEIGHT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Returns one row (id, item_id, n_windows, first_word, last_word, substitutions) for each document and item that
    share a window: how many windows of the document match, the span of its words that they cover, and the least
    number of substitutions. Documents without a leak have no row.

    Null or empty texts and items share nothing; items or documents with a null id are left out. Rows with the same id
    count as one document, whose windows are added up. Empty tables give an empty result. Other columns are ignored.
    Either table may be of any size: test seeds are made, filtered and joined by Spark, which broadcasts them only while
    its own size estimate allows it, and splits a seed that very many texts have.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")

    def lengths(batches):
        for batch in batches:
            some = {min(int(n), window) for *_, firsts in _words(batch, "text") for n in np.diff(firsts)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(some), pa.int32())], ["n"])

    # at most as many lengths as a window has words
    plan = shapes([r.n for r in items.select("text").mapInArrow(lengths, "n int").distinct().collect()], window, substitutions, weight, least_words)

    def test_seeds(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes: dict[int, int] = {}
            for a, *_, firsts in _words(batch, "text"):
                sizes |= {a + i: int(n) for i, n in enumerate(np.diff(firsts))}
            for row, _, shape, seed, words in _seed_rows(batch, plan):
                # a short window is a whole item
                fit = [i for i, (r, k) in enumerate(zip(row.tolist(), shape.tolist(), strict=True)) if plan[k][0] == min(sizes[r], window)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[fit]]), pa.array(seed[fit]), pa.array(shape[fit], pa.int32()), pa.array([words[i] for i in fit], pa.binary())], ["item_id", "seed", "shape", "words"])

    seeds = written(items.mapInArrow(test_seeds, f"item_id long, {_SEEDS}").distinct(), "seeds")
    bits = min(max(seeds.count() * FILTER_EACH, 1 << 12).bit_length(), FILTER_MOST)
    sent = spark.sparkContext.broadcast(_filter(seeds, bits))

    def passes(value: np.ndarray) -> np.ndarray:
        def on(at):
            return (sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

        first = np.flatnonzero(on(value >> np.uint64(64 - bits)))
        return first[on(_positions(value[first], bits)[1])]

    def text_seeds(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, at, shape, seed, words in _seed_rows(batch, plan, passes):
                yield pa.RecordBatch.from_arrays([pa.array(number + row), pa.array(ids[row]), pa.array(at), pa.array(seed), pa.array(shape, pa.int32()), pa.array(words, pa.binary())], ["row", "doc_id", "at", "seed", "shape", "words"])
            number += batch.num_rows

    def verified(batches):
        for batch in batches:
            shape, wrong = batch.column(4).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                wrong[i] = 0 if x == y else sum(p != q for p, q in zip(x.split(b" "), y.split(b" "), strict=True))
            good = np.flatnonzero(wrong <= np.array([most for _, most, _, _ in plan])[shape]) if len(shape) else shape
            some = batch.take(pa.array(good, pa.int64()))
            n = np.array([n for n, *_ in plan], np.int64)[shape[good]] if len(shape) else wrong
            yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(n), pa.array(wrong[good])], ["row", "doc_id", "item_id", "at", "n", "wrong"])

    met = docs.mapInArrow(text_seeds, f"row long, doc_id long, at long, {_SEEDS}").join(seeds.withColumnRenamed("words", "other"), ["seed", "shape"])
    found = met.select("row", "doc_id", "item_id", "at", "shape", "words", "other").mapInArrow(verified, "row long, doc_id long, item_id long, at long, n long, wrong long") if plan else None
    if found is None:
        found = spark.createDataFrame([], "row long, doc_id long, item_id long, at long, n long, wrong long")
    # a window is found by several masks, and may be like several windows of an item
    once = found.groupBy("row", "doc_id", "item_id", "at", "n").agg(F.min("wrong").alias("wrong"))
    return once.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_windows"), F.min("at").alias("first_word"), F.max(F.col("at") + F.col("n") - 1).alias("last_word"), F.min("wrong").alias("substitutions")
    ).withColumnRenamed("doc_id", id_col)


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``df`` without the documents that leak an item; a document with a null id stays. Ids that leak are written first,
    so that Spark knows their size and sends them to the texts if they are few."""
    gone = written(leaks(df, benchmark, id_col, **options).select(id_col).distinct(), "leaking")
    return df.join(gone, id_col, "left_anti").select(*df.columns)
