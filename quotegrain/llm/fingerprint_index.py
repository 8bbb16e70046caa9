"""Incremental removal of repeated word windows, with a log-structured index of fingerprints.

The index holds, for each batch of documents added so far, the hashes of its anchors (the 5-word gram of least hash in
each window of 13 words, see ``anchors``), with the group of documents each came from: a sorted run, written once and
never changed. A new batch's sorted hashes are merge-joined with all runs (and itself); what two documents share is
verified on the texts: digests of the words around the anchor and, where these differ, of each whole window. The
batch's hashes become a new run; when ``FANOUT`` runs of one level have gathered, they are compacted into one run of
the next level, in the pass over the index that the join makes anyway. Runs and texts lie in buckets in one folder,
which another session can open.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .anchors import HOT, HOT_PIECES, PACKED, SHARED, Scheme, _expand, _runs, _squeeze, anchor_rows, answers, covered, layout, listed, pack, resolve, sent_hashes, shared_bits
from .common import CHUNK_BYTES, LARGE_ROWS, mix, ranges, scratch_dir, text_bytes, word_bounds, word_hashes

WINDOW = 13
GRAM = 5
FANOUT = 2
#: Where batches end, as shares of all documents.
CUTS = (0.125, 0.5)
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, firsts = word_bounds(data, offsets)
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):  # some at a time, to bound memory in long texts
        b = max(int(np.searchsorted(ends, starts[a] + CHUNK_BYTES)), a + 1)
        out[a:b] = word_hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
        a = b
    return out, firsts


def _grams(tokens: np.ndarray) -> np.ndarray:
    n = len(tokens) - GRAM + 1
    h = tokens[:n] * _A
    for k in range(1, GRAM):
        h = mix((h ^ tokens[k : k + n]) * _A)
    return h


def _digests(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salt: np.uint64 = _A) -> np.ndarray:
    h = lengths.astype(np.uint64) * salt
    for k in range(int(lengths.max()) if len(lengths) else 0):
        word = tokens[np.minimum(starts + k, len(tokens) - 1)]
        h = np.where(k < lengths, mix((h ^ word) * salt), h)
    return h


SCHEME = Scheme(WINDOW, GRAM, _words, _grams, _digests)
_MOST = SCHEME.reach + 1  # windows around an anchor


def _windows_of(group, place, left, right) -> np.ndarray:
    """96 bits of each window around each anchor, in a row."""
    count = left + right - SCHEME.reach + 1
    long, short = np.zeros((len(place), _MOST), np.uint64), np.zeros((len(place), _MOST), np.uint32)
    owner = np.repeat(np.arange(len(place)), count)
    step = ranges(np.zeros(len(place), np.int64), count)
    starts = (place - left)[owner] + step
    lengths = np.full(len(starts), WINDOW)
    long[owner, step] = _digests(group.tokens, starts, lengths)
    short[owner, step] = _digests(group.tokens, starts, lengths, _B) >> np.uint64(32)
    return np.concatenate([long.view(np.uint8), short.view(np.uint8)], axis=1)


def _tell_apart(hashes, rows, left, right, least) -> np.ndarray:
    """Least id of each window, by its 96 bits."""
    count = left + right - SCHEME.reach + 1
    long, short = np.ascontiguousarray(rows[:, : 8 * _MOST]).view(np.uint64), np.ascontiguousarray(rows[:, 8 * _MOST :]).view(np.uint32)
    owner, step = np.repeat(np.arange(len(rows)), count), ranges(np.zeros(len(rows), np.int64), count)
    x, y = long[owner, step], short[owner, step]
    order = np.lexsort((y, x))
    new = np.append(True, (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]]))[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = np.minimum.reduceat(least[owner][order], np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else least[:0]
    return out


RUNS = "b long, s long, part int, reply binary, hashes binary, run int"
TEXTS = PACKED + ", batch int"
STATE = "batches int, greatest long, set_bytes long, buckets long, files long, fanout int, hot_pieces long, marks array<int>, runs array<struct<number: int, level: int>>"


def _merge(fresh: pa.Table, old: pa.Table, number: int, compacted: set[int], hot_pieces: int) -> pa.Table:
    """One bucket of the new batch's anchor rows and of the runs: replies to sets, and the bucket of the run that is written."""
    b = (fresh if fresh.num_rows else old)["b"][0].as_py()
    hashes, several = sent_hashes(fresh["blob"].to_pylist())
    history = [(*_expand(h, np.uint64, np.int64), run) for h, run in zip(old["hashes"].to_pylist(), old["run"].to_pylist(), strict=True)]
    out: list[tuple] = []
    if hashes:
        new_h = np.concatenate(hashes)
        bits = shared_bits(new_h, several, hot_pieces)
        # the merge join: sorted distinct hashes of the batch against each sorted run
        keys, own = np.unique(new_h, return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        spans = []
        for h, _, _ in history:
            low, high = np.searchsorted(h, keys), np.searchsorted(h, keys, "right")
            spans.append((low, high - low))
            count += high - low
        hot = count + np.bincount(own, minlength=len(keys)) >= hot_pieces
        bits |= (count > 0)[own] * np.uint8(SHARED) | hot[own] * np.uint8(HOT)
        replies = answers(fresh, bits, [len(h) for h in hashes])
        out += [(b, s, part, reply, None) for s, part, reply in zip(*(replies[c].to_pylist() for c in ("s", "part", "reply")), strict=True)]
        hits = [(np.repeat(keys, n), g[ranges(low, n)], np.repeat(hot, n)) for (_, g, _), (low, n) in zip(history, spans, strict=True)]
        if hits:
            h, g, is_hot = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.lexsort((h, g))
            h, g, is_hot = h[order], g[order], is_hot[order]
            for s, x, y in _runs(g):
                out.append((b, s, -1, listed(np.unique(h[x:y]), np.unique(h[x:y][is_hot[x:y]])), None))
    # the run to be written: the batch's, with those that are compacted
    sets = [np.full(len(h), s) for h, s in zip(hashes, fresh["s"].to_pylist(), strict=True)]
    parts = [*zip(hashes, sets, strict=True), *((h, g) for h, g, run in history if run in compacted)]
    if parts:
        h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((g, h))
        out.append((b, None, None, None, _squeeze(h[order], g[order])))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
    return pa.table([*columns, pa.array([number] * len(out), pa.int32())], ["b", "s", "part", "reply", "hashes", "run"])


class FingerprintIndex:
    """An index in a folder that executors share; ``create`` and ``open`` it, and ``add`` batches in ascending order of
    ids. Runs and texts are written in buckets, so a batch is dealt out to where they lie and they stay in place; only
    sets of earlier documents that share a hash with the batch are read again. A batch counts once the folder's state
    says so: what a failed ``add`` has written is not seen, and it may be repeated."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state

    @classmethod
    def create(cls, spark: SparkSession, path: str, expected_bytes: int, fanout: int = FANOUT, hot_pieces: int = HOT_PIECES) -> FingerprintIndex:
        """``expected_bytes``: of the texts that the index will hold; it fixes how hashes and sets are dealt out."""
        plan = layout(spark, expected_bytes)
        index = cls(spark, path, {"batches": 0, "greatest": None, **vars(plan), "fanout": fanout, "hot_pieces": hot_pieces, "marks": [], "runs": []})
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        row = spark.read.schema(STATE).parquet(f"{path}/state").orderBy(F.desc("batches")).first()
        return cls(spark, path, row.asDict(recursive=True))

    def _save(self) -> None:
        self.spark.createDataFrame([self.state], STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def _table(self, part: str, schema: str, column: str, rows: DataFrame | None = None) -> DataFrame:
        """The index's table of runs or texts, in buckets of ``column``, after ``rows`` are appended as new files."""
        name, options = f"index_{part}_{uuid.uuid4().hex}", ", ".join(f"'{k}' '{v}'" for k, v in LARGE_ROWS.items())
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {self.state['files']} BUCKETS OPTIONS ({options}) LOCATION '{self.path}/{part}'")
        try:
            if rows is not None:
                rows.select(*(c.split()[0] for c in schema.split(", "))).write.insertInto(name)  # with the table's options
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, docs: DataFrame, id_col: str, text_col: str, finish, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
        """Adds documents; returns their rows of ``finish``, judged against all smaller ids."""
        state = self.state
        buckets, hot_pieces, fanout, before = (state[k] for k in ("buckets", "hot_pieces", "fanout", "greatest"))
        mark = uuid.uuid4().int & 0x7FFFFFFF  # of this attempt's rows
        sets = pack(docs, id_col, text_col, state["set_bytes"], state["batches"], carry=carry).withColumn("batch", F.lit(mark))
        texts = self._table("texts", TEXTS, "s", sets)
        own = texts.where(F.col("batch") == mark)
        least, greatest = own.agg(F.min("least"), F.max("greatest")).first()
        if least is not None and before is not None and least <= before:
            raise ValueError("ids of a batch must be greater than those before")
        runs, level, merged = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in state["runs"]], 0, set()
        while len(same := [n for n, at in runs if at == level]) >= fanout - 1:
            merged |= set(same)
            level += 1
        history = self._table("runs", RUNS, "b").where(F.col("run").isin([n for n, _ in runs]) & F.col("hashes").isNotNull()).select("b", "hashes", "run")
        met = anchor_rows(own, SCHEME, buckets).groupBy("b").cogroup(history.groupBy("b"))
        out = self._table("runs", RUNS, "b", met.applyInArrow(lambda new, old: _merge(new, old, mark, merged, hot_pieces), RUNS))
        masks = out.where((F.col("run") == mark) & F.col("reply").isNotNull()).select("s", "b", "part", "reply")
        self.state = state | {
            "batches": state["batches"] + 1, "greatest": before if greatest is None else greatest, "marks": [*state["marks"], mark],
            "runs": [r for r in runs if r[0] not in merged] + [(mark, level)],
        }
        self._save()
        live = texts.where(F.col("batch").isin(self.state["marks"]))
        return resolve(live, masks, SCHEME, buckets, _windows_of, _tell_apart, finish, schema, F.col("batch") == mark)


def _finish(keep_text: bool, as_is: bool, carries: bool):
    def finish(group, starts):
        gone = covered(starts, WINDOW, len(group.tokens))
        first, last, rows_at = word_bounds(group.data, group.offsets)
        kept = np.flatnonzero(~gone)
        padded = np.concatenate([group.data, np.full(1, 0x20, np.uint8)])
        lengths = last[kept] - first[kept] + 1
        text = padded[ranges(first[kept], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        text[ends[1:] - 1] = 0x20
        at = ends[np.searchsorted(kept, rows_at)]
        removed = np.concatenate([[0], np.cumsum(gone)])[rows_at]
        out: list[tuple] = []
        for i, doc in enumerate(group.ids.tolist()):
            own = text[at[i] : max(at[i + 1] - 1, at[i])].tobytes()
            n = int(removed[i + 1] - removed[i])
            given = group.data[group.offsets[i] : group.offsets[i + 1]].tobytes() if as_is and not n else own
            out.append((doc, int(rows_at[i + 1] - rows_at[i]), n, hashlib.sha256(own).hexdigest(), given.decode() if keep_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        k = 5 if keep_text else 4
        columns = [pa.array([r[i] for r in out], kinds[i]) for i in range(k)]
        more = pa.ipc.open_stream(pa.py_buffer(group.carried.tobytes())).read_all().combine_chunks() if carries else None
        names = [*names[:k], *(more.column_names if more else [])]
        return pa.RecordBatch.from_arrays([*columns, *((c.chunk(0) if c.num_chunks else pa.array([], c.type)) for c in (more.columns if more else []))], names)

    return finish


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: tuple[float, ...] = CUTS, keep_text: bool = True, hot_pieces: int = HOT_PIECES, index: FingerprintIndex | None = None, as_is: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Returns id, n_words, n_removed, kept_sha256 of every document and, with ``keep_text``, the kept words joined by
    one space (``as_is``: the text as it was, if no word of it is removed), and the columns to ``carry``, which may not
    be named like these. The table is added to an index (a new one, if none is given) in batches that end about at the shares
    ``cuts`` of its ids.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id, here or in the
    index. Null and empty texts have no words, and the digest of nothing. Of rows with the same id none is earlier: they
    are judged each against smaller ids. Rows with a null id keep all words and remove none. Empty tables give empty
    results; other columns are ignored. The result does not depend on ``cuts``.
    """
    spark, extra = df.sparkSession, [f"c{i}" for i in range(len(carry))]
    if {id_col, "n_words", "n_removed", "kept_sha256", "kept"} & set(carry):
        raise ValueError("columns to carry may not be named like the result's")
    more = [F.col(c).alias(e) for c, e in zip(carry, extra, strict=True)]
    named = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    ends = sorted(set(named.agg(F.percentile_approx("doc_id", list(cuts), 10000)).first()[0] or [])) if cuts else []
    if index is None:
        index = FingerprintIndex.create(spark, scratch_dir(spark, "index"), text_bytes(named, "text"), hot_pieces=hot_pieces)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    schema += "".join(f", {e} {t}" for e, t in named.select(*extra).dtypes)
    low, out = None, None
    for high in [*ends, None]:
        part = named if low is None else named.where(F.col("doc_id") > low)
        one = index.add(part if high is None else part.where(F.col("doc_id") <= high), "doc_id", "text", _finish(keep_text, as_is, bool(carry)), schema, tuple(extra))
        out, low = one if out is None else out.unionByName(one), high
    text = F.array_join(F.filter(F.split(F.coalesce(text_col, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
    nameless = df.where(F.col(id_col).isNull()).select(text.alias("own"), F.coalesce(text_col, F.lit("")).alias("text"), *more).select(
        F.lit(None).cast("long").alias("doc_id"), F.when(F.col("own") == "", 0).otherwise(F.size(F.split("own", " "))).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"), F.sha2("own", 256).alias("kept_sha256"), *([F.col("text" if as_is else "own").alias("kept")] if keep_text else []), *extra,
    )
    every = out.unionByName(nameless)
    return every.select(F.col("doc_id").alias(id_col), *every.columns[1 : len(every.columns) - len(extra)], *(F.col(e).alias(c) for c, e in zip(carry, extra, strict=True)))
