"""Substring removal on bytes: what is covered by a 50-byte string that also starts in an earlier document.

Candidates come from anchors (see ``anchors``). Where all texts around an anchor have one 64-bit digest, that digest
decides; where they differ, the different ones go byte for byte into a suffix array that is refined by bucket pointers: suffixes are first put in buckets by their first 8 bytes; a bucket is then split by
sorting its members on the bucket numbers of the suffixes 8 places later, which doubles the depth, and the numbers so
updated serve the next split at 16 and then at 18 places: at depth 50, suffixes with one bucket number are equal
windows. Only buckets with more than one member are sorted again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import HOT_PIECES, REPLY, Scheme, anchor_rows, answers, covered, packed, resolve, sent_hashes, shared_bits
from .common import mix, ranges

WINDOW = 50
GRAM = 24
#: Rows of text that are laid out at a time, and whose suffixes are sorted at a time.
_ROWS = 1 << 14
_SUFFIX_ROWS = 1000


def _eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place, as a number; the last 7 places are padded."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.ndarray((len(data),), "<u8", padded, 0, (1,)))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: The low bytes of a number, from none to all.
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _grams(data: np.ndarray) -> np.ndarray:
    v = mix(_eight(data) * _A)
    n = len(data) - GRAM + 1
    return v[:n] * _A + v[8 : 8 + n] * _B + v[16 : 16 + n] * _C


def _padded(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place, from 80 before the first."""
    return _eight(np.concatenate([np.zeros(80, np.uint8), data, np.zeros(80, np.uint8)]))


def _words(padded: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of 10 numbers for each text: the 80 bytes from ``at``, of which those before ``begin`` and from ``end`` are zero."""
    out = np.empty((len(at), 10), np.uint64)
    for i in range(10):
        out[:, i] = padded[at + (80 + 8 * i)] & _BELOW[np.clip(end - 8 * i, 0, 8)] & ~_BELOW[np.clip(begin - 8 * i, 0, 8)]
    return out


def _digests(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of texts of at most ``2 * WINDOW - GRAM`` bytes, shorter ones padded; some at a time, to bound memory."""
    out, padded = lengths.astype(np.uint64), _padded(data)
    for a in range(0, len(starts), _ROWS):
        h = out[a : a + _ROWS]
        for word in _words(padded, starts[a : a + _ROWS], np.zeros(len(h), np.int64), lengths[a : a + _ROWS]).T:
            h[:] = mix((h ^ word) * _A)
    return out


BYTES = Scheme(WINDOW, GRAM, lambda data, offsets: (data, offsets), _grams, _digests)


def _rows_of(group, place, left, right) -> np.ndarray:
    """The text around each anchor; the anchor is at the same column in every row."""
    return _words(_padded(group.data), place - BYTES.reach, BYTES.reach - left, BYTES.reach + GRAM + right).view(np.uint8)


def refine(buckets: np.ndarray, later: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """New bucket numbers: members of a bucket are sorted by ``later``, the bucket numbers at a later offset. ``wanted``:
    places of members that are split, if not all; a bucket's others keep its number, and count no more.

    A bucket's number is the place of its first member in sorted order, so numbers of split buckets stay in order and
    buckets of one member keep theirs.
    """
    of_wanted = buckets if wanted is None else buckets[wanted]
    several = np.bincount(of_wanted, minlength=len(buckets)) > 1
    open_ = np.flatnonzero(several[of_wanted])
    open_ = open_ if wanted is None else wanted[open_]
    out = buckets.copy()
    key = (buckets[open_].astype(np.uint64) << np.uint64(32)) | later[open_].astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    place = np.arange(len(key))
    first = np.maximum.accumulate(np.where(new, place, 0))
    head = np.append(True, (key[1:] >> np.uint64(32)) != (key[:-1] >> np.uint64(32)))[: len(key)]
    of_bucket = np.maximum.accumulate(np.where(head, place, 0))
    out[open_[order]] = buckets[open_[order]] + (first - of_bucket)
    return out


def suffix_buckets(data: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Bucket numbers of all suffixes of ``data`` at depth 50 (shorter ones padded): equal numbers, equal 50 bytes. If only
    those at ``starts`` count, the last split leaves out all others."""
    n = len(data)
    first = _eight(data).astype(np.uint64)
    order = np.argsort(first)
    new = np.append(True, first[order[1:]] != first[order[:-1]])[:n]
    buckets = np.empty(n, np.int64)
    buckets[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    for offset in (8, 16, 18):  # depths 16, 32 and 50
        later = np.full(n, n, np.int64)
        later[: max(n - offset, 0)] = buckets[offset:]
        buckets = refine(buckets, later, starts if offset == 18 else None)
    return buckets


def _alike(hashes, rows, left, right) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of hash, and the number of each one's class: rows that are the same byte for byte are one class
    (two classes may hold the same bytes, which does no harm)."""
    words = np.ascontiguousarray(rows).view("<u8")
    key = left.astype(np.uint64) << np.uint64(8) | right.astype(np.uint64)
    for i in range(words.shape[1]):
        key = mix((key ^ words[:, i]) * _A)
    order = np.lexsort((key, hashes))
    new = np.append(True, (hashes[order[1:]] != hashes[order[:-1]]) | (key[order[1:]] != key[order[:-1]]))[: len(order)]
    for a in range(1, len(order), _ROWS):
        now, before = order[a : a + _ROWS], order[a - 1 : a + _ROWS - 1][: len(order[a : a + _ROWS])]
        new[a : a + _ROWS] |= (words[now] != words[before]).any(1) | (left[now] != left[before]) | (right[now] != right[before])
    return order, np.cumsum(new) - 1


def _tell_apart(hashes, rows, left, right, least) -> np.ndarray:
    """Least id of each window of each row, by the suffix buckets of all different rows with one anchor or more."""
    order, of = _alike(hashes, rows, left, right)
    firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    heads = order[firsts]
    lowest = np.minimum.reduceat(least[order], firsts) if len(order) else least
    ordered = hashes[heads]
    # equal windows have the same anchor: anchors are taken some at a time, to bound memory
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    steps = [0]
    while steps[-1] < len(heads):
        k = np.searchsorted(cuts, steps[-1] + _SUFFIX_ROWS)
        steps.append(int(cuts[k]) if k < len(cuts) else len(heads))
    begin, count = BYTES.reach - left[heads], left[heads] + right[heads] - BYTES.reach + 1
    ends = np.cumsum(count)
    found = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        sizes = count[a:b] + WINDOW - 1
        text = rows[heads[a:b]].reshape(-1)[ranges(np.arange(b - a) * rows.shape[1] + begin[a:b], sizes)]
        at = ranges(np.cumsum(sizes) - sizes, count[a:b])
        buckets = suffix_buckets(text, at)
        low = np.full(len(buckets), np.iinfo(np.int64).max)
        np.minimum.at(low, buckets[at], np.repeat(lowest[a:b], count[a:b]))
        found[ends[a] - count[a] : ends[b - 1]] = low[buckets[at]]
    own = np.empty(len(order), np.int64)
    own[order] = of
    stops = np.cumsum(count[own])
    out = np.empty(int(stops[-1]) if len(stops) else 0, np.int64)
    for a in range(0, len(own), _ROWS):
        k = own[a : a + _ROWS]
        out[stops[a] - count[k[0]] : stops[min(a + _ROWS, len(own)) - 1]] = found[ranges((ends - count)[k], count[k])]
    return out


def _shared(table: pa.Table, hot_pieces: int) -> pa.Table:
    hashes, several = sent_hashes(table["blob"].to_pylist())
    return answers(table, shared_bits(np.concatenate(hashes), several, hot_pieces), [len(h) for h in hashes])


def _finish(keep_text: bool):
    def finish(group, starts):
        gone, at = covered(starts, WINDOW, len(group.data)), group.offsets
        # removed runs end where a document does
        begins, stops, edge = gone.copy(), gone.copy(), at[:-1][at[:-1] < at[1:]]
        begins[1:] &= ~gone[:-1]
        begins[edge] = gone[edge]
        stops[:-1] &= ~gone[1:]
        stops[edge[1:] - 1] = gone[edge[1:] - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        spans = np.searchsorted(first, at)
        removed = np.concatenate([[0], np.cumsum(last - first)])[spans]
        kept, kept_at = group.data[~gone].tobytes(), at - removed
        rows: list[tuple] = []
        for i, doc in enumerate(group.ids.tolist()):
            own, a = kept[kept_at[i] : kept_at[i + 1]], int(at[i])
            k = slice(int(spans[i]), int(spans[i + 1]))
            cuts = [{"start": x - a, "end": y - a} for x, y in zip(first[k].tolist(), last[k].tolist(), strict=True)] if keep_text else None
            rows.append((doc, int(at[i + 1]) - a, int(removed[i + 1] - removed[i]), k.stop - k.start, hashlib.sha256(own).hexdigest(), own if keep_text else None, cuts))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        k = 7 if keep_text else 5
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(k)], names[:k])

    return finish


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """Returns id, n_bytes, n_removed, n_spans, kept_sha256 of every document and, with ``keep_text``, the kept bytes
    and the removed spans (byte offsets).

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Null and empty texts
    have 0 bytes, and the digest of nothing. Of rows with the same id none is earlier than the other: they are judged
    each against smaller ids. Rows with a null id come last in no order: they keep everything and remove nothing. Empty
    tables give empty results; other columns are ignored. A kept part may be cut inside a character, so it is binary.
    """
    table, plan = packed(df, id_col, text_col)
    masks = anchor_rows(table, BYTES, plan.buckets).groupBy("b").applyInArrow(lambda t: _shared(t, hot_pieces), REPLY)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start: long, end: long>>" * keep_text
    out = resolve(table, masks, BYTES, plan.buckets, _rows_of, _tell_apart, _finish(keep_text), schema)
    nameless = df.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("kept_sha256"),
        *([F.coalesce(text_col, F.lit("")).cast("binary").alias("kept"), F.expr("cast(array() as array<struct<start: long, end: long>>)").alias("spans")] if keep_text else []),
    )
    return out.unionByName(nameless).withColumnRenamed("doc_id", id_col)
