"""Repeated windows of tokens: which windows of a document also start in a document with a smaller id, exactly.

Both substring operators ask this, of 50-byte windows or of 13-word windows. Windows are as many as tokens, so they
are not shuffled. Each window holds a shorter gram whose hash is least in it: its anchor. Equal windows have the same
anchor at the same place, and anchors are few (about two in ``window - gram + 2`` tokens). A window is compared for its
own anchor only, once.

* ``packed``: sets of documents, each in compressed pieces of about 1 MB, written once in buckets of the set's number.
  Later steps recompute anchors from them, and what they ask for comes to them: texts are never shuffled.
* ``anchor_rows``: per set and bucket of hashes, the distinct anchor hashes of its pieces, a few bytes each. Within a
  piece every hash counts once, so a passage that a third of all documents share costs one entry per piece.
* A step of the operator's own finds the hashes that two documents share, and answers with a byte per entry.
* ``resolve``: for shared anchors, a digest of the text around each (all windows whose anchor it is), with the least
  document id. If all texts around an anchor agree, that least id is the answer for all its windows. Only where they
  differ, the texts themselves are sent and told apart by the operator's own method. A hash in very many pieces is
  not gathered under one key: its windows are dealt out by ``STEP`` that start one after the other, by the tokens that
  these share, and those that a piece has several times are sent once.

Between steps a row holds what one set sends to one bucket, as arrays of numbers. Sets grow with the input up to
``MOST_SET``, so such rows are far fewer than entries until inputs reach many terabytes, and never more than entries.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import CHUNK_BYTES, bucketed, giving_back, mix, parts_for, ranges, shuffle_parts, slide, text_bytes, text_chunks

#: Bytes of text that are worked on at a time, of a set at most, of a bucket of anchor hashes, of a written bucket of sets.
PIECE_BYTES = 1 << 20
MOST_SET = 32 << 20
BUCKET_BYTES = 32 << 20
FILE_BYTES = 64 << 20
#: Bytes of entries that a set gathers before it sends them.
FLUSH_BYTES = 24 << 20
#: Sets grow with the input beyond so many: what they send each other would else grow with the square of the input.
MANY_SETS = 1024
_BLOCK = 1 << 15
#: Bits that hold a place in a block and beside it.
_PLACE = np.uint64(2 * _BLOCK - 1)
#: A hash in so many pieces is dealt out by windows, so many at a time.
HOT_PIECES = 1024
STEP = 4
_A = np.uint64(0x9E3779B97F4A7C15)
_UNITS = 1 << 14


@dataclass(frozen=True)
class Scheme:
    """What a token is. ``sequence``: (bytes, offsets) -> (tokens, first token of each row and the end);
    ``gram_hashes``: tokens -> hash of the gram at each place; ``digests``: (tokens, starts, lengths) -> uint64."""

    window: int
    gram: int
    sequence: Callable
    gram_hashes: Callable
    digests: Callable

    @property
    def reach(self) -> int:
        """Tokens beside an anchor that a window with it may hold."""
        return self.window - self.gram


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece of bytes."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return _ZIP.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _expand(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = _UNZIP.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


# ---- documents in sets


@dataclass(frozen=True)
class Layout:
    """How a table is dealt out: bytes of a set, buckets of hashes, written buckets."""

    set_bytes: int
    buckets: int
    files: int


def layout(spark: SparkSession, total_bytes: int) -> Layout:
    """Buckets of hashes are as many as the session has tasks, but none holds less than half of what it may hold. Files are
    never fewer than tasks: Spark would deal rows out anew to read them in more."""
    tasks = shuffle_parts(spark)
    buckets = parts_for(total_bytes, BUCKET_BYTES, min(tasks, parts_for(total_bytes, BUCKET_BYTES // 2, 1)))
    return Layout(min(max(total_bytes // min(4 * tasks, MANY_SETS), PIECE_BYTES), MOST_SET), buckets, parts_for(total_bytes, FILE_BYTES, tasks))


PACKED = "s long, least long, greatest long, metas array<binary>, bodies array<binary>"


def pack(df: DataFrame, id_col: str, text_col: str, set_bytes: int, batch: int = 0, piece_bytes: int = PIECE_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Sets of documents with a non-null id: number, least and greatest id, pieces as ``unpack`` reads them. Columns to
    ``carry`` go along with their rows."""
    kinds = [*[pa.int64()] * 3, *[pa.list_(pa.binary())] * 2]
    names = ["s", "least", "greatest", "metas", "bodies"]

    def piece(ids, sizes, texts, carried):
        sink = pa.BufferOutputStream()
        if carry:
            with pa.ipc.new_stream(sink, carried[0].schema) as stream:
                for some in carried:
                    stream.write_batch(some)
        return _squeeze(np.concatenate(ids), np.concatenate(sizes), np.frombuffer(sink.getvalue(), np.uint8)), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))

    def run(batches):
        number, held = batch << 50 | TaskContext.get().partitionId() << 24, 0
        ids, sizes, texts, carried, size, seen, pieces = [], [], [], [], 0, [], []

        def out():
            every = np.concatenate(seen)
            row = [number, int(every.min()), int(every.max()), [m for m, _ in pieces], [b for _, b in pieces]]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names)

        for rows in batches:
            own = rows.column(0).to_numpy()
            for a, b, data, offsets in text_chunks(rows, "text", min(CHUNK_BYTES, piece_bytes)):
                ids.append(own[a:b].copy())
                sizes.append(np.diff(offsets))
                texts.append(data.tobytes())
                carried.append(rows.slice(a, b - a).select(extra) if carry else None)
                size += len(data)
                if size >= piece_bytes:
                    pieces.append(piece(ids, sizes, texts, carried))
                    seen += ids
                    held += size
                    ids, sizes, texts, carried, size = [], [], [], [], 0
                    if held >= set_bytes:
                        yield out()
                        number, held, seen, pieces = number + 1, 0, [], []
        if ids:
            pieces.append(piece(ids, sizes, texts, carried))
            seen += ids
        if pieces:
            yield out()

    extra = [f"c{i}" for i in range(len(carry))]
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(e) for c, e in zip(carry, extra, strict=True)))
    return docs.where("doc_id is not null").mapInArrow(giving_back(run), PACKED)


def packed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Layout]:
    """A written table of sets, in buckets of ``s``, and its layout."""
    plan = layout(df.sparkSession, text_bytes(df, text_col))
    return bucketed(pack(df, id_col, text_col, plan.set_bytes), "packed", "s", plan.files), plan


def unpack(meta: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes, carried columns as an Arrow stream) of a piece."""
    ids, sizes, carried = _expand(meta, np.int64, np.int64, np.uint8)
    raw = _UNZIP.decompress(body) if len(body) else b""
    return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.frombuffer(raw, np.uint8), carried


# ---- anchors


def find_anchors(scheme: Scheme, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, left, right) of the anchors of rows of tokens laid end to end; windows never cross rows. Of equal
    least hashes in a window the first is its anchor. ``left`` and ``right``: tokens beside an anchor in the windows whose
    anchor it is, which start one after the other. Works in blocks, so one long text needs no more memory than many short ones."""
    w, q = scheme.window, scheme.gram
    found = []
    for lo in range(0, len(tokens), _BLOCK):
        first, last = max(0, lo - w), min(len(tokens), lo + _BLOCK + w)
        part = tokens[first:last]
        if len(part) < w:
            continue
        h = scheme.gram_hashes(part)
        # a number in the order of the leading bits of the hash, then of the place
        least = slide(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), w - q + 1, np.minimum)  # of the window that starts at each place
        at = (least & _PLACE).astype(np.int64)
        ends = bounds[1:][np.searchsorted(bounds[1:], first, "right") : np.searchsorted(bounds[1:], last, "right")] - first
        cut = np.maximum(ends - w + 1, 0)
        bad = ranges(cut, np.minimum(ends, len(at)) - cut)
        at[bad[bad < len(at)]] = -1
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        end, place = np.append(begin[1:], len(at)) - 1, at[begin]
        own = (place >= max(lo - first, 0)) & (place < lo - first + _BLOCK)
        begin, end, place = begin[own], end[own], place[own]
        found.append((place + first, h[place], place - begin, end + w - place - q))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Group:
    """A piece's anchors, in order of bucket and hash."""

    def __init__(self, scheme: Scheme, meta: bytes, body: bytes, buckets: int):
        self.scheme = scheme
        self.ids, self.offsets, self.data, self.carried = unpack(meta, body)
        self.tokens, self.bounds = scheme.sequence(self.data, self.offsets)
        places, hashes, left, right = find_anchors(scheme, self.tokens, self.bounds)
        hashes = mix(hashes * _A)  # the least of many are small: spread anew, one to one, so that buckets fill alike
        order = np.argsort(hashes, kind="stable")
        self.places, self.hashes, self.left, self.right = places[order], hashes[order], left[order], right[order]
        self.rows = np.searchsorted(self.bounds, self.places, "right") - 1
        # distinct hashes; buckets follow the leading bits, so each is a range of them
        new = np.append(True, self.hashes[1:] != self.hashes[:-1])[: len(self.hashes)]
        self.firsts = np.flatnonzero(new)
        self.number = np.cumsum(new) - 1  # of the distinct hash of each anchor
        self.distinct = self.hashes[self.firsts]
        self.bucket = ((self.distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        docs = self.ids[self.rows]
        least, most = (f.reduceat(docs, self.firsts) if len(docs) else docs for f in (np.minimum, np.maximum))
        self.several = least != most  # documents in this piece with the hash


# ---- what sets and buckets send each other


def sets_of(batches):
    """Rows as dictionaries, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _runs(x: np.ndarray):
    """(value, first, one past the last) of runs of equal values."""
    firsts = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return zip(x[firsts].tolist(), firsts.tolist(), np.append(firsts, len(x))[1:].tolist(), strict=True)


SENT = "b long, s long, part int, blob binary"
REPLY = "s long, b long, part int, reply binary"


class _Sender:
    """Gathers a set's entries, piece by piece, and sends them by bucket: a row for each bucket and part."""

    def __init__(self, s: int, most: int):
        self.s, self.most, self.part, self.size, self.held = s, most, 0, 0, []

    def add(self, bucket: np.ndarray, *columns: np.ndarray):
        """Entries of a piece in order of bucket; yields rows if enough have gathered. Entries of one piece and bucket
        must come in one call."""
        if len(bucket):
            self.held.append((bucket, *columns))
            self.size += sum(c.nbytes for c in columns)
        if self.size >= self.most:
            yield self.rows()

    def rows(self) -> pa.RecordBatch:
        names, blobs = [], []
        if self.held:
            bucket, *columns = (np.concatenate(c) for c in zip(*self.held, strict=True))
            order = np.argsort(bucket, kind="stable")
            for b, x, y in _runs(bucket[order]):
                names.append(b)
                blobs.append(_squeeze(*(c[order[x:y]] for c in columns)))
        n, part = len(names), self.part
        self.held, self.size, self.part = [], 0, part + 1
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([self.s] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(blobs, pa.binary())], ["b", "s", "part", "blob"])


class _Replies:
    """All buckets' answers to a set, taken in the order in which entries were sent; those to one part are held at a time."""

    def __init__(self, rows: list[dict] | None):
        self.parts: dict[int, list[tuple[int, bytes]]] = {}
        for r in rows or []:
            self.parts.setdefault(r["part"], []).append((r["b"], r["reply"]))
        self.ahead, self.left = sorted(self.parts, reverse=True), 0

    def take(self, bucket: np.ndarray, kind, sizes: np.ndarray | None = None) -> np.ndarray:
        """Answers to entries that were sent in one call, in order of bucket; ``sizes``: values of each, if not one."""
        if not len(bucket):
            return np.zeros(0, kind)
        if not self.left:  # a part's entries are taken before the next part's are
            some = sorted(self.parts.pop(self.ahead.pop()))
            values = [_expand(blob, kind)[0] for _, blob in some]
            self.b, self.values = np.array([b for b, _ in some]), np.concatenate(values)
            self.at = np.cumsum([0, *(len(x) for x in values[:-1])])
            self.left = len(self.values)
        firsts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        lengths = np.diff(np.append(firsts, len(bucket))) if sizes is None else np.add.reduceat(sizes, firsts)
        k = np.searchsorted(self.b, bucket[firsts])
        out = self.values[ranges(self.at[k], lengths)]
        self.at[k] += lengths
        self.left -= len(out)
        return out


def _by_set(replies: DataFrame, name: str) -> DataFrame:
    """All replies to a set in one row: as many as it sent."""
    return replies.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("b", "part", "reply"))).alias(name))


def answers(table: pa.Table, values: np.ndarray, sizes: list[int]) -> pa.Table:
    """Replies to the rows of one bucket: ``values`` laid end to end, so many to each row."""
    blobs = [_squeeze(x) for x in np.split(values, np.cumsum(sizes)[:-1])]
    return pa.table([table["s"], table["b"], table["part"], pa.array(blobs, pa.binary())], ["s", "b", "part", "reply"])


def _low(hashes: np.ndarray) -> np.ndarray:
    """The low 40 bits of each: with the bucket's leading bits enough to be rarely wrong, and a wrong hit is found out."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def anchor_rows(table: DataFrame, scheme: Scheme, buckets: int) -> DataFrame:
    """Of each set, its pieces' distinct anchor hashes by bucket, and whether two documents of the piece have them."""

    most = FLUSH_BYTES

    def run(batches):
        for r in sets_of(batches):
            send = _Sender(r["s"], most)
            for meta, body in zip(r["metas"], r["bodies"], strict=True):
                group = Group(scheme, meta, body, buckets)
                yield from send.add(group.bucket, _low(group.distinct), group.several)
            yield send.rows()

    return table.select("s", "metas", "bodies").mapInArrow(giving_back(run), SENT)


def sent_hashes(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes of each row of ``anchor_rows`` in one bucket, and for all end to end whether a piece has them twice."""
    hashes, several = [], [np.zeros(0, bool)]
    for blob in blobs:
        low, twice = _expand(blob, np.uint8, bool)
        out = np.zeros((len(twice), 8), np.uint8)
        out[:, :5] = low.reshape(-1, 5)
        hashes.append(out.view("<u8")[:, 0].astype(np.uint64))
        several.append(twice)
    return hashes, np.concatenate(several)


#: What a hash of a piece is: shared with another document; in very many pieces.
SHARED, HOT = 1, 2


def shared_bits(every: np.ndarray, several: np.ndarray, hot_pieces: int = HOT_PIECES) -> np.ndarray:
    """SHARED and HOT of the distinct hashes of some pieces, end to end."""
    order = np.argsort(every, kind="stable")
    new = np.append(True, every[order[1:]] != every[order[:-1]])[: len(every)]
    count = np.diff(np.append(np.flatnonzero(new), len(every)))[np.cumsum(new) - 1]
    out = np.empty(len(every), np.uint8)
    out[order] = (count > 1) * np.uint8(SHARED) | (count >= hot_pieces) * np.uint8(HOT)
    return out | several.astype(np.uint8)


def listed(shared: np.ndarray, hot: np.ndarray) -> bytes:
    """An answer to a set whose entries aren't at hand: the low bits of the hashes. Its ``part`` is -1."""
    return _squeeze(shared, hot)


LOW = np.uint64((1 << 40) - 1)


class _Marks:
    """Which hashes of a set's pieces are shared or hot: by answers to all its entries or, of an earlier batch, by lists."""

    def __init__(self, rows: list[dict]):
        self.lists = {r["b"]: _expand(r["reply"], np.uint64, np.uint64) for r in rows if r["part"] < 0}
        self.replies = _Replies([r for r in rows if r["part"] >= 0])

    def of(self, group: Group) -> np.ndarray:
        if self.replies.parts or self.replies.left:
            return self.replies.take(group.bucket, np.uint8)
        out = np.zeros(len(group.distinct), np.uint8)
        for b, x, y in _runs(group.bucket) if self.lists else ():
            if b in self.lists:
                low, (shared, hot) = group.distinct[x:y] & LOW, self.lists[b]
                out[x:y] = np.isin(low, shared) * np.uint8(SHARED) | np.isin(low, hot) * np.uint8(HOT)
        return out


# ---- what is shared


class _Shared:
    """A piece's shared anchors, told apart by the digest of the text around them."""

    def __init__(self, group: Group, marks: np.ndarray):
        s = group.scheme
        pick = np.flatnonzero((marks & SHARED)[group.number])
        place, row, left, right = group.places[pick], group.rows[pick], group.left[pick], group.right[pick]
        digest = s.digests(group.tokens, place - left, left + s.gram + right)
        digest = mix((digest ^ (left.astype(np.uint64) + (right.astype(np.uint64) << np.uint64(20)))) * _A)
        order = np.lexsort((digest, group.number[pick]))
        self.group, self.place, self.row, self.left, self.right = group, place[order], row[order], left[order], right[order]
        number, digest = group.number[pick][order], digest[order]
        new = np.append(True, (number[1:] != number[:-1]) | (digest[1:] != digest[:-1]))[: len(order)]
        #: anchors with one hash and digest are one class
        self.firsts, self.of = np.flatnonzero(new), np.cumsum(new) - 1
        self.digest, self.hash = digest[self.firsts], group.distinct[number[self.firsts]]
        self.bucket = group.bucket[number[self.firsts]]
        self.cold = np.flatnonzero(~(marks & HOT).astype(bool)[number[self.firsts]])
        docs = group.ids[self.row]
        self.least = np.minimum.reduceat(docs, self.firsts) if len(docs) else docs

    def agreed(self, replies: _Replies) -> np.ndarray:
        """Least id of each class; -1 where the texts around its anchor differ, or were not compared."""
        out = np.full(len(self.least), -1, np.int64)
        out[self.cold] = replies.take(self.bucket[self.cold], np.int64)
        return out

    def units(self, least: np.ndarray, buckets: int) -> _Units:
        """What is sent of the classes without an answer."""
        return _Units(self, least, buckets)


class _Units:
    """Texts to be told apart, in order of bucket: the text around the anchor of a class or, of hot hashes, each different
    text of ``STEP`` windows in the piece, whose key is a digest of what these share. ``least``: the least id in the piece."""

    def __init__(self, x: _Shared, least: np.ndarray, buckets: int):
        s, tokens = x.group.scheme, x.group.tokens
        is_cold = np.zeros(len(least), bool)
        is_cold[x.cold] = True
        cold, hot = np.flatnonzero((least < 0) & is_cold), np.flatnonzero((least < 0) & ~is_cold)
        place, left, right = x.place[x.firsts], x.left[x.firsts], x.right[x.firsts]
        count = left + right - s.reach + 1
        # units of hot hashes: windows with from low to high tokens left of the anchor
        g = (s.reach - right[hot]) // STEP
        n = left[hot] // STEP - g + 1
        owner, shared = np.repeat(hot, n), ranges(g, n) * STEP
        low, high = np.maximum(shared, s.reach - right[owner]), np.minimum(shared + STEP - 1, left[owner])
        start, size = place[owner] - high, high + s.gram + s.reach - low
        key = s.digests(tokens, place[owner] - shared, shared + s.gram + s.reach - np.minimum(shared + STEP - 1, s.reach))
        own = s.digests(tokens, start, size)
        own = mix((own ^ (high.astype(np.uint64) + (low.astype(np.uint64) << np.uint64(20)))) * _A)
        order = np.argsort(own)
        new = np.append(True, own[order[1:]] != own[order[:-1]])[: len(order)]
        now, before = order[np.flatnonzero(~new)], order[np.flatnonzero(~new) - 1]
        differ = (high[now] != high[before]) | (low[now] != low[before])
        for k in range(s.window + STEP - 1):  # as they are: the digest alone doesn't decide
            differ |= (k < size[now]) & (tokens[np.minimum(start[now] + k, len(tokens) - 1)] != tokens[np.minimum(start[before] + k, len(tokens) - 1)])
        new[~new] = differ
        firsts = np.flatnonzero(new)
        heads, of = order[firsts], np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        lowest = np.minimum.reduceat(x.least[owner][order], firsts) if len(order) else x.least[:0]
        by = ((key[heads] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        parts = (
            (place[cold], place[owner[heads]]), (left[cold], high[heads]), (right[cold], s.reach - low[heads]),
            (x.bucket[cold], by), (x.hash[cold], key[heads]), (x.least[cold], lowest),
        )
        columns = [np.concatenate(p) for p in parts]
        order = np.argsort(columns[3], kind="stable")
        self.place, self.left, self.right, self.bucket, self.key, self.least = (c[order] for c in columns)
        self.wide = self.left + self.right - s.reach + 1
        # where the windows of the open classes, end to end, find their values in those of the units, end to end
        value_at = np.empty(len(order), np.int64)
        value_at[order] = np.cumsum(self.wide) - self.wide
        open_ = np.flatnonzero(least < 0)
        self.base = np.zeros(len(least), np.int64)
        self.base[open_] = np.cumsum(count[open_]) - count[open_]
        self.value_of = np.empty(int(count[open_].sum()), np.int64)
        self.value_of[ranges(self.base[cold], count[cold])] = ranges(value_at[: len(cold)], count[cold])
        h = np.repeat(np.arange(len(hot)), count[hot])
        k = left[hot][h] - ranges(np.zeros(len(hot), np.int64), count[hot])
        unit = (np.cumsum(n) - n)[h] + k // STEP - g[h]
        self.value_of[ranges(self.base[hot], count[hot])] = value_at[len(cold) :][of[unit]] + high[unit] - k

    def some(self):
        """Slices of about ``_UNITS`` units; those of a bucket are not parted."""
        ends = np.append(np.flatnonzero(self.bucket[1:] != self.bucket[:-1]) + 1, len(self.bucket))
        a = 0
        while a < len(self.bucket):
            b = int(ends[np.searchsorted(ends, min(a + _UNITS, len(self.bucket)))])
            yield slice(a, b)
            a = b


def _agreed(table: pa.Table) -> pa.Table:
    """One bucket: for each class its least id over all pieces, or -1 if its hash has other classes too."""
    parts = [_expand(x, np.uint64, np.uint64, np.int64) for x in table["blob"].to_pylist()]
    h, d, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((d, h))
    hs, dig = h[order], d[order]
    new_h = np.append(True, hs[1:] != hs[:-1])
    new = new_h | np.append(True, dig[1:] != dig[:-1])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    one = (np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_h)) == 1)[np.cumsum(new_h) - 1]
    out = np.empty(len(h), np.int64)
    out[order] = np.where(one, least, -1)
    return answers(table, out, [len(p[0]) for p in parts])


def resolve(table: DataFrame, masks: DataFrame, scheme: Scheme, buckets: int, windows_of: Callable, tell_apart: Callable, finish: Callable, schema: str, targets=None) -> DataFrame:
    """Rows of ``finish(piece, starts of removed windows)`` for every piece (of sets in ``targets``, a Column, if given).

    ``masks``: (s, b, part, reply) to the sets' anchor hashes. Where texts around an anchor differ: ``windows_of(piece,
    place, left, right)`` is a matrix with a row of bytes for each class, and ``tell_apart(hashes, rows, left, right,
    least)`` gives, for each row, the least id for each of its ``left + right - reach + 1`` windows, end to end.
    """
    reach, most = scheme.reach, FLUSH_BYTES
    asked = table.select("s", "metas", "bodies").join(_by_set(masks, "masks"), "s")

    def shared(r):
        marks = _Marks(r["masks"])
        for meta, body in zip(r["metas"], r["bodies"], strict=True):
            group = Group(scheme, meta, body, buckets)
            yield _Shared(group, marks.of(group))

    def classes(batches):
        for r in sets_of(batches):
            send = _Sender(r["s"], most)
            for x in shared(r):
                k = x.cold
                yield from send.add(x.bucket[k], x.hash[k], x.digest[k], x.least[k])
            yield send.rows()

    agreed = asked.mapInArrow(giving_back(classes), SENT).groupBy("b").applyInArrow(_agreed, REPLY)
    asked = asked.join(_by_set(agreed, "agreed"), "s", "left")

    def details(batches):
        for r in sets_of(batches):
            send, agreed = _Sender(r["s"], most), _Replies(r["agreed"])
            for x in shared(r):
                u = x.units(x.agreed(agreed), buckets)
                for k in u.some():
                    rows = windows_of(x.group, u.place[k], u.left[k], u.right[k])
                    yield from send.add(u.bucket[k], u.key[k], u.left[k].astype(np.uint8), u.right[k].astype(np.uint8), u.least[k], rows)
            yield send.rows()

    def told(sent: pa.Table) -> pa.Table:
        parts = [_expand(x, np.uint64, np.uint8, np.uint8, np.int64, np.uint8) for x in sent["blob"].to_pylist()]
        h, left, right, least, rows = (np.concatenate(c) for c in zip(*parts, strict=True))
        sizes = [int((p[1].astype(np.int64) + p[2] - reach + 1).sum()) for p in parts]
        del parts
        return answers(sent, tell_apart(h, rows.reshape(len(h), -1), left.astype(np.int64), right.astype(np.int64), least), sizes)

    apart = asked.mapInArrow(giving_back(details), SENT).groupBy("b").applyInArrow(told, REPLY)
    last = table if targets is None else table.where(targets)
    last = last.select("s", "metas", "bodies").join(asked.select("s", "masks", "agreed"), "s", "left").join(_by_set(apart, "apart"), "s", "left")

    def final(batches):
        for r in sets_of(batches):
            agreed, apart = _Replies(r["agreed"]), _Replies(r["apart"])
            for x in shared(r | {"masks": r["masks"] or []}):
                group, least = x.group, x.agreed(agreed)
                doc = group.ids[x.row]
                begin, count = x.place - x.left, x.left + x.right - reach + 1
                whole = (least[x.of] >= 0) & (least[x.of] < doc)
                starts = [ranges(begin[whole], count[whole])]
                # the least id of each window of the classes without one answer, end to end
                u = x.units(least, buckets)
                told = [apart.take(u.bucket[k], np.int64, u.wide[k]) for k in u.some()]
                value = (np.concatenate(told) if told else np.zeros(0, np.int64))[u.value_of]
                rest = np.flatnonzero(least[x.of] < 0)
                for a in range(0, len(rest), _UNITS):
                    i = rest[a : a + _UNITS]
                    at = ranges(begin[i], count[i])
                    starts.append(at[value[ranges(u.base[x.of[i]], count[i])] < np.repeat(doc[i], count[i])])
                yield finish(group, np.concatenate(starts))

    return last.mapInArrow(giving_back(final), schema)


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` tokens a window covers that starts at one of ``starts``."""
    begun = np.zeros(n + 1, np.int32)
    begun[starts + 1] = 1
    begun = np.cumsum(begun, dtype=np.int32)
    before = np.concatenate([np.zeros(min(window, n), np.int32), begun[1 : max(n - window, 0) + 1]])
    return begun[1:] > before
