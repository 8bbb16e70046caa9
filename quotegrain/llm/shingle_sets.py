"""Near-duplicates by the exact Jaccard similarity of shingle sets.

Candidates come from SimHash fingerprints of the sets, through their inverted index of byte positions with count filtering
(``simhash_index``). For low similarities, which take many fingerprints, there are bands of minimum hashes instead
(``index="bands"``): each text with ``BAND`` minima a band is listed once for each band, and
texts of one list are candidates of each other. There are so many bands that a pair at the similarity shares no list
with a probability of at most ``MISS``. Candidates are compared inside their lists only, by sketches: one byte of each
of their minima. Texts of which enough bytes agree are linked: first each with its list's least text, and what this
leaves over with each other, large lists block by block. Either way texts that merely share lists are never gathered.
The sets of a component of these links then meet in one task (large ones: block by block, each block with each), which
computes the similarity of every pair that could still connect anything, and returns a forest of the links found.
Sets stand for the texts that have them, so copies cost nothing. Documents lie in written buckets, and only the texts
of candidates are sent anywhere.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F

from .anchors import layout, pack, sets_of, unpack
from .common import bucketed, giving_back, mix, ranges, shuffle_parts, text_bytes, written
from .components import components
from .simhash_index import MISS, bits, fingerprint_matrix, links as fingerprint_links, width_at

SEED = 42
SIMILARITY = 0.8
#: Minima of a band; ``MISS`` is the share of pairs just at the similarity that may share no band.
BAND = 5
#: Shingles of a block: a task holds two blocks of one group at a time.
BLOCK = 1 << 20
#: Times that the texts left of a list are compared with the least of them first.
STARS = 1
#: Sketches of a block of those.
SKETCHES = 1024
_ROW, _NONE = "_row_number_", "_no_text_"


def bands_at(similarity: float, miss: float = MISS, band: int = BAND) -> int:
    """Bands of which a pair at this similarity shares at least one, but for a probability of ``miss``."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity is above 0 and at most 1")
    return 1 if similarity == 1 else math.ceil(math.log(miss) / math.log1p(-(similarity**band)))


def agreeing(similarity: float, minima: int, miss: float = MISS) -> int:
    """So many of these minima agree at this similarity, but for a probability of ``miss`` times a ten-thousandth."""
    p, most, below = similarity, 0, 0.0
    for k in range(minima + 1):
        below += math.comb(minima, k) * p**k * (1 - p) ** (minima - k)
        if below > miss / 1e4:
            break
        most = k + 1
    return most


def shingles(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words of a text in UTF-8, A-Z lower-cased; a shorter text is one run."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64))


def _name(found: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set."""
    return np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)


def _minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of a set under each hash function."""
    least = np.full(factors.size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, mix(found[at : at + 4096, None] * factors.reshape(-1)).min(0))
    return least


def _bands(least: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key for each band (row of ``factors``) of a set's minima."""
    key = np.arange(1, len(factors) + 1, dtype=np.uint64)
    for column in least.reshape(factors.shape).T:
        key = mix((key ^ column) * factors[0, 0])
    return key.view(np.int64)


def _forest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first one of its component, of links at ``similarity`` or more."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    rows = np.repeat(np.arange(m), sizes)
    holders = rows[np.argsort(codes, kind="stable")]
    counts = np.bincount(codes)
    firsts, starts = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes

    def near(x: int) -> np.ndarray:
        own = codes[starts[x] : starts[x] + sizes[x]]
        both = np.bincount(holders[ranges(firsts[own], counts[own])], minlength=m)
        return both / np.maximum(sizes[x] + sizes - both, 1) >= similarity

    roots, rest = np.arange(m), np.ones(m, bool)
    while rest.any():
        root = int(rest.argmax())
        rest[root] = False
        front = np.array([root])
        while len(front):
            others = np.flatnonzero(rest)
            if not len(others):
                break
            hit = np.zeros(m, bool)
            if len(front) <= len(others):
                for x in front:
                    hit |= near(x)
                    if hit[others].all():
                        break
            else:
                for y in others:
                    hit[y] = near(y)[front].any()
            front = np.flatnonzero(hit & rest)
            rest[front], roots[front] = False, root
    return roots


def _packed(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Rows in written sets (see ``anchors``), numbered anew, with their id, whether they have a text, and columns to keep."""
    plan = layout(df.sparkSession, text_bytes(df, text_col))
    rows = df.withColumns({_ROW: F.monotonically_increasing_id(), _NONE: F.col(text_col).isNull()})
    return bucketed(pack(rows, _ROW, text_col, plan.set_bytes, carry=(id_col, _NONE, *keep)), "documents", "s", plan.files)


def _pieces(batches):
    """(row of the table, numbers of documents, their texts' bounds, bytes, carried columns) of each piece."""
    for r in sets_of(batches):
        for meta, body in zip(r["metas"], r["bodies"], strict=True):
            numbers, offsets, data, carried = unpack(meta, body)
            yield r, numbers, offsets, data, pa.ipc.open_stream(pa.py_buffer(carried.tobytes())).read_all().combine_chunks()


def _plain(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _marks(index: str, similarity: float, seed: int):
    """Columns by which an index finds candidates, and their values for a set of shingles; bands are null for no shingle."""
    if index == "fingerprints":
        width = width_at(similarity)
        return {"fps": ("binary", pa.binary())}, lambda found: (bits(found, width).tobytes(),)
    if index != "bands":
        raise ValueError("an index is of fingerprints or of bands")
    factors = np.random.default_rng(seed).integers(0, 1 << 64, (bands_at(similarity), BAND), np.uint64) | np.uint64(1)

    def marks(found: np.ndarray):
        least = _minima(found, factors)
        return _bands(least, factors) if len(found) else None, least.astype(np.uint8).tobytes()

    return {"bands": ("array<long>", pa.list_(pa.int64())), "sketch": ("binary", pa.binary())}, marks


def _documents(table: DataFrame, kind: str, words: int, seed: int, columns: dict, marks) -> DataFrame:
    """(doc_id, s, number, a, b: the set's name, n: its size, marks) of each document."""

    def run(batches):
        for r, numbers, offsets, data, carried in _pieces(batches):
            names, sizes, marked = np.zeros((len(numbers), 2), np.int64), np.zeros(len(numbers), np.int64), []
            for i in range(len(numbers)):
                found = shingles(data[offsets[i] : offsets[i + 1]].tobytes(), words, seed)
                names[i], sizes[i] = _name(found), len(found)
                marked.append(marks(found))
            a, b = (pa.array(np.ascontiguousarray(c)) for c in names.T)
            more = [pa.array([m[k] for m in marked], kind) for k, (_, kind) in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([_plain(carried.column(0)), pa.array(np.full(len(numbers), r["s"])), pa.array(numbers), a, b, pa.array(sizes), *more], ["doc_id", "s", "number", "a", "b", "n", *columns])

    return table.select("s", "metas", "bodies").mapInArrow(giving_back(run), f"doc_id {kind}, s long, number long, a long, b long, n long, " + ", ".join(f"{c} {k}" for c, (k, _) in columns.items()))


def _agreed(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """(a, first, near) of pairs (a, first): whether enough bytes of their sketches agree."""
    met = pairs.join(sketches, "a").join(sketches.select(F.col("a").alias("first"), F.col("sketch").alias("other")), "first").select("a", "first", "sketch", "other")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                near = (fingerprint_matrix(some.column(2)) == fingerprint_matrix(some.column(3))).sum(1) >= least
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(near)], ["a", "first", "near"])

    return met.mapInArrow(run, "a long, first long, near boolean")


def _met_by_lists(index: DataFrame, least: int) -> DataFrame:
    """(u, v) links that connect all agreeing texts of a list; lists of more than a block are dealt out by blocks."""
    sizes = index.groupBy("list").count().where("count > 1").select("list", F.ceil(F.col("count") / SKETCHES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * F.col("blocks") + F.greatest(j, own))
    dealt = index.join(sizes, "list").select("list", F.explode(tasks).alias("task"), "a", "sketch")
    dealt = dealt.repartition(shuffle_parts(index.sparkSession), "list", "task").sortWithinPartitions("list", "task")

    def links_of(texts, sketches):
        if len(texts) < 2:
            return []
        rest, out = np.arange(len(texts)), []
        sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(texts), -1)
        while len(rest):
            front, rest = rest[:1], rest[1:]
            root = front[0]
            while len(front) and len(rest):
                near = np.zeros(len(rest), bool)
                for x in front:
                    near |= (sketches[rest] == sketches[x]).sum(1) >= least
                front, rest = rest[near], rest[~near]
                out += [(texts[x], texts[root]) for x in front]
        return out

    def run(batches):
        at, texts, sketches = None, [], []
        for batch in batches:
            out = []
            for list_, task, a, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (list_, task) != at:
                    out += links_of(texts, sketches)
                    at, texts, sketches = (list_, task), [], []
                texts.append(a)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], ["u", "v"])
        out = links_of(texts, sketches)
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _candidate_links(nodes: DataFrame, least: int) -> DataFrame:
    """(u, v) of the names' first halves: links of texts that share a list and whose sketches agree. Two sets with one
    first half are in one group, which does no harm: groups only say what is compared. Sketches go where they are
    compared only: once for each pair of a text and a list's least text, whatever the lists that they share."""
    index, sketches, links = nodes.select("a", F.explode("bands").alias("list")), nodes.select("a", "sketch").dropDuplicates(["a"]), []
    most = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    for _ in range(STARS):
        heads = index.groupBy("list").agg(F.min("a").alias("first"), F.max("a").alias("last")).where("first < last").select("list", "first")
        members = written(index.join(heads, "list").where("a <> first").select("list", "a", "first"), "members", most)
        seen = written(_agreed(members.select("a", "first").distinct(), sketches, least), "stars", most)
        links.append(seen.where("near").select(F.col("a").alias("u"), F.col("first").alias("v")))
        index = members.join(seen.where("not near").select("a", "first"), ["a", "first"]).select("list", "a")
    links.append(_met_by_lists(index.join(sketches, "a"), least))
    return reduce(DataFrame.unionByName, links)


def _verified(table: DataFrame, nodes: DataFrame, words: int, similarity: float, seed: int, index: str) -> DataFrame:
    """(a, b, component: a and b of one set of its component) of sets that have a link, some of them repeated."""
    spark = table.sparkSession
    count = nodes.count()
    if index == "fingerprints":
        # a forest for each of the two classes that a set is listed in
        groups = components(fingerprint_links(nodes.where("n > 0"), similarity), count * 2)
    else:
        bands = bands_at(similarity)
        groups = components(_candidate_links(nodes, agreeing(similarity, bands * BAND)), count * bands)
    asked = nodes.join(groups.withColumnRenamed("node", "a"), "a").select(F.col("component").alias("group"), "n", "text.*")
    asked = written(asked, "candidates", count, 64)
    large = asked.groupBy("group").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large = written(large, "large", count)
    # what is asked of a set of documents comes to it; only the texts of candidates leave
    by_set = asked.join(large, "group", "left").groupBy("s").agg(F.collect_list(F.struct("number", "group", "blocks")).alias("asked"))

    def texts(batches):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for r, numbers, offsets, data, _ in _pieces(batches):
            place = {number: i for i, number in enumerate(numbers.tolist())}
            rows = [(q["group"], q["number"], q["blocks"], place[q["number"]]) for q in r["asked"] if q["number"] in place]
            out = [(g, n, k, data[offsets[i] : offsets[i + 1]].tobytes()) for g, n, k, i in rows]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kinds[c]) for c in range(4)], ["group", "number", "blocks", "text"])

    met = table.select("s", "metas", "bodies").join(by_set, "s").mapInArrow(giving_back(texts), "group long, number long, blocks int, text binary")
    own = F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")
    # each block meets each: task (i, j), i <= j, holds the texts of both
    tasks = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * F.col("blocks") + F.greatest(j, own))
    )
    dealt = met.select("group", F.explode(tasks).alias("task"), "text")
    dealt = dealt.repartition(shuffle_parts(spark), "group", "task").sortWithinPartitions("group", "task")

    def links_of(sets):
        names = np.array([_name(s) for s in sets])
        roots = _forest(sets, similarity)
        linked = np.flatnonzero(roots != np.arange(len(sets)))
        return np.concatenate([names[linked], names[roots[linked]]], 1)

    def run(batches):
        at, sets = None, []
        for batch in batches:
            out = [np.zeros((0, 4), np.int64)]
            for group, task, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (group, task) != at:
                    if len(sets) > 1:
                        out.append(links_of(sets))
                    at, sets = (group, task), []
                sets.append(shingles(text.as_py(), words, seed))
            yield batch_of(out)
        if len(sets) > 1:
            yield batch_of([links_of(sets)])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T], ["a", "b", "root_a", "root_b"])

    links = dealt.mapInArrow(giving_back(run), "a long, b long, root_a long, root_b long").where("a <> root_a or b <> root_b").distinct()
    root = F.struct(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    if not large.head(1):
        return links.select("a", "b", root.alias("component"))
    found = components(links.select(F.struct("a", "b").alias("u"), root.alias("v")))
    return found.select("node.a", "node.b", "component")


def _judged(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float, seed: int, keep: list[str], index: str) -> tuple[DataFrame, DataFrame]:
    """The packed table, and (doc_id, s, number, component_id) of each of its documents."""
    kind = dict(df.dtypes)[id_col]
    columns, marks = _marks(index, similarity, seed)
    table = _packed(df, id_col, text_col, keep)
    docs = written(_documents(table, kind, words, seed, columns, marks), "shingles")
    nodes = docs.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.min(F.struct("s", "number")).alias("text"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in columns))
    nodes = written(nodes, "nodes", docs.count(), 512)
    found = _verified(table, nodes, words, similarity, seed, index)
    own = F.struct("a", "b")
    member = nodes.select("a", "b", "least").join(found, ["a", "b"], "left").withColumn("component", F.coalesce("component", own))
    member = written(member, "members", nodes.count(), 64)
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = member.join(least, "component").select("a", "b", "component_id").distinct()
    return table, docs.select("doc_id", "s", "number", "a", "b").join(classes, ["a", "b"]).select("doc_id", "s", "number", "component_id")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY, seed: int = SEED, index: str = "fingerprints") -> DataFrame:
    """Returns id, component_id (the smallest id reachable) for every row; links join texts whose sets of ``words``-word
    shingles (A-Z lower-cased) have a Jaccard similarity of ``similarity`` or more, and no others.

    A pair just at the similarity is not compared with a probability of at most ``MISS``, one above it with less. Null
    and empty texts have no shingles and link to each other only. A null id is returned with the component of its
    text, null if all ids there are null. An empty table gives an empty result; other columns are ignored.
    """
    _, judged = _judged(df, id_col, text_col, words, similarity, seed, [], index)
    return judged.select(F.col("doc_id").alias(id_col), "component_id")


def without_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY, seed: int = SEED, index: str = "fingerprints") -> DataFrame:
    """The rows of ``df`` but for those with a smaller id in their component (see ``similar``). Rows of one id are judged
    each; those that are alike as well stay or go together. Rows with a null id stay. Columns may have any names."""
    keep = [c for c in df.columns if c not in (id_col, text_col)]
    table, judged = _judged(df, id_col, text_col, words, similarity, seed, keep, index)
    gone = judged.where(F.col("doc_id") != F.col("component_id")).groupBy("s").agg(F.collect_list("number").alias("gone"))
    order = [id_col, text_col, *keep]
    kinds = dict(df.dtypes)

    def kept(batches):
        for r, numbers, offsets, data, carried in _pieces(batches):
            stay = pa.array(np.flatnonzero(~np.isin(numbers, np.array(r["gone"] or [], np.int64))))
            text = pa.StringArray.from_buffers(len(numbers), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
            text = pa.compute.if_else(_plain(carried.column(1)), pa.scalar(None, pa.string()), text)
            columns = [_plain(carried.column(0)), text, *(_plain(c) for c in carried.columns[2:])]
            yield pa.RecordBatch.from_arrays([c.take(stay) for c in columns], [f"k{i}" for i in range(len(order))])

    asked = table.select("s", "metas", "bodies").join(gone, "s", "left")
    out = asked.mapInArrow(giving_back(kept), ", ".join(f"k{i} {kinds[c]}" for i, c in enumerate(order)))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(order))).select(*(F.col(f"`{c}`") for c in df.columns))
