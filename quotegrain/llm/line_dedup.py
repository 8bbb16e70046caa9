"""Line dedup with DataFrame functions only: lines that many documents share stay in the last of these documents.

1. Each line gives a row of its key's 128-bit hash, document and place; no text is sent. The rows are written once.
2. A key that alone would fill more than half of a mean partition is hot. There are at most two such keys for each
   partition, so their number of documents and their last document, from sums and maxima made before any shuffle, are
   broadcast, and their lines are judged where they are read.
3. All other rows are range-partitioned by hash and sorted by hash, document and place. Each key's documents then
   stream by, the first of them being the one that keeps its lines.
4. What a document keeps is a bitmap of its lines, compressed to runs. Bitmaps, not texts, come out of this; a bitmap
   belongs to a document's id and its text's hash, so rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_parts, written

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Rows of lines that a task sorts: about 200 MB.
ROWS = 4_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: str | Column) -> Column:
    """Null has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: str | Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _hashes(value: str, a: str, b: str) -> dict[str, Column]:
    return {a: F.xxhash64(value), b: F.xxhash64(F.lit(1), F.col(value))}


def _line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, t1, t2, place) of each line with a long enough key, of documents with an id."""
    named = docs.where("doc_id is not null").withColumns(_hashes("text", "t1", "t2"))
    each = named.select("doc_id", "t1", "t2", F.posexplode(lines_of("text")).alias("place", "line"))
    keys = each.withColumn("key", line_key("line")).where(F.char_length("key") >= least_chars)
    return keys.withColumns(_hashes("key", "h1", "h2")).select("h1", "h2", "doc_id", "t1", "t2", "place")


def _dropped(rows: DataFrame, least_docs: int) -> DataFrame:
    """The rows whose line goes."""
    total, parts = rows.count(), shuffle_parts(rows.sparkSession)
    parts = max(parts, -(-total // ROWS))
    key = ["h1", "h2"]
    hot = written(rows.groupBy(*key).agg(F.count("*").alias("k")).where(F.col("k") * 2 * parts > total).select(*key), "hot")
    each = rows.join(F.broadcast(hot), key).select(*key, "doc_id").distinct()
    last = each.groupBy(*key).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= least_docs)
    of_hot = rows.join(F.broadcast(last), key).where("doc_id < last")

    cold = rows.join(F.broadcast(hot), key, "left_anti").repartitionByRange(parts, *key).sortWithinPartitions(*key, F.desc("doc_id"), "place")
    streamed = cold.withColumn("nth", F.dense_rank().over(Window.partitionBy(*key).orderBy(F.desc("doc_id"))))
    of_cold = streamed.withColumn("docs", F.max("nth").over(Window.partitionBy(*key))).where((F.col("nth") > 1) & (F.col("docs") >= least_docs))
    names = ["doc_id", "t1", "t2", "place"]
    return of_hot.select(*names).unionByName(of_cold.select(*names))


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, t1, t2, dropped) of documents that lose lines: their id, their text's hash, and their bitmap, as the
    ordered places of the lines that go. ``kept_runs`` compresses it for a text."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(_line_rows(docs, least_chars), "lines")
    return _dropped(rows, least_docs).groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("dropped"))


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """array<struct<start, length>>: the runs of lines that stay, from the ordered places of those that go."""
    start = lambda i: F.coalesce(F.get(dropped, i - 1) + 1, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.struct(start(i).alias("start"), (F.coalesce(F.get(dropped, i), n_lines) - start(i)).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def remove_common_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, keep_text: bool = True
) -> DataFrame:
    """Returns id, n_lines, n_dropped, kept_sha256, keep (runs of lines that stay: a compressed bitmap) and, with
    ``keep_text``, kept, of every row.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least_chars`` code points or
    more that are found in ``least_docs`` documents or more lose their lines, but for those in the document with the
    largest id. Rows of one id are one document; each of them is judged, and loses or keeps such lines like the others.
    A null or empty text has one empty line. Rows with a null id keep all and count for no key. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    bitmaps = keep_bitmaps(df, id_col, text_col, least_chars, least_docs)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns(_hashes("text", "t1", "t2"))
    met = docs.join(bitmaps, ["doc_id", "t1", "t2"], "left").withColumn("lines", lines_of("text"))
    met = met.withColumn("n_lines", F.size("lines"))
    met = met.withColumn("keep", F.when(F.col("dropped").isNull(), F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("length")))).otherwise(kept_runs(F.col("dropped"), F.col("n_lines"))))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    met = met.withColumn("kept", F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
    gone = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    return met.select(
        F.col("doc_id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"), "keep", *["kept"] * keep_text
    )
