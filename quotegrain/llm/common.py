"""Helpers shared by the corpus operators: scratch tables, batches of text as bytes, word boundaries, hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that numpy code handles at a time.
CHUNK_BYTES = 1 << 18

_MUL_A = np.uint64(0x9E3779B97F4A7C15)
_MUL_B = np.uint64(0xC2B2AE3D27D4EB4F)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path below the cluster's shared checkpoint folder. Where none is set: below the warehouse on a cluster, in a
    temporary folder in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if spark.conf.get("spark.master", "").startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Bytes of a file of a small table.
SMALL_FILE = 32 << 20


def written(df: DataFrame, label: str, most_rows: int | None = None, row_bytes: int = 32) -> DataFrame:
    """The rows of ``df`` as a written table: its lineage ends at shared storage. Where it is known how many rows of about
    how many bytes there are at most, so many files are written as hold them, and not one for each shuffle partition."""
    path = scratch_dir(df.sparkSession, label)
    few = df if most_rows is None else df.coalesce(most_rows * row_bytes // SMALL_FILE + 1)
    few.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: For tables of few, large rows that are compressed already: small row groups, which a task writes and reads at a time.
LARGE_ROWS = {"compression": "none", "parquet.block.size": str(2 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """The rows of ``df`` as a written table in buckets of ``column``: joins and groups on it need no shuffle of these
    rows. The name in the catalog is dropped at once; the files stay."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, label)
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).options(path=path, **LARGE_ROWS).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def giving_back(run):
    """``run``, a function of batches; when it ends, its worker, which lives on, returns the memory that it has freed."""

    def with_end(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return with_end


def text_bytes(df: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of a column: what partition counts are derived from."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def parts_for(total_bytes: int, each: int, least: int) -> int:
    return max(least, -(-total_bytes // each))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(29)
    x *= _MUL_B
    x ^= x >> np.uint64(32)
    return x


def text_chunks(batch: pa.RecordBatch | pa.Table, column: str, limit: int = CHUNK_BYTES):
    """Yields (first row, last row, bytes, offsets) of runs of rows of about ``limit`` bytes; null texts are empty."""
    array = batch.column(column)
    pieces = array.chunks if isinstance(array, pa.ChunkedArray) else [array]
    row = 0
    for piece in pieces:
        piece = piece.cast(pa.large_string()) if piece.type != pa.large_string() else piece
        if piece.null_count:
            piece = piece.fill_null("")
        n = len(piece)
        if not n:
            continue
        _, offsets_buffer, data_buffer = piece.buffers()
        offsets = np.frombuffer(offsets_buffer, np.int64)[piece.offset : piece.offset + n + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), n)
            yield row + first, row + last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last
        row += n


#: Bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE):
    """Starts and ends of words, and for each row the index of its first word (one more entry than rows).

    Words never cross rows.
    """
    inside = ~is_space[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    inner = cuts[cuts > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _MUL_A, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(CHUNK_BYTES * 2)
_BYTE_CODES = mix(mix(np.arange(1, 257, dtype=np.uint64) * _MUL_A))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from differences of one running sum: word bytes weighted by powers, from the word's end."""
    global _POWERS
    if len(_POWERS) <= len(data):
        _POWERS = _powers(len(data))
    # sum over i of code[i] * A^(len - i): a word's difference is multiplied up to a common exponent
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _POWERS[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * _INVERSE_POWERS(starts)
    return mix(mix(value + (ends - starts).astype(np.uint64) * _MUL_B))


_INVERSE = pow(int(_MUL_A), -1, 1 << 64)
_INVERSES = np.zeros(0, np.uint64)


def _INVERSE_POWERS(at: np.ndarray) -> np.ndarray:
    global _INVERSES
    need = int(at.max()) + 1 if len(at) else 1
    if len(_INVERSES) < need:
        out = np.full(max(need, CHUNK_BYTES) + 1, np.uint64(_INVERSE), np.uint64)
        out[0] = 1
        _INVERSES = np.multiply.accumulate(out)
    return _INVERSES[at]


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:]) if len(x) > k else x[:0]
        k *= 2
    rest = width - k
    if rest:
        x = f(x[: len(x) - rest], x[rest:]) if len(x) > rest else x[:0]
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return out[:0]
    firsts = np.cumsum(lengths) - lengths
    out[0] = starts[0]
    out[firsts[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies on this machine; ``name`` may be a full path."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
