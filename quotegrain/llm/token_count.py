"""Token counts of documents without token ids: pieces are counted once per distinct pre-token.

The pre-tokens of a merge tokenizer are the parts of a text that no piece of its vocabulary spans. For a sentencepiece
model with escaped spaces these are runs of spaces with what follows, cut again between letters and other characters,
if no piece holds both (read from the vocabulary, not assumed). Merges then never cross a cut, so a text's count is the
sum over its pre-tokens.

1. All texts: pre-token -> frequency (map-side sums, then one shuffle of distinct pre-tokens).
2. Each distinct pre-token is tokenized once; the counts are written as a table.
3. The most frequent ones, at most ``HOT`` of them, are sent to the tasks; per document, these are summed where the
   text is read. The other (document, pre-token, frequency) rows meet the table in one shuffle by pre-token, where no
   key is frequent any more. One sum by document ends it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import tokenizer_path, written

#: Most pre-tokens that are broadcast: at 16 bytes each about 4 MB, whatever the corpus.
HOT = 200_000
#: Documents' pre-tokens are gathered in batches of so many distinct ones.
_GATHER = 400_000


@lru_cache(maxsize=2)
def _model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))


@lru_cache(maxsize=2)
def _splitter(name: str):
    """Cuts where no piece of the vocabulary spans both sides."""
    model = _model(name)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    if any(b == "▁" != a for a, b in pairs):
        return re.compile(r"(?s).+")
    if any(a != "▁" and a.isalpha() != b.isalpha() for a, b in pairs):
        return re.compile(r"(?s)[ ▁]*[^ ▁]+|[ ▁]+")
    return regex.compile(r"[ ▁]*\p{L}+|[ ▁]*[^\p{L} ▁]+|[ ▁]+")


def _pre_tokens(text: str | None, find) -> list[str]:
    """Of the text with its leading space, as the model's normaliser adds it. Marks of spaces count as spaces."""
    return find(" " + text) if text else []


def _count(model, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token. A leading space stands for the one that the normaliser adds."""
    out = [0] * len(pieces)
    led = [i for i, p in enumerate(pieces) if p[:1] in (" ", "▁") and p.strip(" ▁")]
    for i, ids in zip(led, model.encode([pieces[i][1:] for i in led], num_threads=1), strict=True):
        out[i] = len(ids)
    # others never start a text: they are encoded after a line feed, which no piece joins to them, and it is taken away
    rest = [i for i, p in enumerate(pieces) if not (p[:1] in (" ", "▁") and p.strip(" ▁"))]
    for i, ids in zip(rest, model.encode(["\n" + pieces[i] for i in rest], num_threads=1), strict=True):
        out[i] = len(ids) - len(model.encode("\n", num_threads=1))
    return out


def _piece_count(name: str, column: str) -> Column:
    @pandas_udf("int")
    def count(texts):
        import pandas as pd

        return pd.Series(_count(_model(name), texts.tolist()), dtype="int32")

    return count(F.col(column))


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each document.

    A null or empty text has 0 bytes and tokens. Rows with the same id are counted each on its own and returned each.
    A null id is returned as it is. An empty table gives an empty result. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def frequencies(batches):
        find = _splitter(tokenizer).findall
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "freq"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(_pre_tokens(text.as_py(), find))
                if len(seen) > _GATHER:
                    yield out()
                    seen.clear()
        yield out()

    vocabulary = docs.select("text").mapInArrow(frequencies, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    vocabulary = written(vocabulary.withColumn("n", _piece_count(tokenizer, "piece")), "pieces")
    # the frequency above which there are at most HOT, from counts by steps of an eighth of a power of two
    step = F.floor(F.log2("freq") * 8)
    least, total = 1 << 20, 0
    for at, count in sorted(vocabulary.groupBy(step).count().collect(), reverse=True):
        total += count
        if total > HOT:
            break
        least = at
    hot = vocabulary.where(step >= least).select("piece", "n").toPandas()
    known = df.sparkSession.sparkContext.broadcast(dict(zip(hot["piece"], hot["n"].tolist(), strict=True)))

    def frequencies_by_document(batches):
        find, counts = _splitter(tokenizer).findall, known.value
        names = ["row", "doc_id", "n_bytes", "piece", "freq"]
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows, docs_, sizes, pieces, freqs = [], [], [], [], []
                some = batch.slice(part, 512)
                for row, doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2), strict=True):
                    text = text.as_py()
                    total = 0
                    for piece, k in Counter(_pre_tokens(text, find)).items():
                        n = counts.get(piece)
                        if n is None:
                            rows.append(row), docs_.append(doc_id), sizes.append(0), pieces.append(piece), freqs.append(k)
                        else:
                            total += n * k
                    rows.append(row), docs_.append(doc_id), sizes.append(len((text or "").encode())), pieces.append(None), freqs.append(total)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs_, id_type), pa.array(sizes, pa.int64()), pa.array(pieces, pa.string()), pa.array(freqs, pa.int64())], names)

    id_type = pa.string() if dict(docs.dtypes)["doc_id"] == "string" else pa.int64()
    kind = dict(docs.dtypes)["doc_id"]
    kind = kind if kind == "string" else "long"
    by_doc = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast(kind), "text").mapInArrow(
        frequencies_by_document, f"row long, doc_id {kind}, n_bytes long, piece string, freq long"
    )
    # rows without a piece hold what is summed already; a key of their own spreads them
    by_doc = by_doc.withColumn("key", F.coalesce("piece", F.concat(F.lit("\u0000"), F.col("row").cast("string"))))
    joined = by_doc.join(vocabulary.select(F.col("piece").alias("key"), "n"), "key", "left")
    tokens = F.when(F.col("piece").isNull(), F.col("freq")).otherwise(F.col("freq") * F.col("n"))
    out = joined.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
