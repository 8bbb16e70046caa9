"""A corpus pipeline: documents in, token ids out. Each stage's rows are written as Parquet and read by the next.

All stages but the last return the columns of documents (doc_id, text, lang, source, n_chars). Rows are judged each,
also where an id is repeated; rows of one id and one text stay or go together. Documents without an id stay, unless
their language is rejected.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quotegrain.llm import bpe, decontaminate, fingerprint_index, lang_id, simhash
from quotegrain.llm.common import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Documents whose language is predicted with less than this score are rejected, as are those without a letter.
LEAST_SCORE = 0.4

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5

#: Similarity of shingle sets from which documents are near-duplicates.
SIMILARITY = simhash.SIMILARITY


def _settle(spark: SparkSession) -> None:
    """Texts are long rows: fewer of them are read and sent to Python at a time than Spark does by itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language. The classifier learns from a bounded sample of the labelled rows."""
    _settle(spark)
    model = lang_id.train(docs)
    found = lang_id.predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicates, the document with the smallest id."""
    _settle(spark)
    return simhash.without_similar(docs, words=SHINGLE, similarity=SIMILARITY).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes windows of words that an earlier document has; documents of which nothing is left go. A text that loses
    no word stays as it is."""
    _settle(spark)
    carry = ("lang", "source", "n_chars", "no_text")
    cut = fingerprint_index.remove_repeated_windows(docs.withColumn("no_text", F.col("text").isNull()), as_is=True, carry=carry)
    changed = F.col("n_removed") > 0
    left = cut.where(~changed | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(changed, F.length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.select("doc_id", F.when(~F.col("no_text"), F.col("kept")).alias("text"), "lang", "source", n_chars.alias("n_chars"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a passage of a benchmark item."""
    _settle(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the decoded text."""
    _settle(spark)
    # few words are kept, as executors have been filled by the stages before
    return bpe.encode_decode(docs, "word_bpe_49k.json", words=bpe.CACHE).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmarks", benchmarks), ("tokens", tokens)]

#: SQL can express neither the classifier nor the fingerprints' hash nor the tokenizer.
ORACLE_SQL = None


def _ended(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.schema("id long").parquet(f"{path}.ended").head(1))
    except AnalysisException:
        return False


def run(spark: SparkSession, sf_dir: str, run_dir: str | None = None) -> DataFrame:
    """``run_dir``: a folder that executors share; a run that failed is taken up there after its last ended stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_dir or scratch_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        if not (run_dir and _ended(spark, path)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.ended")
        docs = spark.read.parquet(path)
    return docs
