"""Documents to training tokens, stage by stage.

1. quality: documents that the quality classifier scores below 0.3 go. It learns from `labels`.
2. near_duplicates: of each group of near copies (five words, similarity 0.8) the document with the smallest doc_id stays.
3. repeated_passages: passages of `PASSAGE` words that an earlier document has are cut; a document with nothing left goes.
4. benchmarks: passages of benchmark items are cut; a document that consists of them by half or more goes.
5. tokens: byte-level BPE, with the hash of what the ids decode to.

All but the last return the columns of documents. Rows with a null text are empty documents, rows with a null doc_id are never
duplicates, repeated rows with one doc_id are the same document (see the operators); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vayuspark.llm.bpe import Vocabulary, decode, encode
from vayuspark.llm.decontaminate import decontaminate
from vayuspark.llm.minhash import one_of_each
from vayuspark.llm.quality import keep_good
from vayuspark.llm.substring import without_repeats
from vayuspark.llm.tables import prepared, table, written

PASSAGE = 50


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where the table has that column."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return one_of_each(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return _measured(without_repeats(docs, PASSAGE), docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    vocabulary = Vocabulary()
    encoded = decode(encode(docs.select("doc_id", "lang", "source", "text"), vocabulary), vocabulary)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


#: Each takes (spark, docs, sf_dir).
STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmarks", benchmarks),
    ("tokens", tokens),
]

#: The first stage learns a model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
