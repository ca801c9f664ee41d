"""The corpus pipeline: five stages, each on all that the stage before has kept.

    toxicity       documents that the lexicon rejects go
    line_dedup     lines that came earlier, or are one word away from one that did, go
    near_dedup     one document of each class of near copies stays
    decontaminate  documents that share ten words in a row with the benchmark go
    bpe_encode     what is left, as token ids

A stage's result is written as Parquet and read again as the input of the next,
so a lost executor costs one stage at most.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventledger.llm import bpe_stream, decontaminate, line_dedup, near_dedup, toxicity
from eventledger.llm.catalog import remainder, tokenizer_path
from eventledger.llm.common import read
from eventledger.session import prepare, run_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labels of ``sf_dir`` that belong to documents of this stage.

    As in the query of its own, one label in five takes no part in learning.
    """
    prepare(spark)
    labels = read(spark, sf_dir, "labels").where(remainder() != 0)
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars``, where it is a column, follows the shortened text."""
    prepare(spark)
    left = line_dedup.dedup_lines(docs)
    if "n_chars" in left.columns:
        kind = left.schema["n_chars"].dataType
        length = F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
        left = left.withColumn("n_chars", length)
    return left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids."""
    prepare(spark)
    return bpe_stream.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe_encode", encode),
]

# A learned lexicon and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = run_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
