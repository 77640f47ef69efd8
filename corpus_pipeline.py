"""From raw documents to packed training sequences, in five stages.

Every stage takes what the one before kept, written as Parquet and read again, and returns the
columns of ``documents``; the last one returns the packed pieces.

* ``toxicity``: documents that the classifier chain rejects go.
* ``line_dedup``: later occurrences of three-line windows are cut out of the texts; a document
  of which nothing is left goes; ``n_chars`` follows the text.
* ``minhash``: of each component of near-duplicates (five-word shingles, Jaccard of 0.8 or more)
  the document with the smallest id stays.
* ``decontaminate``: documents that overlap with a benchmark item go.
* ``packing``: the remaining documents in sequences of at most 1024 ids.

Texts that are null or empty pass all filters; how nulls, repeated rows, and further columns are
treated is said in the operators' modules. Null ids are kept by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listprep.llm import decontaminate, linededup, neardup, packing, toxicity
from listprep.llm.tables import table
from listprep.storage import new_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned, _, removed = linededup.cut_lines(docs)
    changed = F.col(removed) > 0
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return cleaned.filter(~changed | (F.trim("text") != "")).select(*[F.col(f"`{name}`") for name in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("copy")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: The classifiers, the vocabulary and the packing cannot be written in SQL; the tests compare
#: the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
