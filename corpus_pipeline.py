"""The corpus pipeline: language, line dedup, near-dedup, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passledger.llm import language, lines, minhash, packing, secrets
from passledger.llm.common import table, unused
from passledger.session import ensure_checkpoint_dir

#: A text of this many characters or more should look like some language: its cosine is to reach the least score.
LONG_TEXT, LEAST_SCORE = 200, 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null texts included, go, and long ones that look like none of the languages learnt.

    Where no document has a language to learn from, nothing can look unlike one: only those without letters go.
    """
    learnt = language.learn_from_documents(docs)
    if not learnt:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    (found,) = unused(docs, "found")
    told = docs.withColumn(found, language.language(F.col("text"), learnt))
    unlike = (F.char_length("text") >= LONG_TEXT) & (F.col(f"{found}.score") < LEAST_SCORE)
    return told.where((F.col(f"{found}.lang") != language.UNDETERMINED) & ~unlike).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more stay in the last of them only; all documents stay."""
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; of rows that repeat a doc_id, one.

    Rows without doc_id all stay.
    """
    ident, gone, row = unused(docs, "id", "gone", "row")
    lost = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    named = docs.where("doc_id is not null").withColumn(ident, F.col("doc_id").cast("long"))
    one = Window.partitionBy(ident).orderBy(F.xxhash64("text"))
    kept = named.join(lost, F.col(ident) == F.col(gone), "left_anti").withColumn(row, F.row_number().over(one)).where(F.col(row) == 1)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.packed(docs, forget=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Profiles, the forest and the tokenizer are beyond SQL; a test holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's rows are stored in the shared folder and read again by the next."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
