"""A text corpus through five stages: toxicity, near-duplicates, benchmark passages, secrets, token ids.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlane.llm import bpe, common, decontamination, pu, secret_scan, similar
from stormlane.sources.tables import drop_folder


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after the text was changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (score 0.5 or more). Null and empty texts stay, and so do null ids; repeated rows
    are judged alike; an empty table gives no rows. Other columns, whatever their names, are carried along."""
    model = pu.toxicity_model(docs, common.table(spark, sf_dir, "labels"))
    return pu.keep_below(docs, model, pu.TOXICITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies: five-word shingles, similarity 0.8; the smallest id stays, a null one last. Copies are
    found by SimHash and Golay keys and compared as sets; a prefix filter finds those that differ in more bits. Texts without words, nulls included, all stay. Of repeated rows one stays, by a rule (``similar.one_of_each_group``); an empty table
    gives no rows. Helper columns take names that the documents don't have."""
    return similar.one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; documents that are mostly such passages go. Null and empty texts have no passages and
    stay; repeated rows are each cut; an empty table gives no rows, an empty benchmark changes nothing. n_chars, if it is a column,
    is counted anew; other columns, whatever their names, are carried along."""
    return _counted(decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark. Null texts stay null, empty ones empty; all rows stay, repeated ones too; an empty table gives no
    rows. n_chars, if it is a column, is counted anew; helper columns take names that the documents don't have."""
    return _counted(secret_scan.redact(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of token ids of the text, and the digests of ids and decoded text, a row per row. Null and empty texts have
    no ids; null ids and repeated rows are kept; an empty table gives no rows; other columns are left out."""
    encoded = bpe.encode_texts(docs, bpe.word_tokenizer_path())
    return bpe.digests(encoded)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what stands between them goes to the shared checkpoint folder as Parquet, and goes again when the
    next stage is written. The last stage reads what the one before has left, so that stays for the result's sake."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
