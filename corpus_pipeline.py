"""Training corpus from ``documents``: classifier, rules, near-duplicates, packing.

Null and empty texts are texts without words: the base rule takes them out. Null and
repeated doc_ids and repeated rows are rows like others in all stages; of equal texts one
stays, the row with the smallest doc_id (null last). Columns beside those of ``documents``
are carried along whatever their names; an empty table stays empty. A stage called by
itself leaves Arrow batches of 1000 rows set in the session, as its result is lazy;
``run`` puts the session's own value back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swarmlake.llm import importance, packing, quality_rules, similar
from swarmlake.llm.queries import table, tokenizer_path
from swarmlake.llm.scratch import materialize


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bounded(spark: SparkSession) -> None:
    """Rows here are whole texts with all their columns, so fewer of them go to a worker at once."""
    spark.conf.set(ROWS_A_BATCH, "1000")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labelled text keeps."""
    _bounded(spark)
    return importance.keep(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cascade."""
    _bounded(spark)
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 0.8 and more of their five-word shingles."""
    _bounded(spark)
    return similar.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    _bounded(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("near-duplicates", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: Hashed models, fingerprints by XXH64 and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    before = spark.conf.get(ROWS_A_BATCH)
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(ROWS_A_BATCH, before)
