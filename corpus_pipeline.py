"""From raw documents to packed training sequences: five stages, each a DataFrame to a DataFrame.

The first four give rows of documents with its own columns; the last gives the placed pieces.

All stages take whole texts of any length. Null and blank texts are scored as empty text (stage 1), are of unknown
language and go (2); were they kept, they would share fingerprint zero (3), hold no passage (4) and be one token (5).
Repeated rows and ids are judged row by row; of equal ones one stays (3), the first of those with the smallest id, rows
without an id last. Other columns, also those that are called as a stage's own, pass through the first four
stages unchanged; null in them decides nothing. An empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talentloom.llm import decontaminate, langid, packing, quality, simhash
from talentloom.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs)[0]


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the classifiers, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
