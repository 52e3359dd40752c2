"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import dedup, language, packing, secrets, toxicity
from pagemill.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("language_id", language.stage),
    ("near_duplicates", dedup.stage),
    ("secret_scan", secrets.stage),
    ("packing", packing.stage),
]

#: The stages learn from the corpus and call a tokenizer; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
