"""A corpus pipeline of five operators: quality, toxicity, near copies, benchmarks, mixture.

Every stage reads what its predecessor kept. All but the last return the columns of documents; the
last returns the mixture, a row for each use of a document.

Defined results: a document whose text is null, empty or short goes at the quality stage; the other stages keep such texts,
but that they are in no mixture. A stage that meets repeated rows, null ids or ids that several texts share judges each row by
its own text; of equal or near texts the copy stage leaves one row, that of the least id, with ids before those without.
Ties are settled by id, then by the text's key. An empty table stays one, and so does a stage without labels or benchmarks
leave all that its own rules do. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import decontaminate, jaccard, mixing, quality, toxicity
from postmill.llm.session import documents, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmarks),
    ("mixing", mixture),
]

#: Learned rules, a learned lexicon and hashed order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
