"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, imatch, jaccard, langid, lengths, lloyd, mixing, ngram_lm, quality, sql, toxicity, urlfilter, warc, whitening
from postmill.llm.langid import held_out
from postmill.llm.session import documents, saved


def _with_held_out(rows: DataFrame, parts: int, part: int) -> DataFrame:
    return rows.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), *[c for c in rows.columns if c != "doc_id"])


#: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, where no rule decides, the URLs of one page in sixteen (by digest), whatever form a page writes them in."""
    pages = documents(spark, sf_dir, "pages")
    urls = pages.where(F.startswith(F.sha2("url", 256), F.lit("0"))).select("url", F.lit("block").alias("verdict"))
    return urlfilter.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), urls=urls, rules_first=True)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(documents(spark, sf_dir, "pages")))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out("doc_id", 5, 0)))
    return _with_held_out(langid.identify(docs, model), 5, 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    return _with_held_out(toxicity.report(docs, model), 4, 2)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir))


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(saved(lengths.histogram(documents(spark, sf_dir)), "histogram"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = ngram_lm.fit(docs.where(~held_out("doc_id", 7, 2)), order=3)
    return _with_held_out(ngram_lm.score(docs, model), 7, 2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(documents(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(documents(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", rows.deviation.cast("bigint"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_warc_derivatives, op3_temperature_mixing, op4_language_id, op5_quality_rules, op6_toxicity, op7_ngram_jaccard, op8_length_histogram, op9_kneser_ney, op10_decontamination, op11_imatch, op12_delta_lloyd, op13_whitening)}
SQL = {"op1_url_filter": sql.OP1, "op2_warc_derivatives": sql.OP2, "op7_ngram_jaccard": sql.OP7, "op10_decontamination": sql.OP10, "op11_imatch": sql.OP11, "op12_delta_lloyd": sql.OP12}
