"""A training corpus from raw documents, in five stages: language, near duplicates, benchmark leaks, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metascrub.llm import decontam, jaccard, langid, mixing, secret_scan, store
from metascrub.llm import text as tx


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; ``und`` (null, empty, without a letter) and what is no text of its predicted
    language goes, and no row is shuffled. The floors come from the labelled rows, see ``langid``. Rows are judged by their
    text alone: repeated rows stay or go together, a null doc_id or other columns of any name change nothing."""
    found = langid.predict(docs, langid.train(docs, outliers=True), whole=True)
    return found.filter((F.col("lang_pred") != "und") & F.col("fits")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least doc_id, and of rows that share it the least hash. Rows are judged one
    by one; of rows equal in all columns one stays. Rows with a null doc_id take no part and stay, as do texts without a word."""
    known = docs.filter("doc_id is not null").select(tx.row_key(*docs.columns).alias("key"), F.struct(*docs.columns).alias("row"))
    found = jaccard.near_duplicates(known.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), n=5, percent=80)
    linked = found.filter("n_links > 0").select(F.col("doc_id").alias("key"), "component_id").distinct()
    linked = store.saved(linked.join(known.select("key", F.col("row.doc_id").alias("doc_id")).distinct(), "key"), "linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select(F.col("least.key").alias("key"))
    later = linked.join(first, "key", "left_anti").select("key")
    kept = known.join(later, "key", "left_anti").dropDuplicates(["key"]).select("row.*")
    return kept.unionAll(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item leaks, judged one by one and where they are: a null or repeated doc_id changes nothing;
    null and empty texts stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets redacted in each, whatever its doc_id; null and empty texts stay as they are."""
    return secret_scan.redact(docs, secret_scan.scan(docs, *secret_scan.fit(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of documents that make up the mixture; rows with a null doc_id or without a word are in none."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("mixing_sources", mixture),
]

#: Language identification trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
