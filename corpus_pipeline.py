"""A training corpus from `documents`: five stages, each stored and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limitloom.llm import jaccard, languages, packing, surrogates, templates
from limitloom.llm.frames import durable, read_table, without

# Near duplicates share 80 % of their five-word shingles.
SHINGLE, PERCENT = 5, 80
SURROGATE_KEY = "corpus-pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by fused evidence; those without letters or with none likely enough go."""
    evidence = languages.page_evidence(read_table(spark, sf_dir, "pages"))
    rejected = languages.identify(docs, languages.train(docs), evidence).filter(~F.col("keep")).select("doc_id")
    return without(docs, rejected)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id; rows that repeat both id and text count once.

    Rows that share an id and differ in text are documents of their own and give way to those of unshared ids. Null, empty and
    blank texts are near nothing and stay, as do rows without an id.
    """
    shared = durable(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "shared-ids")
    if not shared.limit(1).count():
        classes = jaccard.similarity_classes(docs, SHINGLE, PERCENT)
        return without(docs, classes.filter("component_id <> doc_id").select("doc_id"))
    named = docs.filter("doc_id is not null")
    beyond = named.agg(F.max("doc_id")).first()[0] + 1
    once = named.join(shared, "doc_id", "left_anti").withColumn("__row", F.col("doc_id"))
    again = named.join(shared, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("__row", F.lit(beyond) + F.monotonically_increasing_id())
    rows = durable(once.unionByName(again), "rows")
    classes = jaccard.similarity_classes(rows.select(F.col("__row").alias("doc_id"), "text"), SHINGLE, PERCENT)
    kept = without(rows, classes.filter("component_id <> doc_id").select(F.col("doc_id").alias("__row")), "__row")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other numbers, names and units.

    Null, empty and repeated texts without an item stay, as do rows without an id. Rows that share an id are one document:
    where one of them holds an item, all go.
    """
    return without(docs, templates.matches(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text (null for a null text).

    Every row comes out once, repeated rows, null ids, and null and empty texts included.
    """
    out = surrogates.replace(docs, SURROGATE_KEY)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces with their place in the packed sequences.

    Each row is packed for itself, repeated ones too; a null or empty text is a piece of one id.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii_surrogates", private_data),
    ("best_fit_packing", pack),
]

# Token ids, surrogates and trigram models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
