"""From raw documents to packed sequences: five stages, each one of the operators of panelcast.llm.

Each stage takes (spark, docs, sf_dir) and gets the documents that its predecessor kept, read back
from Parquet.  All but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import jaccard, language, mixing, packing, secrets
from panelcast.llm.tables import small_batches
from panelcast.sources.tables import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with the fused language as their lang; others go.

    The web pages take part in the counts.  Rows without doc_id stay as they are, and so do all rows with
    some text where nothing declares a language.
    """
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = language.document_records(docs).unionByName(language.page_records(pages, asked=False))
    found = language.identify(records).where("kept and doc_id is not null").groupBy("doc_id").agg(F.max("lang").alias("__lang"), F.lit(True).alias("__kept"))
    met = docs.join(found, "doc_id", "left").where("__kept or doc_id is null")
    return met.withColumn("lang", F.coalesce("__lang", "lang")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the least doc_id.

    Of several rows with that doc_id one stays.  Documents without words are linked with nothing and
    stay, and so do rows without doc_id.
    """
    small_batches(spark)
    groups = materialise(jaccard.jaccard_join(docs).where("doc_id is not null"))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    twice = groups.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    once = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, "doc_id", "left_anti").unionByName(once)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark."""
    small_batches(spark)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each epoch, the cut one with its first words."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained likelihoods, guess costs and token ids have no SQL; see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
