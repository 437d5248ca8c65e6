"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing and best-fit
packing, each stage written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaymill.llm import exact_dedup, mixing, packing, simhash, toxicity
from assaymill.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier predicts as toxic go.

    It is fitted on the labelled documents among ``docs``; with none, or with
    labels of one kind only, every text scores their share and none or all go.
    Null texts score as texts without words; repeated rows go or stay alike;
    null ids have no label; empty input gives empty output; columns other than
    those of ``documents`` are left behind."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the document with the smallest id
    stays (null last); of rows that repeat it one.  Null texts are empty and
    equal each other; empty input gives empty output; columns other than those
    of ``documents`` are left behind."""
    return exact_dedup.kept_only(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over shingles of five
    words the smallest id stays (null last); of rows that repeat it one.  (3
    bits over three words, the contract of ``op5_simhash``, hold for that query
    alone.)  Texts of fewer words are one shingle, null texts empty; empty input
    gives empty output; other columns are left behind."""
    return simhash.kept_only(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those beyond their source's
    budget are left out, those without a word (null texts too) stay once.  A
    null source is a source; rows equal in id and text are taken alike; empty
    input gives empty output; other columns are left behind."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids.
    A null or empty text is its end id alone; repeated rows are packed each on
    their own; empty input gives empty output; other columns play no part."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored in the
    shared folder before the next one reads it
    (``assaymill.llm.common.release`` deletes those tables)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: The classifier, the hashes and the tokenizer can't be said in SQL; the tests
#: hold each stage against a brute-force version.
ORACLE_SQL = None
