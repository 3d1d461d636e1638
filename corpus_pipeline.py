"""The corpus pipeline: toxicity, near duplicates, benchmark contamination, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first four return the
columns of documents, the last one what the mixture takes of each document. Which documents are toxic is learned, which SQL
cannot express, so there is no ORACLE_SQL; the tests hold each stage against its definition.

In every stage a null text is empty and stays null, null ids are ordinary rows, equal rows are copies of which near_duplicates keeps one, texts of
any length are read whole, empty tables give empty tables, and columns beyond those of documents are kept to the last stage under any name.
Without toxicity labels of both kinds no document is rejected, with a warning. Of ties the row that is first by all columns stays.
"""

from pyspark.sql import DataFrame, SparkSession

from veldt.llm import decontaminate, mixing, secrets, simhash, toxicity
from veldt.llm.common import cut, discard, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mixture takes of it."""
    return mixing.taken_words(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; what a stage wrote on its way goes when it ends."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            after = cut(stage(spark, docs, sf_dir), name)
            keep(after)
        if docs is not before:
            discard(docs)
        docs = after
    return docs
