"""A corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldframe.llm import common, packing, quality, secrets, simhash, substring


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier, fitted on the labels, predicts to be good.

    Null and empty texts are scored like others; repeated rows go or stay together; rows with a null id are judged by their
    text; texts of any length are read whole; an empty table gives an empty result; further columns stay, whatever their
    names."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id. A link is a pair of texts that share 0.8
    or more of their five-word shingles; SimHash fingerprints propose the pairs.

    Texts without words are one group; rows with a null id stay, as does every repeat of a kept id; texts of any length are
    read whole; an empty table gives an empty result; further columns stay, whatever their names."""
    return simhash.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or the same one further up, has too.

    Null texts stay null; a row with a null id is held against itself alone, and repeats of an id are one document; texts of
    any length are read whole; an empty table gives an empty result; further columns stay, whatever their names."""
    return substring.dedup(docs).select(*(f"`{c}`" for c in docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced.

    Null texts stay null, empty ones empty; rows are looked at one by one, so repeats and null ids do not matter; texts of
    any length are read whole; an empty table gives an empty result; further columns stay, whatever their names."""
    return secrets.redact_documents(docs, secrets.default_path())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens.

    A null text counts as empty; rows with a null or repeated id are packed like any other; longer texts are cut, into whole
    sequences and a rest; an empty table gives an empty result; further columns are not looked at."""
    return packing.best_fit(docs, packing.default_path())


STAGES = [("quality", good), ("simhash", distinct), ("substring", unrepeated), ("secrets", without_secrets), ("packing", packed)]

#: The stages learn and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next one is written."""
    docs = common.table(spark, sf_dir, "documents")
    spent: list[DataFrame] = []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.save(docs, *spent)
            spent = [docs]
    return docs
