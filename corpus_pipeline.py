"""A corpus run: every stage takes what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontam, mixing, packing, simhash, toxicity
from veilspark.llm.common import delete, table, work_dir


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity chain, fitted on the labels, rejects.

    A null text counts as an empty one, which has no feature; repeated rows go or stay together. Without labels nothing is rejected, and of no
    documents none remain. Texts of any length are read as a whole. Extra columns stay, whatever their name.
    """
    return toxicity.kept_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, Jaccard 0.8 over five-word shingles: that of the smallest id, null ids last.

    Null texts, empty ones and those without a word are alike, and one of them stays; of repeated rows one does. Texts of any length count with
    all their shingles. Of no documents none remain. Extra columns stay.
    """
    return simhash.kept_of_similar(docs)


def keep_untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null and empty texts hold none, nor does any text where there are no items; repeated rows go or stay together. Texts of any length are
    searched as a whole. Extra columns stay.
    """
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut and leave out documents so that every source comes to its target.

    A null source is one of the sources. Null, empty and wordless texts are in no mix; documents alike in id and text are taken together. Of no
    documents none remain. Extra columns stay.
    """
    return mixing.mixed_rows(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents as packed token ids; one row for each, with the places of its pieces.

    Null and empty texts have no piece; repeated rows are packed again; long texts are cut into whole rows and a rest. Of no documents come no rows
    and no shards. Extra columns are not read.
    """
    return packing.pack(docs, work_dir(spark, "packed"))


STAGES = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_alike),
    ("decontamination", keep_untested),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Models, fingerprints and packing are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again.

    A stage's result is deleted once the next one's is written.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
