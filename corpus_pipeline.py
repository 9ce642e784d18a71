"""A training corpus from raw documents: quality, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever else these are named.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketspark.llm.decontamination import without_leaks
from docketspark.llm.line_dedup import drop_repeated_lines
from docketspark.llm.mixing import mix
from docketspark.llm.near_dedup import drop_near_duplicates
from docketspark.llm.quality import keep_good
from docketspark.llm.text import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored like any."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which nothing is left; null and empty texts stay."""
    return drop_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the first by id and, among rows of one id, by the hash of the text.

    Of equal rows of one id one stays. Null and empty texts are like nothing and stay, equal rows of one id once.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, by id and text; other rows of the same id and empty texts stay."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, with the number of the copy."""
    return mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("decontaminate", decontaminate), ("mix", mixed)]

#: A classifier and locality-sensitive hashing are beyond SQL; tests hold the near stage against brute force, and every stage on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; only the last one's rows are left there, none if a stage fails."""
    shared_dir(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for name, stage in STAGES:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
            stage(spark, docs, sf_dir).write.parquet(path.toString())
            docs = spark.read.parquet(path.toString())
            if before is not None:
                files.delete(before, True)
            before = path
    except BaseException:
        files.delete(folder, True)
        raise
    return docs
