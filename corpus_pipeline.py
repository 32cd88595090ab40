"""From raw documents to packed training sequences: five operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Stages
work on all rows they get. Null ids and texts, repeated rows and empty tables have the results that each operator
states: documents without content score 0 and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.llm.common import drop_table, made, sweep, table
from caselake.llm.mixing import label_weights, mix_sources
from caselake.llm.near_dups import near_duplicates
from caselake.llm.packing import pack_documents
from caselake.llm.pii import sanitise
from caselake.llm.quality_classifier import keep_predicted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; unlabelled ones are judged like all others."""
    return keep_predicted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """row, doc: a number and the struct of each row of docs, as ids may repeat or be null and columns have any name."""
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return table(docs.select(F.monotonically_increasing_id().alias("row"), packed), name)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null last.

    Rows are compared by row number, so copies with equal or null ids are a group like any other, and different texts
    of one id are judged apart. Among equal ids the text's hash decides, then the row number. Texts without words are
    linked with nothing and stay."""
    rows = numbered(docs, "pipeline-near_dups-rows")
    found = near_duplicates(rows.select("row", "doc.text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    rank = F.struct(F.col("doc.doc_id").isNull().alias("n"), F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("h"), "row")
    first = rows.select("row", rank.alias("rank")).join(found.hint("merge"), "row").groupBy("component_id").agg(F.min("rank").alias("rank"))
    return rows.join(first.select("rank.row").hint("merge"), "row", "left_semi").select("doc.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced."""
    return sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy. Documents of no words are never taken."""
    rows = numbered(docs, "pipeline-mixing-rows")
    sized = rows.select("row", "doc.doc_id", "doc.text", "doc.source")
    mixed = mix_sources(sized, label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")), row_col="row")
    copies = mixed.where("copies > 0 and size > 0").select("row", "copies")
    return rows.join(copies.hint("merge"), "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of the documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality_classifier", quality), ("near_dups", near_dups), ("pii", pii), ("mixing", mix), ("best_fit_packing", pack)]

#: Scores, sketches and packings aren't SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the tables of a stage are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = made()
        before, docs = docs, table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(since, docs)
        if name != STAGES[0][0]:
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
