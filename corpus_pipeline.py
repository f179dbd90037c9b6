"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import line_dedup, mixing, packing, quality_mil, simhash
from talus.llm.common import SharedTable, free_name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier scores at quality_mil.THRESHOLD or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_mil.keep_good(docs, quality_mil.fit_on_labels(docs, labels))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller id holds; n_chars follows."""
    out = line_dedup.dedup_lines(docs)
    counted = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(dict(docs.dtypes)["n_chars"])}
    return out.select(*[counted.get(c, F.col(c)).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Rows without
    an id cannot be told apart and stay."""
    groups = simhash.simhash_components(docs, shingle=4, max_bits=4)
    first = groups.where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def _row_order(docs: DataFrame) -> Column:
    """The order in which the rows of `docs` were written, or stand if it isn't read from files.
    Spark reads files by size and cuts large ones, so row numbers of a scan are not that order."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    order = F.struct(F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long").alias("part"), file.alias("file"), row.alias("row"))
    try:
        docs.select(order)
    except AnalysisException:
        return F.monotonically_increasing_id()
    return order


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, written in the order of the mix at the target weights, which packing follows."""
    docs = docs.unionByName(docs.limit(0))  # rows of the mix must not show their places in the files of `docs`
    mixed = mixing.mix_order(docs).groupBy("id").agg(F.min(F.struct("slot", "position")).alias("place"))
    # The document's columns stay in one struct, so that none of their names can clash.
    row = free_name(docs.columns, "row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    placed = whole.join(mixed, F.col(f"{row}.doc_id").eqNullSafe(F.col("id")))
    ordered = placed.repartitionByRange("place", f"{row}.doc_id").sortWithinPartitions("place", f"{row}.doc_id")
    return ordered.select(*[F.col(f"{row}.`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of packing.SEQUENCE tokens.
    Sequences hold neighbours in the order of `docs`, the mix, and follow it by sequence_id."""
    return packing.pack_documents(docs, order=_row_order(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: No stage but line dedup has a form in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            table = SharedTable(docs, f"stage-{i}")
            if before is not None:
                before.drop()
            docs, before = table.df, table
    return docs
