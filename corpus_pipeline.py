"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontaminate, neardup, packing, substrings, toxicity
from wardline.llm.queries import table, vocabulary_path
from wardline.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, rejects go."""
    return toxicity.without_toxic(docs, toxicity.toxicity_model(docs, table(spark, sf_dir, "labels")))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, stored with a number of each row, and the number's column.

    The ids can be null or shared; the stages judge rows by their numbers.
    """
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id())), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest id; a null id counts as the largest."""
    rows, row = _numbered(docs)
    later = cut_lineage(neardup.near_duplicates(rows, id_col=row).where("not kept").select(row, "component_id"))
    members = later.union(later.select("component_id", "component_id").distinct())
    members = cut_lineage(members.join(rows.select(row, "doc_id"), row))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", row))[row].alias("first"))
    gone = members.join(first, "component_id").where(F.col(row) != F.col("first")).select(row)
    return rows.join(gone, row, "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a document with a smaller id holds go; n_chars follows the text."""
    read = ("doc_id", "text")
    others = [c for c in docs.columns if c not in read]  # packed, as the operator adds columns of its own
    own = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("own")] if others else []
    kept = substrings.remove_repeated_words(docs.select(*read, *own))
    columns = {c: F.col(c) if c in read else F.col("own").getField(c) for c in docs.columns}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(x.alias(c) for c, x in columns.items()))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item of the benchmark go, whatever their id."""
    rows, row = _numbered(docs)
    pairs = decontaminate.contained_items(rows, table(spark, sf_dir, "benchmark"), id_col=row)
    return rows.join(pairs.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: the classifier and the tokenizer can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each one's result stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
