"""Benchmark decontamination with DataFrame functions only.

Items are partitioned by size (powers of two of their shingle count). A size
class fixes how many of an item's shingles with the smallest hashes form its
sketch: one more than the class's largest item may miss at the required
containment. So every document that holds enough of an item holds at least one
shingle of its sketch, however long the document is, and no pair is lost. The
documents that hit a sketch are then compared on all shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import cut_lineage

#: rows of 16 bytes up to which a table is broadcast; beyond, the join is shuffled
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    r"""Lower-cased words of a text, cut at spaces and \t..\r; null and blank texts have none."""
    white = " \t\n\x0b\f\r"
    text = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(white))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"[\x20\x09-\x0D]+"))


def _shingles(words: str, size: int) -> Column:
    """Hashes of all shingles; a shorter text has one, its whole sequence."""
    w = F.col(words)
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(*[w[i + k] for k in range(size)]))
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def item_sketches(items: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n, shingles, sketch) of every item with a word."""
    shingled = items.select(F.col(id_col).cast("long").alias("item_id"), _words(F.col(text_col)).alias("words"))
    shingled = shingled.select("item_id", F.sort_array(F.array_distinct(_shingles("words", size))).alias("shingles")).where("item_id is not null and size(shingles) > 0")
    sized = shingled.select("item_id", F.size("shingles").alias("n"), "shingles").distinct()
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # of the size class
    missing = F.floor(largest * (100 - percent) / 100).cast("int")
    return sized.withColumn("sketch", F.slice("shingles", F.lit(1), missing + 1))


def contained_items(
    docs: DataFrame, items: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_shared, n): the pairs where a document holds ``percent`` % or more of an item's distinct shingles.

    Shingles are ``size`` lower-cased words; an item or document with fewer
    words has its whole sequence as one shingle, so such an item is only found
    in a document that says nothing else. Null and blank texts hold nothing;
    rows with a null id are left out; rows with equal document ids count as
    one document; repeated items count once. Empty tables give an empty
    result; further columns are ignored.
    """
    index = cut_lineage(item_sketches(items, percent, size, item_id, item_text))
    keys = index.select("item_id", F.explode("sketch").alias("key"))
    all_keys = index.select("item_id", "n", F.explode("shingles").alias("key"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(F.col(text_col)).alias("words")).where("doc_id is not null")
    rows = texts.select("doc_id", F.explode(_shingles("words", size)).alias("key"))
    found = cut_lineage(rows.join(_small(keys, keys.count()), "key").select("doc_id", "item_id").distinct())
    held = found.select("doc_id").distinct()
    again = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(_small(held, held.count()), "doc_id", "left_semi")
    again = again.select("doc_id", _words(F.col("text")).alias("words")).select("doc_id", F.explode(_shingles("words", size)).alias("key")).distinct()
    shared = again.join(_small(all_keys, all_keys.count()), "key").join(_small(found, found.count()), ["doc_id", "item_id"], "left_semi")
    shared = shared.groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_shared"))
    return shared.where(100 * F.col("n_shared") >= percent * F.col("n")).select("doc_id", "item_id", "n_shared", "n")


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_items, item_ids, kept) of every document; ``kept`` is false where it holds an item.

    See ``contained_items``; documents with a null id are kept.
    """
    pairs = contained_items(docs, items, percent, size, id_col, text_col)
    hit = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    joined = ids.join(hit, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return joined.select(
        F.col("doc_id").alias(id_col), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.col("item_ids").isNull().alias("kept")
    )
