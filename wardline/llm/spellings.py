"""Grouping of spelling variants: words walk a trie that is held as a table of edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.batches import mix, prefix_sums, span_hashes
from wardline.session import cut_lineage, scratch_path

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER = "".join(map(chr, range(65, 91)))
#: words beyond this length do not walk, see ``_long_pairs``; 64 at most
DEEPEST = 64
STATE = "side int, s string, at int, node long, edits int"


def vocabulary(docs: DataFrame, least_chars: int = 7, least_count: int = 2, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all whole texts and their occurrences.

    A word is a run of Latin letters with A-Z in lower case. Where crc32 of
    ``id:run`` is a multiple of ``noise``, the run loses the code point at
    that number modulo its length; with ``noise`` 0 all stay as they are.
    Kept are results of ``least_chars`` code points with ``least_count``
    occurrences. Counts are added up before the shuffle, so a frequent word
    is a few rows in it.

    A null text has no words, a null id counts as the empty string under the
    hash, repeated rows count again, an empty table gives an empty result,
    further columns are ignored.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{max(1, least_chars)},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, UPPER.lower()).alias("word"))
    if noise:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        less = "left(word, int(h % length(word))) || substring(word, int(h % length(word)) + 2)"
        rows = rows.selectExpr(f"if(h % {noise} = 0, {less}, word) as word").where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def spelling_forms(words: DataFrame, ratio: int = 10, deepest: int = DEEPEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words``: distinct (word, n).

    Words are near if one inserted, deleted or replaced code point makes one
    the other. The form is the near word of largest n (ties: first in code
    point order) if that is ``ratio`` times the word's own n or more. Each
    form is ``ratio`` times as frequent as the one before, so chains are
    short, and doubling the steps finds every root in a few joins.

    Null and empty words are near nothing but words of one code point are
    near the empty word; repeated words and null words must not occur; an
    empty table gives an empty result; further columns are ignored.
    """
    if ratio < 2 or deepest > 64:
        raise ValueError("ratio is 2 at least, deepest 64 at most")
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = near_words(words.select("word"), deepest).join(counts, "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    frequent = -F.col("best.less") >= ratio * F.col("n")
    found = found.select("word", "n", "n_near", F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"))
    found = cut_lineage(found)
    most = found.agg(F.max("n")).first()[0] or 1
    steps = cut_lineage(found.where("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(1 + math.log(most, ratio)))):
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = cut_lineage(steps.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def near_words(words: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(word, near): all ordered pairs of distinct words that one edit apart, each once.

    The words, and the words read backwards, make two tries; a row of the
    edge table is (level, node, letter, child) and what goes on below, a node
    being the hash of the letters to it. A state (word, position, node, edits) stands at a node of
    the level in turn, and a join with the edges of that level moves all of
    them on: along the word's next letter, or, once, along another letter
    (replaced), along one that the word lacks (inserted) or past a letter of
    the word (deleted). States that have read their word with one edit and
    stand at the end of a word are neighbours.

    The edit is made in the second half of the word as read; the first half
    leads to one known node, so a word enters at the level of its middle,
    where nodes have few edges. Edits in the first half are found backwards.
    A node has at most one edge per letter, so a node where very many states
    stand is split by adaptive skew joins at the cost of a few rows.

    Words longer than ``deepest`` are paired by hashes of their parts around
    each place. All pairs are confirmed on the words.
    """
    lengths = words.select(F.length("word").alias("k")).agg(F.min("k"), F.max("k")).first()
    if lengths[1] is None:
        return words.select("word", F.col("word").alias("near"))
    least, longest = lengths
    sided = words.where(F.length("word") <= deepest).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    sided = sided.select("side", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("s"))
    edges = _edges(sided, least // 2)

    walk, folders, states = scratch_path(words.sparkSession, "walk"), [], None
    for level in range(least // 2, min(longest, deepest) + 2):
        entering = sided.where(F.expr(f"length(s) div 2 = {level}"))
        here = entering.selectExpr("side", "s", f"{level} as at", f"xxhash64(side, left(s, {level})) as node", "0 as edits")
        if states is not None:
            here = here.union(_moved(states, edges.where(F.col("level") == level - 1).drop("level")))
        folders.append(f"{walk}/{level}")
        here.write.parquet(folders[-1])
        states = words.sparkSession.read.schema(STATE).parquet(folders[-1])
    ends = sided.select("side", F.xxhash64("side", "s").alias("node"), F.col("s").alias("other"))
    there = words.sparkSession.read.schema(STATE).parquet(*folders).where("at + 1 - edits = length(s)")  # or one letter before it, which is deleted
    pairs = there.join(ends, ["side", "node"]).where(F.levenshtein("s", "other", 1) == 1)
    pairs = pairs.select(*(F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)).alias(a) for c, a in (("s", "word"), ("other", "near"))))
    if longest > deepest:
        pairs = pairs.union(_long_pairs(words.where(F.length("word") >= deepest)))
    return pairs.distinct()


def _letter(at: str) -> str:
    """Code of the letter at a place, 0 beyond the end."""
    return f"ascii(substring(s, {at} + 1, 1))"


def _bit(letter: str) -> str:
    """A letter as one of 64 bits; different letters may share it."""
    return f"shiftleft(1L, {letter} & 63)"


def _edges(sided: DataFrame, first: int) -> DataFrame:
    """(level, node, letter, child, lengths, next1, next2): the tries below their first levels.

    The last three are sets of bits over the words through the edge: how many
    letters they have left, and which letter (or end) comes next and after
    that. A state that they rule out is not moved.
    """
    places = F.explode(F.sequence(F.lit(first), F.greatest(F.length("s"), F.lit(first)))).alias("level")
    keys = ("level", "xxhash64(side, left(s, level)) as node", f"{_letter('level')} as letter", "xxhash64(side, left(s, level + 1)) as child")
    sets = ("shiftleft(1L, length(s) - level - 1) as lengths", *(f"{_bit(_letter(f'level + {k}'))} as next{k}" for k in (1, 2)))
    rows = sided.select("side", "s", places).where("level < length(s)").selectExpr(*keys, *sets)
    edges = rows.groupBy("level", "node", "letter", "child").agg(*(F.bit_or(c).alias(c) for c in ("lengths", "next1", "next2")))
    return cut_lineage(edges.sortWithinPartitions("level"))


def _moved(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one edge, as far as words go on from there.

    The word advances by one letter with the edge's own (also if replaced),
    by none (inserted) or two (deleted). Of the same letters in a row only the
    last is deleted or followed by one more. The join itself compares bits of
    all these cases at once, the few rows that it leaves are looked at singly.
    """
    read = states.where("edits = 0 or at < length(s)")
    read = read.selectExpr("*", "length(s) - at as rest", *(f"{_letter(f'at + {k}')} as c{k}" for k in range(3)))
    ahead = f"if(edits = 1, {_bit('c1')}, {_bit('c0')} | {_bit('c1')} | {_bit('c2')}) as ahead"
    left = "if(edits = 1, shiftleft(1L, rest - 1), shiftleft(1L, rest) | shiftleft(1L, greatest(rest - 1, 0)) | shiftleft(1L, greatest(rest - 2, 0))) as left"
    met = read.selectExpr("side", "s", "at", "node", "edits", "c0", "c1", ahead, left).join(edges, "node")
    met = met.where("(edits = 0 or letter = c0) and (lengths & left) <> 0 and (next1 & ahead) <> 0")
    steps = "explode(if(letter = c0, array(1), if(letter = c1, array(0, 1, 2), array(0, 1)))) as step"
    met = met.selectExpr("side", "s", "at", "child as node", "if(letter = c0, edits, 1) as edits", "lengths", "next1", "next2", steps)
    met = met.selectExpr("side", "s", "at + step as at", "node", "edits", "lengths", "next1", "next2").where("at <= length(s)")
    fits = f"(lengths & shiftleft(1L, length(s) - at)) <> 0 and (next1 & {_bit(_letter('at'))}) <> 0 and (next2 & {_bit(_letter('at + 1'))}) <> 0"
    return met.where(f"edits = 0 or ({fits})").select("side", "s", "at", "node", "edits")


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, near) of long words, by the parts before and after each letter and each gap.

    Two words of one length are near if the parts around one of their letters
    are equal; a word is near a shorter one if the parts around a letter are
    those around the gap at the same place.
    """

    def run(batches):
        for batch in batches:
            for own, word in zip(batch.column("own").to_pylist(), batch.column("word").to_pylist(), strict=True):
                letters = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                sums, n = prefix_sums(mix(letters + np.uint64(1))), len(letters)
                at = np.concatenate([np.arange(n), np.arange(n + 1)])
                gap = np.arange(2 * n + 1) >= n
                before = span_hashes(sums, np.zeros_like(at), at)
                after = span_hashes(sums, np.where(gap, at, at + 1), np.full_like(at, n))
                parts = mix(before ^ mix(after)).view(np.int64)
                columns = [pa.array(np.full(len(at), own)), pa.array(parts), pa.array(at), pa.array(gap)]
                yield pa.RecordBatch.from_arrays(columns, names=["own", "parts", "at", "gap"])

    named = cut_lineage(words.select("word", F.xxhash64("word").alias("own")))
    rows = cut_lineage(named.mapInArrow(run, "own long, parts long, at long, gap boolean"))
    letter, place = rows.where("not gap").drop("gap"), ["parts", "at"]
    replaced = letter.join(letter.withColumnRenamed("own", "other"), place).where("own <> other").select("own", "other")
    deleted = letter.join(rows.where("gap").drop("gap").withColumnRenamed("own", "other"), place).select("own", "other")
    pairs = replaced.union(deleted).union(deleted.select("other", "own")).distinct()
    other = named.select(F.col("own").alias("other"), F.col("word").alias("near"))
    return pairs.join(named, "own").join(other, "other").where(F.levenshtein("word", "near", 1) == 1).select("word", "near")
