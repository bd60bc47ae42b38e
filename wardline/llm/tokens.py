"""Token counts by rank-synchronous merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.batches import slices
from wardline.llm.pretokens import Cutter, merged, read_vocabulary

#: pre-tokens a task remembers before it starts anew, and the longest one it remembers
MEMORY, LONGEST = 400_000, 64


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): the tokens of every whole text.

    ``path`` names the tokenizer's file; it is read once and its tables (3 MB)
    go to the tasks. Texts are cut into pre-tokens; those that a task has not
    seen yet are merged together, see ``merged``. Strings of special tokens in
    a text count as these tokens, nothing is added or cut off.

    Null and empty texts have 0 bytes and 0 tokens; rows with null or repeated
    ids are counted like others; an empty table gives an empty result; further
    columns are ignored.
    """
    vocabulary = read_vocabulary(path)

    def run(batches):
        cutter, known = Cutter(vocabulary), {}
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            parts = [cutter.cut(t or "") for t in texts]
            if len(known) > MEMORY:
                known.clear()
            fresh = {w for p in parts for _, words in p for w in words}.difference(known)
            fresh = list(fresh)
            _, bounds = merged(fresh, vocabulary)
            sizes = dict(zip(fresh, np.diff(bounds).tolist(), strict=True))
            known |= sizes
            counts = [sum(sum(map(known.__getitem__, words)) if s is None else 1 for s, words in p) for p in parts]
            for w in fresh:
                if len(w) > LONGEST:
                    del known[w]
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            counts = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(counts), pa.array(counts > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
