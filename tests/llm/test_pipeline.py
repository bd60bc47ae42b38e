import random

import corpus_pipeline
from llm import brute


def test_run_keeps_the_columns_of_the_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(6)

    def some(n):
        return [f"w{rng.randrange(10_000)}" for _ in range(n)]

    passage, item, twin = some(20), some(25), " ".join(some(40))
    rows = [(d, " ".join(some(30) + (passage if d % 3 == 0 else []) + some(30))) for d in range(12)]
    rows += [(20, twin), (21, twin), (None, twin), (22, " ".join(some(30))), (None, " ".join(some(5) + item + some(5))), (None, " ".join(passage))]
    names = ["n_words", "n_removed", "spans", "kept_sha256", "own", "row", "n_chars"]
    table = [(d, t, *(f"{c}{k}" for c in names[:-1]), len(t)) for k, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[:-1]) + ", n_chars long"
    docs = spark.createDataFrame(table, schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:-1], ("packing", lambda spark, docs, sf_dir: docs)])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.schema.simpleString() == docs.schema.simpleString()

    stay = [k for k, (_, t) in enumerate(rows) if rows.index(next(r for r in rows if r[1] == t)) == k]
    gone = dict(zip(stay, brute.strip_rows([rows[k] for k in stay], 13, 8), strict=True))
    want = {k: n for k, n in gone.items() if not brute.shingle_set(" ".join(item)) <= brute.shingle_set(rows[k][1])}
    by_row = {int(r.row[3:]): r for r in got.collect()}
    assert set(by_row) == set(want) and any(want.values())
    for k, r in by_row.items():
        assert len(brute.words_of(r.text)) == len(brute.words_of(rows[k][1])) - want[k]
        assert [r[c] for c in names[:-1]] == [f"{c}{k}" for c in names[:-1]] and r.n_chars == len(r.text)
