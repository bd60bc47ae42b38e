import random

import corpus_pipeline
from wardline.llm.neardup import near_duplicates


def texts(rng, n, words=30):
    return [" ".join(f"w{rng.randrange(10_000)}" for _ in range(words)) for _ in range(n)]


def test_one_row_of_a_group_stays(spark, make):
    a, b, c, d = texts(random.Random(3), 4)
    rows = [(5, a), (5, a), (2, a), (None, a), (None, b), (None, b), (7, c), (7, c), (8, d), (None, ""), (None, None)]
    docs = make(rows).selectExpr("*", "1 as row").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(2, a), (None, b), (7, c), (8, d), (None, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_benchmark_is_found_under_any_id(spark, make, tmp_path):
    a, b = texts(random.Random(4), 2)
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make([(None, f"x {a} y"), (None, b), (3, a), (3, b), (4, b)])
    got = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, b), (3, b), (4, b)], key=str)


def test_classes_of_one_id_are_linked(make):
    a, b = texts(random.Random(5), 2)
    docs = make([(1, a), (5, a), (5, b), (3, b), (9, b)])
    assert {r.component_id for r in near_duplicates(docs).collect()} == {1}


def test_free_memory_goes_back_between_tasks():
    from wardline.llm.batches import slices

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    blocks = [bytes(4000 + i % 9) for i in range(50_000)]
    kept = blocks[-1]  # lies above the others, so malloc keeps them
    before = resident()
    del blocks
    assert list(slices(iter([]), "text")) == []
    assert kept and before - resident() > 100e6
