import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import components as C
from wardline.operators import neardup as N


def chunks_by_hand(text, size=50, overlap=10, compat=False):
    if compat:
        runs = [m.span() for m in re.finditer(r"\s+", text)]
        out = []
        for i in range(-(-len(runs) // size)):
            a, b = max(i * size - overlap, 0), min((i + 1) * size + overlap, len(runs) - 1)
            out.append((text[runs[a][0] : runs[b][1]].strip(), runs[a][0], runs[b][1]))
        return out
    words = [m.span() for m in re.finditer(r"\S+", text)]
    out = []
    for i in range(-(-len(words) // size)):
        a, b = max(i * size - overlap, 0), min((i + 1) * size + overlap, len(words))
        out.append((text[words[a][0] : words[b - 1][1]], words[a][0], words[b - 1][1]))
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_chunks(spark, compat):
    rng = random.Random(1)
    sizes = [0, 1, 2, 49, 50, 51, 60, 61, 100, 101, 250, 1234]
    gaps = [" ", "  ", "\n", "\t ", " "]
    texts = [
        "".join(rng.choice("abcdé") * rng.randrange(1, 6) + rng.choice(gaps) for _ in range(n)) for n in sizes
    ] + ["  lead and trail  ", "plain", "", None] + [" ".join(["w"] * n) for n in (50, 51, 52, 101)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for r in N.split_documents(df, compat=compat).collect():
        got.setdefault(r.i, []).append((r.text, r.start_index, r.end_index))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, []), key=lambda c: c[1:]) == sorted(chunks_by_hand(text or "", compat=compat), key=lambda c: c[1:]), i


def components_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("hubs", [False, True])
def test_components_equal_union_find(spark, monkeypatch, hubs):
    if hubs:
        monkeypatch.setattr(C, "MIN_HOT_ROWS", 3)
        monkeypatch.setattr(C, "MAX_HOT", 10)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(10)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 301), (400, 400)]
    edges += [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(150)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in C.connected_components(df).collect()}
    assert got == components_by_hand([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert C.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def jaccard(a, b, n=13):
    def grams(t):
        w = re.split("[^A-Za-z_0-9]", t)
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    a, b = grams(a), grams(b)
    return len(a & b) / max(1, len(a | b))


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = {i: " ".join(rng.choice(words) for _ in range(400)) for i in range(30)}
    for i in range(8):  # exact copies and copies with one word changed at the end
        texts[100 + i] = texts[i]
        texts[200 + i] = texts[i] + " tail"
    texts[300] = "short text"
    texts[301] = "short text"
    texts[302] = "another short"
    texts[303] = None
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    kept = {r.id for r in N.near_dedup(df).collect()}
    assert kept == set(range(30)) | {300, 302, 303}
    for i in range(8):
        assert jaccard(texts[i], texts[200 + i]) >= 0.85
    compat = {r.id for r in N.near_dedup(df, compat=True).collect()}
    assert compat == set(range(30)) | {300, 303}
    stats = N.dedup_stats(df, df.where("id < 10")).first()
    assert (stats.before, stats.after, stats.duplicates) == (len(texts), 10, len(texts) - 10)


def test_band_recall_against_exact_pairs(spark):
    rng = random.Random(9)
    base = [" ".join(f"v{rng.randrange(5000)}" for _ in range(600)) for _ in range(40)]
    texts = {i: t for i, t in enumerate(base)}
    for i, t in enumerate(base):
        w = t.split()
        w[rng.randrange(600)] = "changed"
        texts[1000 + i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = [(i, 1000 + i) for i in range(40) if jaccard(texts[i], texts[1000 + i]) >= 0.85]
    assert len(pairs) == 40
    parts = {r.node: r.component for r in C.connected_components(N.band_candidates(N.banded_texts(df))).collect()}
    found = sum(parts.get(a) is not None and parts.get(a) == parts.get(b) for a, b in pairs)
    assert found / len(pairs) >= 0.9


def test_a_bucket_with_a_third_of_all_rows_gives_star_edges(spark, monkeypatch):
    from functools import partial

    monkeypatch.setattr(N, "hot_from_counts", partial(N.hot_from_counts, max_hot=10, min_rows=5))
    rows = [(i, 0, b"same") for i in range(100)] + [(i, 1, str(i).encode()) for i in range(200)]
    bands = spark.createDataFrame(rows, "id long, band int, key binary")
    edges = N.band_candidates(bands).collect()
    assert sorted(map(tuple, edges)) == [(i, 0) for i in range(1, 100)]


def signature_by_hand(text, a, b, compat=False):
    import hashlib

    w = re.split("[^A-Za-z_0-9]", text)
    grams = {" ".join(w[i : i + 13]) for i in range(len(w) - 12)} or (set() if compat else {" ".join(w)})
    hashes = [int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams]
    return [min([((h * int(x) + int(y)) % 2**64) % N.RING & N.MASK for h in hashes], default=N.MASK) for x, y in zip(a, b)]


def test_signatures_use_the_smallest_permuted_hash(spark):
    rng = random.Random(6)
    words = ["a", "bc", "é", "x-y", "", "_z9"]
    texts = ["", "!", "one two", None, *(" ".join(rng.choices(words, k=rng.choice([5, 12, 13, 14, 60, 900]))) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    a, b = N.permutations()
    for compat in (False, True):
        got = {r.i: r.sign for r in N.signed(df, compat=compat).collect()}
        assert got == {i: None if t is None else signature_by_hand(t, a, b, compat) for i, t in enumerate(texts)}


def test_a_batch_is_unpacked_in_runs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    texts = [None if i % 7 == 3 else "".join(f"{rng.randrange(2**32):08x}" for _ in range(i % 5)) for i in range(60)]
    monkeypatch.setattr(N, "UNPACK", 80)
    found, at = [], 0
    for start, hashes, bounds in N.unpacked(pa.array(texts, pa.string())):
        assert start == at and len(hashes) <= 10 + 4  # a run holds the digits it may and one text more
        found += [hashes[i:j].tolist() for i, j in zip(bounds, bounds[1:])]
        at = len(found)
    assert found == [np.frombuffer(bytes.fromhex(t or ""), dtype="<u4").tolist() for t in texts]


def test_band_keys_are_stored_before_they_are_read_again(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d")], "id long, text string")
    assert N.banded_texts(df).inputFiles()


def test_documents_of_one_row_group_are_dealt_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from checks.views import Views

    table = pa.table({"doc_id": list(range(400)), "text": [f"{i} " * 50 for i in range(400)]})
    pq.write_table(table, tmp_path / "documents.parquet", compression="none", use_dictionary=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        sizes = Views(spark, str(tmp_path)).raw("documents").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(r["count"] for r in sizes) == 400 and max(r["count"] for r in sizes) < 200


def test_bands_and_rows_of_a_threshold(spark):
    assert N.band_layout(0.85) == (N.BANDS, N.ROWS)
    for t in (0.3, 0.5, 0.7, 0.9):
        bands, rows = N.band_layout(t)
        assert bands * rows <= N.NUM_PERM and abs((1 / bands) ** (1 / rows) - t) < 0.12
    base = " ".join(f"w{i}" for i in range(600))
    half = " ".join(f"w{i}" if i < 450 else f"v{i}" for i in range(600))  # 437 of 739 n-grams are shared
    df = spark.createDataFrame([(1, base), (2, half), (3, "short one"), (4, "short one"), (5, "short two"), (6, None)], "id long, text string")
    assert {r.id for r in N.near_dedup(df).collect()} == {1, 2, 3, 5, 6}
    assert {r.id for r in N.near_dedup(df, threshold=0.5).collect()} == {1, 3, 5, 6}
    with pytest.raises(ValueError):
        N.near_dedup(df, threshold=1.0)


def test_running_sums(spark):
    numbers = [random.Random(3).randrange(100) for _ in range(1000)]
    for n in (0, 1, 255, 256, 257, 1000):
        df = spark.createDataFrame([(numbers[:n],)], "xs array<int>").select(N.running_sums(F.col("xs")).alias("sums"))
        got = df.select([N.sum_at(F.col("sums"), F.lit(i)).alias(f"s{i}") for i in range(0, n, 51)]).first() if n else []
        assert list(got) == [sum(numbers[: i + 1]) for i in range(0, n, 51)]


def test_a_long_text_is_cut_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.range(1).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))).alias("text"))
        start = time.perf_counter()
        df.select(F.size(N.chunk_text(F.col("text")))).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 40 * max(seconds(20_000), 0.3)


def test_few_rows_have_no_hubs(spark):
    degrees = spark.createDataFrame([(1, 5)], "node long, n long")
    assert C._hubs(degrees, C.MIN_HOT_ROWS) is None
    assert C._hubs(degrees, C.MIN_HOT_ROWS + 1) is not None


def test_gram_codes_of_texts_in_a_batch():
    import hashlib

    import pyarrow as pa

    texts = [None, "", "a-\U0001f600é b", "  ", "x" * 20, " ".join(f"w{i}é" for i in range(14))]
    for compat in (False, True):
        got = N.gram_codes(pa.array(texts), compat=compat).to_pylist()
        for text, codes in zip(texts, got, strict=True):
            if text is None:
                assert codes is None
                continue
            w = re.split("[^A-Za-z_0-9]", text)
            grams = [" ".join(w[i : i + 13]) for i in range(len(w) - 12)] or ([] if compat else [" ".join(w)])
            assert codes == "".join(hashlib.sha1(g.encode()).hexdigest()[:8] for g in grams)


def test_patients_are_split_before_texts_are_cut(spark, monkeypatch):
    from wardline.plans import documents as D

    plans, split = [], D.label_covering_split
    monkeypatch.setattr(D, "label_covering_split", lambda s, *a, **k: plans.append(s._jdf.queryExecution().toString()) or split(s, *a, **k))
    rows = [("1", "e", "c", "p1", "one two"), ("2", "e", "c", "p2", None), ("3", "e", "c", "p3", "  \n"), ("4", "e", "c", "p4", " three")]
    reports = spark.createDataFrame(rows, "diagnostic_report_id string, encounter_id string, category_display string, patient_id string, text string")
    got = {r.patient_id for r in D.pretrain_documents(reports).collect()}
    assert got == {"p1", "p4"}
    assert "Generate" not in plans[0]
