import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from llm import brute
from wardline.llm import spellings, warc
from wardline.llm.middles import fill_in_middle, restored
from wardline.session import scratch_path

PAGES = "page_id long, url string, html string, shard int"


def written(spark, rows, layout=warc.Layout(least_shards=4), parts=3):
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(parts), path, layout)
    return path, warc.read_warc(spark, path).collect()


def files_of(path):
    return {f.name: f.read_bytes() for f in Path(path.removeprefix("file:")).glob("*.warc.gz")}


def test_archives_are_read_back(spark):
    rows = [(3, "http://a/x y\r\nEvil: 1", "<p>é", 1), (1, None, "<p>é", 1), (2, "u", None, 1), (None, "u", "", 1), (5, "v", "lone " * 300_000, 1), (1, None, "<p>é", 2), (None, None, None, None)]
    path, got = written(spark, rows)
    assert len(got) == len(rows) and all(r.intact for r in got)
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=repr) == sorted(
        [(1, "response", None, 5), (1, "revisit", 1, 5), (3, "revisit", 1, 5), (2, "response", None, 0), (None, "revisit", 2, 0), (None, "revisit", 2, 0), (5, "response", None, 1_500_000)], key=repr
    )
    by_id = {r.page_id: r for r in got if r.record_type == "response"}
    assert bytes(by_id[5].payload) == b"lone " * 300_000 and by_id[1].target_uri == "urn:page:1"
    assert by_id[2].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"  # SHA-1 of nothing
    assert next(r.target_uri for r in got if r.page_id == 3) == "http://a/x%20y%0D%0AEvil:%201"
    assert len({r.record_id for r in got}) == len(rows)
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    listed = {r.file: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    files = files_of(path)
    assert {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()} == {n: (r.bytes, r.sha256) for n, r in listed.items()}
    assert not (Path(path.removeprefix("file:")) / "_temporary").exists()
    for name, data in files.items():  # every record is a member of its own
        members = 0
        while data:
            member = zlib.decompressobj(31)
            assert member.decompress(data).startswith(warc.VERSION)
            data, members = member.unused_data, members + 1
        assert members == listed[name].records + 1


def test_files_do_not_depend_on_partitions_and_are_rolled(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc <>", k=rng.randrange(3000))) for _ in range(40)]
    rows = [(rng.randrange(60), "u", rng.choice(texts), None) for _ in range(200)]
    layout = warc.Layout(least_shards=2, file_bytes=10_000)
    first, second = (files_of(written(spark, rows, layout, n)[0]) for n in (1, 5))
    assert first == second and len(first) > 4
    assert max(map(len, first.values())) < 15_000


@pytest.mark.parametrize("least", [0, 6])
def test_hot_payloads_give_the_same_records(spark, least):
    rows = [(i % 50 if i % 7 else None, f"u{i % 3}", "hot" * 3 if i % 3 else "x" * (i % 5), i) for i in range(300)]

    def plain(got):
        return sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.target_uri, r.record_id) for r in got), key=repr)

    cold = written(spark, rows, warc.Layout(least_shards=4, least_bytes=least))[1]
    hot = written(spark, rows, warc.Layout(least_shards=4, least_bytes=least, hot_copies=20))[1]
    assert plain(cold) == plain(hot) and all(r.intact for r in hot)
    firsts = Counter(r.payload_digest for r in hot if r.record_type == "response" and r.payload_bytes >= least)
    assert set(firsts.values()) == {1}


def test_empty_archive_and_cut_off_file(spark):
    path, got = written(spark, [])
    assert got == []
    path, got = written(spark, [(1, "u", "text", 1)])
    name, data = next(iter(files_of(path).items()))
    damaged = gzip.decompress(data)[:-3]
    with pytest.raises(ValueError):
        import io

        list(warc.read_records(io.BytesIO(gzip.compress(damaged))))


def cut_plainly(doc, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", low, high - low, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_middles_equal_plain_cuts(spark, corpus):
    rng = random.Random(2)
    odd = [None, "", "a", "é漢🙂", "has <S> in", "<P", "漢é" * 1_500_000, *("".join(rng.choices("a<PSM>é🙂\n", k=rng.randrange(60))) for _ in range(150))]
    rows = [*((i, t, "x") for i, t in enumerate(odd)), (None, "no id", "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    for df, want in ((docs, [r[:2] for r in rows]), corpus):
        got = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(((d, *cut_plainly(d, t)) for d, t in want), key=repr)
        assert Counter(r.back for r in got) == Counter(t or "" for _, t in want)
    assert fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, marks=("ab", "ba", "c"))


def words_plainly(docs, noise=31):
    import re

    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def forms_plainly(counts, ratio=10):
    near, around = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            around[w[:i], w[i + 1 :]].add(w)
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    for group in around.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def forms_of(words):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spellings.spelling_forms(words).collect()}


def test_spellings_of_documents(make, corpus):
    docs, rows = corpus
    words = spellings.vocabulary(docs)
    counts = words_plainly(rows)
    assert {r.word: r.n for r in words.collect()} == counts
    assert forms_of(words) == forms_plainly(counts)
    odd = [(None, "Straßenbahn STRASSENBAHN straßenbahn Àéîõü÷× Àéîõü÷× àéîõü÷×"), (1, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000), (4, "abcdefg abcdefg")]
    assert {r.word: r.n for r in spellings.vocabulary(make(odd)).collect()} == words_plainly(odd)
    assert spellings.vocabulary(make([])).count() == 0


def test_walk_finds_every_edit(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("abé", k=rng.randrange(7))) for _ in range(500)}  # dense, with repeated letters and the empty word
    long = "".join(rng.choices("abcÿ", k=64))
    words |= {long, long + "a", long[1:], long[:30] + long[31:], long[:40] + "z" + long[40:], long[:63] + "q", "b" + long, "bb" + long, "a" * 70, "a" * 71, "a" * 30 + "b" + "a" * 40}
    counts = {w: rng.choice([1, 1, 2, 5, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = forms_plainly(counts)
    assert forms_of(df) == want
    assert any(root not in (w, form) for w, (form, root, *_) in want.items())
    assert {r.word: r.n_near for r in spellings.spelling_forms(df, deepest=4).collect()} == {w: v[3] for w, v in want.items()}
    assert forms_of(df.limit(0)) == {}
