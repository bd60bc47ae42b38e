import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import brute
from wardline.llm import chat
from wardline.llm.decontaminate import contained_items, decontaminate
from wardline.llm.lines import clean_lines
from wardline.llm.packing import _Encoder, pack, pack_documents, plan
from wardline.llm.pretokens import Cutter, merged, read_vocabulary
from wardline.llm.quality import Forest, fit, quality_model, quality_scores
from wardline.llm.tokens import count_tokens
from wardline.llm.toxicity import toxicity_model, toxicity_scores, without_toxic

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def odd_texts(n=300):
    rng = random.Random(1)
    letters = ["a", "A", "bz", "É", "é", "Σ", "ς", "İ", "ß", "\u0085", "​", "'s", "'", "!?", ".", "<|startoftext|>", "<|endoftext|>", "12", "½", "漢", "🙂", "\n", "\t ", "<|", "é"]
    return ["", "a" * 500, "ab" * 300, "<|startoftext|> hi<|endoftext|>"] + ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(n)]


def test_merging_equals_the_library(library):
    v = read_vocabulary(PATH)
    cutter = Cutter(v)
    for text in odd_texts():
        ids = []
        for special, words in cutter.cut(text):
            ids += [special] if special is not None else merged(words, v)[0].tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_every_code_point_is_cut_as_the_library_does(library):
    v = read_vocabulary(PATH)
    cutter, known = Cutter(v), _Encoder(open(PATH, encoding="utf-8").read())
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c} C{c}." for c in letters]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        parts = cutter.cut(text)
        assert len(parts) == 1
        assert np.frombuffer(b"".join(map(known.__getitem__, parts[0][1])), dtype="<u4").tolist() == want.ids, hex(ord(text[1]))
    changed = [t for c, t in zip(letters, texts) if c in "\u0130\u0558\ua7cb\ua7dc\u1c89\u03a3"]
    for text in changed:
        assert len(merged(cutter.cut(text)[0][1], v)[0]) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(make, library):
    rows = [*enumerate(odd_texts(80)), (None, "x y"), (500, None)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(make(rows), PATH, limit=30).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 30)
    assert count_tokens(make([]), PATH).count() == 0


def test_packing_keeps_every_piece(make, corpus, library):
    import zlib

    docs, rows = corpus
    got = pack_documents(docs, PATH).collect()
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in rows}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.05 * sum(map(len, ids.values())) / 2048 + 1
    assert pack_documents(make([]), PATH).count() == 0
    assert [r.length for r in pack_documents(make([(1, None), (1, None)]), PATH).collect()] == [1, 1]


def test_plan_uses_each_length_as_often_as_it_is_there():
    rng = random.Random(2)
    for size in (1, 7, 64):
        counts = Counter(rng.randint(1, size) for _ in range(400))
        found = Counter()
        for lengths, times in plan(counts, size):
            assert sum(lengths) <= size
            for x in lengths:
                found[x] += times
        assert found == counts
    assert sum(t for _, t in plan({4: 10, 3: 10, 2: 5, 1: 10}, 8)) == 12  # 90 units


def test_hot_length_is_ranked_without_gaps(spark):
    rows = pack(spark.range(5000).select("id", F.lit(512).cast("long").alias("length"))).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("offset").alias("s")).collect()
    assert len(rows) == 1250 and all((r.n, r.s) == (4, 3072) for r in rows)


def plain_rules(t):
    t = t or ""
    w, seen, dup = brute.words_of(t), set(), 0
    for line in t.split("\n"):
        if brute.words_of(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    m = [0] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            m[i : i + 5] = [1] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(m), len(w) < 10 or 100 * sum(m) > 20 * len(w)


def test_rules(make, corpus):
    docs, rows = corpus
    rows = rows + [(9000, None), (9001, ""), (9002, "\n\na\n\na\n"), (None, "ü é | x\n" * 9)]
    for r in clean_lines(make(rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(r.text)
        assert not (r.base_failed and r.kept)
    prose = (
        "The harbour was quiet when the first boats came back.\nNobody had expected such weather so late in autumn.\n"
        "Her brother carried two heavy baskets up the narrow stairs.\nLater they all sat by the fire and told old stories.\n"
    )
    bad = "Home | About | News | Contact\nCLICK HERE FOR MORE OF ALL THE VERY BEST THINGS\nAll rights reserved by us.\n"
    got = clean_lines(make([(1, prose + bad), (2, bad + "One short line of prose is here.")])).orderBy("doc_id").collect()
    assert got[0].kept and got[0].cleaned == prose.strip() and got[0].n_failed_lines == 3 and not got[1].kept
    assert clean_lines(make([])).count() == 0


def test_quality(spark, make, corpus):
    docs, _ = corpus
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_scores(base[0], quality_model(*base)).join(base[1], "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    none = quality_model(docs, base[1].limit(0))
    got = quality_scores(make([(1, None), (2, ""), (None, "a b")]).withColumn("label", F.lit(1)), none).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(make([]), none).count() == 0


def test_forest_traversal_equals_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = fit(x, y, trees=20, depth=3)
    assert isinstance(forest, Forest)
    for row, score in zip(x[:50], forest.score(x[:50]), strict=True):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - 7]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_toxicity(spark, make):
    rng = random.Random(3)
    bad = ["vile", "idiot", "scum"]
    rows, labels = [], []
    for i in range(900):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), b.upper() + "!")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity_model(make(rows), known)
    got = toxicity_scores(make(rows), model).where("held_out").collect()
    truth = dict(labels)
    assert len(got) > 100 and sum(r.predicted == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    long_text = " ".join(f"w{rng.randrange(300)}" for _ in range(3000))
    odd = make([(1, None), (2, ""), (3, long_text), (4, long_text + " vile scum idiot"), (None, "x")]).withColumn("label", F.lit(1))
    assert sorted(r.predicted for r in toxicity_scores(odd, model).collect()) == [0, 0, 0, 0, 1]
    assert without_toxic(odd, model).count() == 4 and without_toxic(odd, model).columns == odd.columns
    empty = toxicity_model(make(rows), known.limit(0))
    assert without_toxic(make(rows), empty).count() == 900 and toxicity_scores(make([]), model).count() == 0


def test_contained_items(spark, make):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(5, 60)))) for i in range(30)] + [(40, "short one"), (41, None), (42, " ")]
    rows = []
    for i in range(60):
        w = [f"x{rng.randrange(200)}" for _ in range(rng.randrange(0, 400))]
        if i % 2:
            piece = rng.choice(items[:30])[1].upper().split()
            for _ in range(rng.randrange(0, 4)):
                piece[rng.randrange(len(piece))] = "z"
            w[len(w) // 2 : len(w) // 2] = piece
        rows.append((i, "\n".join(w)))
    rows += [(100, "Short  one"), (101, "a short one"), (102, None), (103, ""), (None, items[0][1])]
    want = set()
    for d, t in rows:
        for i, s in items:
            own = brute.shingle_set(s)
            if d is not None and own and 100 * len(own & brute.shingle_set(t)) >= 80 * len(own):
                want.add((d, i))
    table = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contained_items(make(rows).withColumn("key", F.lit(1)), table).collect()}
    assert got == want and len(want) > 10
    flags = {r.doc_id: r.kept for r in decontaminate(make(rows), table).collect()}
    assert len(flags) == len(rows) and {d for d, k in flags.items() if not k} == {d for d, _ in want}
    assert decontaminate(make([]), table).count() == 0 and decontaminate(make(rows), table.limit(0)).where("kept").count() == len(rows)


def test_chat_round_trip(spark):
    texts = ["", None, "plain", r"</s>[INST] ok [/INST]", r"<\/s>[\\INST]", "<s>[SYS][/ROLE]x[/TURN]", "[", "<", "\\", "a\n$1 é🙂", "[\\", "<</s>"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "x[/ROLE]y", None]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 7))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(chat.turns_of_rows(table))
    got = chats.select("turns", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == 60
    for r in got:
        assert r.back == r.turns
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
    assert chat.turns_of_rows(table.limit(0)).count() == 0


def test_layouts(spark):
    payloads = [
        ('{"prompt": "q", "response": "a"}', [("user", "q"), ("assistant", "a")]),
        ('{"response": null, "prompt": "q"}', [("user", "q"), ("assistant", "")]),
        ('{"instruction": "i", "input": "n", "output": "o"}', [("user", "i\nn"), ("assistant", "o")]),
        ('{"messages": [{"role": "user", "content": "x"}, {"content": "y", "role": "assistant"}]}', [("user", "x"), ("assistant", "y")]),
        ('{"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}', [("user", "x"), ("assistant", "y")]),
        ('{"other": 1}', None),
        ("not json", None),
        (None, None),
    ]
    table = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(payloads)], "i int, payload string")
    for r in chat.turns_of_json(table, "payload").collect():
        want = payloads[r.i][1]
        assert (None if r.turns is None else [(t.role, t.text) for t in r.turns]) == want, r
