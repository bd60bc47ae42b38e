import random

import pytest

from llm import brute
from wardline.llm.neardup import near_duplicates
from wardline.llm.substrings import remove_repeated_bytes, remove_repeated_words


def words(rng, n, kinds=500):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(40)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def cloud():
    """Copies, near copies around two centres (many near the limit), short and odd texts."""
    rng = random.Random(5)
    rows = []
    for _ in range(2):
        base = words(rng, 120)
        rows += [" ".join(base)] * 6 + [edited(rng, base, rng.randrange(0, 9)) for _ in range(120)]
        rows += [" ".join(base).upper(), "\t\n" + "\r\x0b ".join(base) + " "]
    rows += ["a b", "A  b", "a b c", "", None, "  \n", "one two three four five", "one two three four five"]
    rows += [" ".join(words(rng, 300)) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(make, cloud, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make(cloud), percent).collect()}
    assert got == brute.near_groups(cloud, percent)


def test_near_duplicates_of_the_table(corpus):
    docs, rows = corpus
    got = near_duplicates(docs, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing_and_of_odd_rows(spark, make):
    assert near_duplicates(make([])).count() == 0
    odd = make([(None, "a b c d e f"), (3, None), (4, ""), (5, "x"), (5, "x")]).selectExpr("*", "1 as id", "2 as kept", "3 as component_id")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect())
    assert got == [(3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True)]


def test_a_crowd_near_the_limit_is_not_compared_pair_by_pair(make, monkeypatch):
    """600 texts that each lack 5 of 40 blocks: nothing in them is rare, and few pairs are linked."""
    rng = random.Random(3)
    blocks = [words(rng, 20, 10**6) for _ in range(40)]
    gone = [set(rng.sample(range(40), 5)) for _ in range(600)]
    rows = [(i, " ".join(w for k, block in enumerate(blocks) if k not in out for w in block)) for i, out in enumerate(gone)]
    docs, compared = make(rows), []
    kind = type(docs)
    plain = kind.mapInArrow

    def counted(self, function, schema, *rest):
        if str(schema).startswith("src long, dst long"):
            compared.append(self.count())
        return plain(self, function, schema, *rest)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 85).collect()}
    assert got == brute.near_groups(rows, 85)
    assert sum(compared) < 100 * len(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_crowds_with_frequent_edits_equal_brute_force(make, percent):
    """Edits that many texts share, with and without their centre."""
    rng = random.Random(17)
    rows = []
    for middle in (True, False):
        base = words(rng, 100)
        for _ in range(250):
            out = list(base)
            for _ in range(rng.randrange(1, 9)):
                out[rng.randrange(100)] = f"e{rng.randrange(2)}"
            rows.append(" ".join(out))
        rows += [" ".join(base)] if middle else []
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make(rows), percent).collect()}
    assert got == brute.near_groups(rows, percent)


@pytest.mark.parametrize("crowd", [0, 512])
def test_repeated_words_equal_brute_force(make, cloud, crowd):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_words(make(cloud), crowd=crowd).collect()}
    assert got == brute.strip_words(cloud)


@pytest.mark.parametrize("crowd", [0, 512])
def test_repeated_bytes_equal_brute_force(make, cloud, crowd):
    rows = cloud + [(1000, "ab" * 400), (1001, "é" * 300 + "\0" * 200), (1002, "ab" * 60 + "c" + "ab" * 60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(make(rows), crowd=crowd).collect()}
    assert got == brute.strip_bytes(rows)


def test_repeats_of_the_table(corpus):
    docs, rows = corpus
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_words(docs).collect()}
    assert got == brute.strip_words(rows)


def test_repeats_keep_columns_and_white_space(make):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = make([(1, f"x\n{passage}\ty"), (2, f"start  here\n{passage}\nthe end"), (3, None), (None, passage)]).selectExpr("*", "'k' as n_words", "7 as extra")
    got = {r.doc_id: r for r in remove_repeated_words(docs).collect()}
    assert got[2].text == "start  here\nthe end" and got[2].n_removed == 20 and got[2].extra == 7
    assert [(s.start, s.end) for s in got[2].spans] == [(2, 22)]
    assert got[1].n_removed == 0 and got[3].text is None and got[None].text == "" and got[1].n_words == 22
    assert remove_repeated_words(make([])).count() == 0 and remove_repeated_bytes(make([])).count() == 0


@pytest.fixture(scope="module")
def twins(spark):
    """Rows that share an id or have none, with passages of smaller ids, on 16 blocks."""
    rng = random.Random(11)
    passages = [words(rng, n, 10_000) for n in (14, 15, 20, 40, 60)]
    rows = [(k, " ".join(words(rng, 6, 10_000) + p + words(rng, 6, 10_000))) for k, p in enumerate(passages)]
    for d in (50, 51, None):
        for p in passages:
            text = " ".join(words(rng, 8, 10_000) + p + words(rng, 8, 10_000))
            rows += [(d, text)] * 3 + [(d, text + " tail"), (d, "head of it " + text)]
    rows += [(60 + k, " ".join(words(rng, 3, 10_000) + passages[4][k:] + words(rng, 3, 10_000))) for k in range(20)]
    rows += [(90, "ab" * 200), (90, "ab" * 200), (None, "ab" * 300)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(k, d, t) for k, (d, t) in enumerate(rows)], "row int, doc_id long, text string")
    return table.repartitionByRange(16, "row"), rows


@pytest.mark.parametrize("crowd", [0, 3, 512])
def test_rows_of_one_id_lose_the_same_words(twins, crowd):
    docs, rows = twins
    got = {r.row: r.n_removed for r in remove_repeated_words(docs, crowd=crowd).collect()}
    assert [got[k] for k in range(len(rows))] == brute.strip_rows(rows, 13, 8)


@pytest.mark.parametrize("crowd", [0, 3, 512])
def test_rows_of_one_id_lose_the_same_bytes(twins, crowd):
    docs, rows = twins
    got = {r.row: r.n_removed for r in remove_repeated_bytes(docs, length=60, crowd=crowd).collect()}
    assert [got[k] for k in range(len(rows))] == brute.strip_rows(rows, 60, 1, same_text=True)


def test_groups_are_built_once_where_no_link_is_found_later(make, monkeypatch):
    from wardline.llm import neardup

    runs, built = [], neardup.connected_components
    monkeypatch.setattr(neardup, "connected_components", lambda edges: runs.append(edges) or built(edges))
    rng = random.Random(3)
    base = words(rng, 200)
    rows = list(enumerate([" ".join(base), " ".join(base + ["x"]), *(" ".join(words(rng, 50)) for _ in range(5))]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make(rows), 85).collect()}
    assert got == brute.near_groups(rows, 85)
    assert len(runs) == 1
