"""Near-duplicate documents by SuperMinHash signatures.

Every distinct shingle of a text draws a random number and a random
permutation of the signature's slots. In round j it offers (j, number) to the
slot that its permutation has at place j; a slot keeps the smallest offer.
Offers of later rounds are larger, so a text stops as soon as all its slots
are filled: long texts need one round. Slots are banded; texts that meet in a
band are compared on their full shingle sets, and verified links are grouped
by connected components.

Rows with equal shingle sets are one class from the start, so copies cost one
row each. In a band with k classes the smallest one is compared with the
k - 1 others. While large bands are in several groups, further classes are
drawn to be compared with the rest of their band, and linked groups merge
between these rounds. Only bands whose classes are then still in several
groups compare classes across groups. Before that, exact bounds take out what
can't be linked any more: sizes that differ too much, sets with too many rare
shingles, and sets too far from their band's smallest one for what they can
share against it (most members of a cloud of near copies that are not linked
to its centre). No link between different texts is lost to the bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.batches import Words, mix, raw, shingles, slices, sums_by
from wardline.operators.components import connected_components
from wardline.session import cut_lineage

BANDS, ROWS = 25, 4
RARE = 20
#: further stars are drawn, ROUNDS times at most, while a row of a band has more partners than this in other groups
PARTNERS, ROUNDS = 2, 6
_U = np.uint64
_SKETCH = "id long, n_shingles long, key_a long, key_b long, bands array<long>"


def superminhash(text: np.ndarray, element: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """Signatures (texts x slots) of sets given as (text, element hash), ordered by text.

    A slot holds round << 32 | 32-bit random number. Texts without elements
    keep the empty mark slots << 32.
    """
    empty = _U(slots << 32)
    out = np.full(texts * slots, empty, dtype=_U)
    live, owner, places = element, text.astype(np.int64), None
    for j in range(slots):
        if not len(live):
            break
        drawn = mix(live + _U(((j + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((drawn >> _U(32)) * _U(slots - j)) >> _U(32)).astype(np.int64)).astype(np.int64)
        if places is None:
            slot = k
        else:
            rows = np.arange(len(live))
            slot = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, j]
            places[:, j] = slot
        np.minimum.at(out, owner * slots + slot, (drawn & _U(0xFFFFFFFF)) | _U(j << 32))
        open_ = (out.reshape(texts, slots) == empty).any(axis=1)
        stay = open_[owner]
        if places is None:
            live, owner, k = live[stay], owner[stay], k[stay]
            places = np.tile(np.arange(slots, dtype=np.uint8 if slots < 256 else np.uint16), (len(live), 1))
            places[np.arange(len(live)), k] = 0
            places[:, 0] = k
        elif not stay.all():
            live, owner, places = live[stay], owner[stay], places[stay]
    return out.reshape(texts, slots)


def _sketches(size: int, bands: int, rows: int):
    def run(batches):
        for batch in slices(batches, "text"):
            n = batch.num_rows
            text, h = shingles(Words(batch.column("text"), lower=True), size)
            signature = superminhash(text, h, n, bands * rows)
            band = np.zeros((n, bands), dtype=_U) + np.arange(bands, dtype=_U)
            for r in range(rows):
                band = mix(band * _U(0x9E3779B97F4A7C15) + signature[:, r::rows])
            counts = np.bincount(text, minlength=n).astype(np.int64)
            keys = [sums_by(text, mix(h ^ _U(seed)), n).view(np.int64) for seed in (0x51ED270B, 0x2545F491)]
            flat = pa.array(np.ascontiguousarray(band).view(np.int64).ravel())
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32))
            if (counts == 0).any():
                flat = flat.filter(pa.array(np.repeat(counts > 0, bands)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(offsets, flat)],
                names=["id", "n_shingles", "key_a", "key_b", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches):
        for batch in slices(batches, "text"):
            text, h = shingles(Words(batch.column("text"), lower=True), size)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)) * 8
            data = pa.py_buffer(np.ascontiguousarray(h).tobytes())
            sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), data])
            yield pa.RecordBatch.from_arrays([batch.column("id"), sets.cast(pa.binary())], names=["id", "members"])

    return run


def _common(batches):
    """Sizes of the two sets of each pair and of what they share."""
    for batch in batches:
        sizes = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (a, b))
            short, long_ = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(long_, short)
            common = int((long_[np.minimum(at, len(long_) - 1)] == short).sum()) if len(long_) else 0
            sizes.append((len(x), len(y), common))
        table = np.array(sizes, dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [batch.column("src"), batch.column("dst"), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["src", "dst", "n1", "n2", "common"]
        )


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) with n1, n2 and common from their full shingle sets."""
    one = sets.select(F.col("id").alias("src"), F.col("members").alias("a"))
    two = sets.select(F.col("id").alias("dst"), F.col("members").alias("b"))
    return pairs.join(one, "src").join(two, "dst").mapInArrow(_common, "src long, dst long, n1 long, n2 long, common long")


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) whose full shingle sets are similar enough."""
    return compared.where(100 * F.col("common") >= percent * (F.col("n1") + F.col("n2") - F.col("common"))).select("src", "dst").distinct()


def _members(batches):
    """(id, hash) of every member of the sets."""
    for batch in batches:
        data, offsets = raw(batch.column("members"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        h = np.frombuffer(data.tobytes(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(offsets) // 8)), pa.array(h)], names=["id", "h"])


def _torn(placed: DataFrame) -> DataFrame:
    """Rows of the bands whose rows are in several groups."""
    torn = placed.groupBy("band").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 != g1").select("band")
    return placed.join(torn, "band", "left_semi")


def _close(percent: int, one: str, two: str):
    """Sets whose sizes differ too much can't be similar enough."""
    return 100 * F.least(one, two) >= percent * F.greatest(one, two)


def _merged(named: DataFrame, sets: DataFrame, tried: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(rows of the bands still torn, tables of pairs compared, tables of links) after some rounds of stars.

    While the rows of the torn bands have many partners in other groups, each
    band's rows are compared with one row drawn anew, and groups that are
    linked become one. A round makes at most one pair a row; as soon as it no
    longer merges much, the rest is left to the exact search.
    """
    made, found, before = [], [], None
    for turn in range(ROUNDS):
        held = named.groupBy("band", "group").agg(F.count("*").alias("m"))
        bands = held.groupBy("band").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
        now = bands.agg(F.sum("m").alias("rows"), (F.sum(F.col("m").cast("double") * F.col("m") - F.col("own")) / 2).alias("pairs")).first()
        if not now.rows or now.pairs <= PARTNERS * now.rows or (before is not None and now.pairs > 0.9 * before):
            break
        before = now.pairs
        drawn = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "n", "group")).alias("hub")
        met = named.join(named.groupBy("band").agg(drawn), "band").where((F.col("group") != F.col("hub.group")) & _close(percent, "n", "hub.n"))
        pairs = met.select(F.least("id", "hub.id").alias("src"), F.greatest("id", "hub.id").alias("dst")).distinct()
        pairs = cut_lineage(pairs.join(tried, ["src", "dst"], "left_anti"))
        links = cut_lineage(_linked(_compared(pairs, sets), percent))
        made, found, tried = [*made, pairs], [*found, links], tried.unionByName(pairs)
        of = named.select("id", "group").distinct()
        edges = links.join(of.select(F.col("id").alias("src"), F.col("group").alias("one")), "src")
        edges = edges.join(of.select(F.col("id").alias("dst"), F.col("group").alias("two")), "dst")
        joined = connected_components(edges.select(F.col("one").alias("src"), F.col("two").alias("dst")))
        named = named.join(joined.withColumnRenamed("node", "group"), "group", "left").withColumn("group", F.coalesce("component", "group"))
        named = cut_lineage(_torn(named.drop("component")))
    return named, made, found


def _across(named: DataFrame, sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst) of different groups that share a band and can be similar enough.

    A shingle held by at most ``RARE`` of these sets is rare. Two sets share
    their common rare shingles and at most as many others as the one with
    fewer others holds. So either the others alone are enough, which few pairs
    from different groups pass, or a rare shingle is shared, and pairs are
    found by it: at most ``RARE`` sets meet there.

    Sets of one band are also told apart by what they have and lack against
    the band's smallest id, with which ``stars`` compared them: if x differs
    from it in a shingles and y in b, and c of these are the same, x and y
    differ in a + b - 2 * c. Without a common rare shingle, c is at most what
    either has of such differences beside its rare shingles.
    """
    members = sets.mapInArrow(_members, "id long, h long")
    held = cut_lineage(members.groupBy("h").agg(F.count("*").alias("df"), F.min("id").alias("id")).where(F.col("df") <= RARE))
    few = cut_lineage(members.join(held.where("df > 1").select("h"), "h"))
    rare = held.where("df = 1").select("id").unionAll(few.select("id")).groupBy("id").agg(F.count("*").alias("rare"))
    # rows of one id can have several sets; what is counted by id says nothing about one of them
    sure = sets.groupBy("id").agg((F.count("*") == 1).alias("sure"))
    known = named.select("id", "n", "group").distinct().join(sure, "id").join(rare, "id", "left")
    known = known.withColumn("rare", F.when(F.col("sure"), F.coalesce("rare", F.lit(0))).otherwise(0))
    known = cut_lineage(known.withColumn("others", F.col("n") - F.col("rare")))
    left = known.select(F.col("id").alias("src"), F.col("n").alias("n1"), F.col("others").alias("o1"), F.col("group").alias("g1"))
    right = known.select(F.col("id").alias("dst"), F.col("n").alias("n2"), F.col("others").alias("o2"), F.col("group").alias("g2"))
    apart = (F.col("g1") != F.col("g2")) & _close(percent, "n1", "n2")
    # the intersection has to be percent / (100 + percent) of both sizes together
    needed = percent * (F.col("n1") + F.col("n2"))

    ids = few.groupBy("h").agg(F.collect_list("id").alias("ids"))  # RARE ids at most
    met = ids.select(F.explode("ids").alias("src"), "ids").select("src", F.explode(F.filter("ids", lambda i: i > F.col("src"))).alias("dst"))
    met = cut_lineage(met.groupBy("src", "dst").agg(F.count("*").alias("shared")))
    by_rare = met.join(left, "src").join(right, "dst").where(apart & ((100 + percent) * (F.col("shared") + F.least("o1", "o2")) >= needed))

    # sets whose other shingles can't be enough for any partner of their band are left out
    banded = named.select("band", "id", "low").join(known, "id")
    least = banded.groupBy("band").agg(F.min("n").alias("least"))
    partner = F.greatest("least", F.col("n") * percent / 100)
    banded = banded.join(least, "band").where((100 + percent) * F.col("others") >= percent * (F.col("n") + partner)).drop("least")

    # far: the differences, less as many as two sets of the size may have; same: those that a partner can share (twice, by percent)
    differ = stars.groupBy("src", "dst").agg(F.count("*").alias("times"), F.max(F.col("n1") + F.col("n2") - 2 * F.col("common")).alias("differ"))
    differ = differ.where("times = 1").select(F.col("src").alias("low"), F.col("dst").alias("id"), "differ")
    banded = banded.join(differ, ["low", "id"], "left").join(met.select(F.col("src").alias("low"), F.col("dst").alias("id"), "shared"), ["low", "id"], "left")
    differ = F.when(F.col("id") != F.col("low"), F.col("differ")).when(F.col("sure"), 0)
    own = F.when(F.col("id") != F.col("low"), F.col("rare") - F.coalesce("shared", F.lit(0))).otherwise(0)
    banded = banded.withColumns({"far": (100 + percent) * differ - (100 - percent) * F.col("n"), "same": 2 * (100 + percent) * (differ - own)})
    banded = cut_lineage(banded.select("band", "id", "n", "others", "group", "far", "same"))

    # sets too far from the nearest row of another group in the band are left out
    far = F.coalesce("far", F.lit(-(1 << 62)))  # unknown: no bound
    nearest = banded.groupBy("band").agg(F.min(F.struct(far.alias("far"), "group")).alias("first"))
    banded = banded.join(nearest, "band")
    second = banded.where(F.col("group") != F.col("first.group")).groupBy("band").agg(F.min(far).alias("second"))
    banded = banded.join(second, "band")
    partner = F.when(F.col("group") == F.col("first.group"), F.col("second")).otherwise(F.col("first.far"))
    banded = banded.where(F.coalesce(F.col("same") >= F.col("far") + partner, F.lit(True))).drop("first", "second")
    banded = cut_lineage(_torn(banded))

    def side(i: int, name: str) -> DataFrame:
        return banded.select("band", F.col("id").alias(name), *(F.col(c).alias(f"{k}{i}") for c, k in zip(("n", "others", "group", "far", "same"), "nogfs")))

    one, two = side(1, "src"), side(2, "dst")
    enough = (100 + percent) * F.least("o1", "o2") >= needed
    near = F.coalesce(F.least("s1", "s2") >= F.col("f1") + F.col("f2"), F.lit(True))
    by_band = one.join(two, (one.band == two.band) & (F.col("src") < F.col("dst")) & apart & enough & near)
    return by_rare.select("src", "dst").union(by_band.select("src", "dst")).distinct()


def near_duplicates(
    docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(id, n_shingles, component_id, kept): groups of documents linked by similarity.

    Texts are lower-cased (A-Z) and split at spaces and \\t..\\r; a document's
    set holds its distinct shingles of ``size`` words, or the whole sequence
    if it is shorter. Documents with 100 * intersection >= percent * union are
    linked; component_id is the smallest id that can be reached and ``kept``
    marks it. With 25 bands of 4 slots a pair at 80 % is missed with a
    probability of 2e-6, at 85 % of 1e-8.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Rows with a null id are left out, as nothing can be linked to them.
    Repeated ids keep one result row each; where their texts differ, a link of
    any of them counts. An empty table gives an empty result. Further columns
    are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    sketch = cut_lineage(texts.mapInArrow(_sketches(size, bands, rows), _SKETCH))
    filled = sketch.where("n_shingles > 0")
    key = ["n_shingles", "key_a", "key_b"]
    classes = filled.groupBy(*key).agg(F.min("id").alias("head"))
    member = cut_lineage(filled.select("id", *key).join(classes, key).select("id", "n_shingles", "head"))
    heads = filled.join(classes.withColumnRenamed("head", "id"), ["id", *key], "left_semi").dropDuplicates(["id", *key])
    placed = heads.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    lows = placed.groupBy("band").agg(F.min(F.struct("id", "n")).alias("low"), F.count("*").alias("m")).where("m > 1")
    met = cut_lineage(placed.join(lows.drop("m"), "band"))
    star = met.where("id != low.id").where(_close(percent, "n", "low.n")).select(F.col("low.id").alias("src"), F.col("id").alias("dst"))
    star = cut_lineage(star.distinct())

    candidates = met.select("id").distinct()
    sets = cut_lineage(texts.join(candidates, "id", "left_semi").mapInArrow(_sets(size), "id long, members binary").distinct())
    # rows of one id are one document, so their classes are linked
    ends = cut_lineage(member.groupBy("id").agg(F.min("head").alias("src"), F.max("head").alias("last")).where("src != last").select("id", "src"))
    same = ends.join(member, "id").where("src != head").select("src", F.col("head").alias("dst")).distinct()
    stars = cut_lineage(_compared(star, sets))
    links = cut_lineage(_linked(stars, percent).unionByName(same).distinct())
    groups = cut_lineage(connected_components(links))

    # classes that met in a band, but are not in one group yet, are compared across groups
    named = met.select("band", "id", "n", F.col("low.id").alias("low")).join(groups.withColumnRenamed("node", "id"), "id", "left")
    named = cut_lineage(_torn(named.select("band", "id", "n", "low", F.coalesce("component", "id").alias("group"))))
    sets = cut_lineage(sets.join(named.select("id").distinct(), "id", "left_semi"))
    named, made, found = _merged(named, sets, star, percent)
    if not named.isEmpty():
        across = _across(named, sets.join(named.select("id").distinct(), "id", "left_semi"), stars, percent)
        tried = star
        for pairs in made:
            tried = tried.unionByName(pairs)
        across = cut_lineage(across.join(tried, ["src", "dst"], "left_anti"))
        found.append(cut_lineage(_linked(_compared(across, sets), percent)))
    found = [more for more in found if not more.isEmpty()]
    if found:  # the groups are stars by now, so they settle in fewer rounds than their links
        edges = groups.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        for more in found:
            edges = edges.unionByName(more)
        groups = connected_components(edges)

    head = groups.select(F.col("node").alias("head"), "component")
    named = member.join(head, "head", "left").select("id", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    alone = sketch.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return named.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
