"""Text, near-duplicate and document checks (TX-*, TB-08, TB-09, AG-14)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.registry import check
from checks.splits import split_sql
from checks.tasks import NL, TB07
from checks.views import ts_sql, with_views
from wardline.functions import texts as X
from wardline.functions.times import time_text
from wardline.operators import neardup as N
from wardline.operators import risk as K
from wardline.operators.components import connected_components
from wardline.plans import documents as P
from wardline.plans import prepare, tasks

# Words with their character positions, then one row per chunk.
WORDS = """SELECT doc_id, k, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS stop
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\s*\\S+')) AS p, generate_subscripts(regexp_extract_all(text, '\\s*\\S+'), 1) AS k FROM documents)"""
CHUNKS = """SELECT d.doc_id, (a.stop - length(ltrim(a.p, ' ' || chr(9) || chr(10) || chr(13) || chr(12))))::BIGINT AS start_index, b.stop::BIGINT AS end_index
  FROM (SELECT doc_id, n, unnest(range(0, ceil(n / 50)::BIGINT)) AS i FROM (SELECT doc_id, max(k) AS n FROM words GROUP BY 1)) d
  JOIN words a ON a.doc_id = d.doc_id AND a.k = greatest(50 * i - 10, 0) + 1
  JOIN words b ON b.doc_id = d.doc_id AND b.k = least(50 * (i + 1) + 10, n)"""
CHUNK_SQL = {"words": WORDS, "chunks": CHUNKS}


def ctes(more):
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in more.items()) + "\n"


@check(
    "tx01_chunk_text",
    ctes(CHUNK_SQL)
    + "SELECT doc_id, start_index, end_index, md5(substr(text, start_index + 1, end_index - start_index)) AS text FROM chunks JOIN documents USING (doc_id)",
)
def _(v):
    return N.split_documents(v.raw("documents").select("doc_id", "text")).withColumn("text", F.md5("text"))


RUNS = """SELECT doc_id, k, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS stop, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\S*\\s+')) AS p, generate_subscripts(regexp_extract_all(text, '\\S*\\s+'), 1) AS k FROM documents)"""
COMPAT = """SELECT d.doc_id, (a.stop - length(a.p) + length(rtrim(a.p, ' ' || chr(9) || chr(10) || chr(13) || chr(12))))::BIGINT AS start_index, b.stop::BIGINT AS end_index
  FROM (SELECT doc_id, n, unnest(range(0, ceil(n / 50)::BIGINT)) AS i FROM (SELECT DISTINCT doc_id, n FROM words)) d
  JOIN words a ON a.doc_id = d.doc_id AND a.k = greatest(50 * i - 10, 0) + 1
  JOIN words b ON b.doc_id = d.doc_id AND b.k = least(50 * (i + 1) + 10, d.n - 1) + 1"""


@check(
    "tx01_chunk_text_compat",
    ctes({"words": RUNS, "chunks": COMPAT})
    + """SELECT doc_id, start_index, end_index, md5(trim(substr(text, start_index + 1, end_index - start_index), ' ' || chr(9) || chr(10) || chr(13) || chr(12))) AS text
  FROM chunks JOIN documents USING (doc_id)""",
)
def _(v):
    return N.split_documents(v.raw("documents").select("doc_id", "text"), compat=True).withColumn("text", F.md5("text"))


TOKENS = "SELECT doc_id, text, string_split_regex(text, '[^A-Za-z_0-9]') AS t FROM documents"
GRAMS = """SELECT doc_id, list_distinct(list_transform(range(1, len(t) - 11), lambda i: array_to_string(t[i:i+12], ' '))) AS g
  FROM tokens WHERE len(t) >= 13"""


@check(
    "tx02_word_ngrams",
    ctes({"tokens": TOKENS, "grams": GRAMS})
    + """SELECT doc_id, coalesce(len(g), 0) AS n, md5(array_to_string(list_sort(coalesce(g, []::VARCHAR[])), '|')) AS grams
  FROM tokens LEFT JOIN grams USING (doc_id)""",
)
def _(v):
    grams = X.word_ngrams(F.col("text"))
    rows = v.raw("documents").select("doc_id", grams.alias("g"))
    return rows.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("grams"))


def perm_sql() -> str:
    """Multiplier and offset of each permutation as 32-bit halves."""
    a, b = N.permutations()
    rows = ", ".join(
        f"({i}, {x >> 32}::UBIGINT, {x & N.MASK}::UBIGINT, {y >> 32}::UBIGINT, {y & N.MASK}::UBIGINT)"
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist()))
    )
    return f"SELECT * FROM (VALUES {rows}) AS p(i, ah, al, bh, bl)"


# (h * a + b) modulo 2^64 in 32-bit halves, as DuckDB raises on overflow.
MINHASH = {
    "tokens": TOKENS,
    # a text too short for an n-gram is one
    "grams": GRAMS.replace("WHERE len(t) >= 13", "WHERE len(t) >= 13 UNION ALL SELECT doc_id, [array_to_string(t, ' ')] FROM tokens WHERE len(t) < 13"),
    "hashes": """SELECT doc_id, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::UBIGINT AS h
  FROM (SELECT doc_id, sha1(g) AS h FROM (SELECT doc_id, unnest(g) AS g FROM grams))""",
    "perms": perm_sql(),
    "products": """SELECT doc_id, i, bh, ((h * ah + ((h * al) >> 32)) & 4294967295::UBIGINT) AS hi,
  ((h * al) & 4294967295::UBIGINT) + bl AS lo FROM hashes, perms""",
    "signs": """SELECT doc_id, i, min((((((hi + bh + (lo >> 32)) & 4294967295::UBIGINT) * 4294967296::UBIGINT + (lo & 4294967295::UBIGINT))
  % 2305843009213693951::UBIGINT) & 4294967295::UBIGINT)::BIGINT) AS v FROM products GROUP BY 1, 2""",
    "bands": """SELECT doc_id, i // 16 AS band, md5(string_agg(v::VARCHAR, ',' ORDER BY i)) AS key FROM signs GROUP BY 1, 2""",
    "firsts": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "buckets": "SELECT *, min(doc_id) OVER (PARTITION BY band, key) AS low FROM bands WHERE doc_id IN (SELECT doc_id FROM firsts)",
    "edges": "SELECT DISTINCT doc_id AS src, low AS dst FROM buckets WHERE doc_id <> low",
}


@check(
    "tx03_minhash",
    ctes({k: MINHASH[k] for k in ("tokens", "grams", "hashes", "perms", "products", "signs")})
    + "SELECT doc_id, md5(string_agg(v::VARCHAR, ',' ORDER BY i)) AS sign FROM signs GROUP BY 1",
)
def _(v):
    signs, sign = N.signed(v.raw("documents").select("doc_id", "text")), F.col("sign")
    return signs.select("doc_id", F.md5(F.array_join(F.transform(sign, lambda x: x.cast("string")), ",")).alias("sign"))


@check("tx05_band_candidates", ctes(MINHASH) + "SELECT src, dst FROM edges")
def _(v):
    return N.band_candidates(N.banded_texts(v.raw("documents"), "doc_id"))


REACH = {
    **MINHASH,
    "both_ways": "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges",
    "reach": """SELECT src AS node, src AS seen FROM both_ways UNION SELECT r.node, e.dst FROM reach r JOIN both_ways e ON e.src = r.seen""",
    "parts": "SELECT node, min(seen) AS component FROM reach GROUP BY 1",
}


def recursive(more):
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({b})" for n, b in more.items()) + "\n"


@check("tx06_connected_components", recursive(REACH) + "SELECT node, component FROM parts")
def _(v):
    return connected_components(N.band_candidates(N.banded_texts(v.raw("documents"), "doc_id")))


@check(
    "tx04_near_dedup",
    recursive(REACH) + "SELECT doc_id FROM firsts WHERE doc_id NOT IN (SELECT node FROM parts WHERE node <> component)",
)
def _(v):
    return N.near_dedup(v.raw("documents"), "doc_id").select("doc_id")


# A threshold of 0.5 gives 25 bands of 5 rows, which leave three permutations out.
LOOSE = {**REACH, "bands": REACH["bands"].replace("i // 16", "i // 5").replace("FROM signs", "FROM signs WHERE i < 125")}


@check(
    "tx04_near_dedup_threshold",
    recursive(LOOSE) + "SELECT doc_id FROM firsts WHERE doc_id NOT IN (SELECT node FROM parts WHERE node <> component)",
)
def _(v):
    return N.near_dedup(v.raw("documents"), "doc_id", threshold=0.5).select("doc_id")


@check(
    "tx07_keep_representative",
    "SELECT doc_id AS id FROM documents QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY md5(text))",
)
def _(v):
    docs = v.raw("documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("key"), F.lit(0).alias("band"))
    return N.keep_representative(connected_components(N.band_candidates(docs)))


@check(
    "ag14_dedup_stats",
    recursive(REACH)
    + """, kept AS (SELECT doc_id FROM firsts WHERE doc_id NOT IN (SELECT node FROM parts WHERE node <> component))
  SELECT before, after, before - after AS duplicates, round((before - after) / before, 6) AS share
  FROM (SELECT (SELECT count(*) FROM documents) AS before, (SELECT count(*) FROM kept) AS after)""",
)
def _(v):
    docs = v.raw("documents").select("doc_id", "text")
    return N.dedup_stats(docs, N.near_dedup(docs, "doc_id"))


SAMPLE = "'Patient metadata:' || chr(10) || 'patient_id' || chr(9) || patient_id || chr(10) || 'age' || chr(9) || '40' || chr(10) || chr(10) || 'Encounter:' || chr(10) || 'id' || chr(9) || encounter_id || chr(10) || 'Beginn' || chr(9) || strftime(start, '%Y-%m-%d %H:%M:%S') || '+00:00'"


def _sample_text():
    return F.concat(
        F.lit("Patient metadata:\n"),
        X.kv_text([("patient_id", F.col("patient_id")), ("age", F.lit(40))]),
        F.lit("\n\nEncounter:\n"),
        X.kv_text([("id", F.col("encounter_id")), ("Beginn", time_text(F.col("start")))]),
    )


@check(
    "tx08_parse_metadata",
    with_views("encounter")
    + "SELECT patient_id, encounter_id, strftime(start, '%Y-%m-%d %H:%M:%S') || '+00:00' AS sample_start, NULL::VARCHAR AS absent FROM encounter",
)
def _(v):
    text = _sample_text()
    return v.encounter.select(
        X.metadata_field(text, "patient_id").alias("patient_id"),
        X.metadata_field(text, "id").alias("encounter_id"),
        X.metadata_field(text, "Beginn").alias("sample_start"),
        X.metadata_field(text, "absent").alias("absent"),
    )


@check(
    "tx09_history_references",
    with_views("encounter", more={
        "l": """SELECT encounter_id, patient_id, unnest([strftime(start - INTERVAL 1 DAY, '%Y-%m-%d'), strftime(start + INTERVAL 3 DAY, '%Y-%m-%d'), '1990-01-01']) AS dated,
  unnest([type_display, 'too late', 'a: b']) AS value FROM encounter"""
    })
    + """SELECT encounter_id, 'Condition/' || sha256(patient_id || ':' || dated || ':' || value) AS reference, value || ' on ' || dated AS display
  FROM l WHERE value <> 'too late'""",
)
def _(v):
    def day(n):
        return F.date_format(F.date_add(F.to_date("start"), n), "yyyy-MM-dd")

    text = F.concat(
        F.lit("Patient metadata:\nage\t40: x\n\nPatient history:\n"),
        day(-1), F.lit(": "), F.col("type_display"), F.lit("\n"), day(3), F.lit(": too late\n1990-01-01: a: b\nno value\n1991-01-01:"),
    )
    refs = K.history_references(text, F.col("patient_id"), time_text(F.col("start")), "Condition")
    rows = v.encounter.select("encounter_id", F.explode(refs).alias("r"))
    return rows.select("encounter_id", "r.reference", "r.display")


REPORT_SPLIT = {
    **CHUNK_SQL,
    **split_sql("reports", "(SELECT NULL AS label, patient_id FROM reports WHERE false)", "validation"),
}


@check(
    "tb08_split_and_chunk",
    ctes({"reports": "SELECT (doc_id // 2)::VARCHAR AS patient_id, doc_id FROM documents", **REPORT_SPLIT})
    + """SELECT c.doc_id::VARCHAR AS diagnostic_report_id, patient_id, split, source AS category_display, start_index, end_index,
  md5(substr(text, start_index + 1, end_index - start_index)) AS text FROM chunks c JOIN documents d USING (doc_id) JOIN reports r USING (doc_id) JOIN split USING (patient_id)""",
)
def _(v):
    out = P.split_reports(P.report_chunks(v.diagnostic_report)).drop("encounter_id")
    return out.withColumn("text", F.md5("text"))


# Chunks of both splits; of the train part those stay that are the first of their cluster.
PRETRAIN = {
    "reports": "SELECT (doc_id // 2)::VARCHAR AS patient_id, doc_id FROM documents",
    **REPORT_SPLIT,
    "pieces": """SELECT doc_id || '#' || lpad(start_index::VARCHAR, 12, '0') AS chunk_id, c.doc_id::VARCHAR AS diagnostic_report_id, patient_id, split, source AS category_display,
  start_index, end_index, substr(text, start_index + 1, end_index - start_index) AS text FROM chunks c JOIN documents d USING (doc_id) JOIN reports r USING (doc_id) JOIN split USING (patient_id)""",
    "train": "SELECT * FROM pieces WHERE split = 'train'",
    **{k: q.replace("documents", "train").replace("doc_id", "chunk_id") for k, q in REACH.items()},
    "corpus": """SELECT * FROM pieces WHERE split <> 'train' OR (chunk_id IN (SELECT chunk_id FROM firsts)
  AND chunk_id NOT IN (SELECT node FROM parts WHERE node <> component))""",
}


@check("tb08_pretrain_documents", recursive(PRETRAIN) + "SELECT * REPLACE (md5(text) AS text) FROM corpus")
def _(v):
    return P.pretrain_documents(v.diagnostic_report).drop("encounter_id").withColumn("text", F.md5("text"))


# The split of the samples, under names of its own.
SAMPLE_SPLIT = {
    f"s_{k}": re.sub(r"\b(ids|forced|rest)\b", r"s_\1", q)
    for k, q in split_sql("told", "(SELECT NULL AS label, patient_id FROM told WHERE false)", "validation").items()
}


@check(
    "tb09_pretrain_corpus",
    TB07.rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    + ",\n" + ",\n".join(f"{n} AS ({b})" for n, b in {**PRETRAIN, **SAMPLE_SPLIT}.items())
    + f"""
SELECT corpus, split, md5(text) AS text, count(*) AS n FROM (
  SELECT 'records' AS corpus, s_split.split, head || 'Duration: ' || duration || {NL} || {NL} || coalesce(tumor, '') || 'ICD Version: ' || icd || {NL} || {NL}
  || 'Patient journey in stay:' || {NL} || hist AS text FROM told LEFT JOIN tumor USING (patient_id) JOIN s_split USING (patient_id)
  UNION ALL SELECT 'documents', split, text FROM corpus) GROUP BY 1, 2, 3""",
)
def _(v):
    samples = prepare.split_samples(tasks.build_samples(v.tables, tasks.pretrain_fhir()), other="validation")
    corpus = P.pretrain_corpus(samples, P.pretrain_documents(v.diagnostic_report))
    return corpus.groupBy("corpus", "split", F.md5("text").alias("text")).agg(F.count("*").alias("n"))


@check(
    "so03_concat_corpora",
    TB07.rstrip()
    + ",\n" + ",\n".join(f"{n} AS ({b})" for n, b in CHUNK_SQL.items())
    + f"""
SELECT corpus, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (
  SELECT 'records' AS corpus, head || 'Duration: ' || duration || {NL} || {NL} || coalesce(tumor, '') || 'ICD Version: ' || icd || {NL} || {NL}
  || 'Patient journey in stay:' || {NL} || hist AS text FROM told LEFT JOIN tumor USING (patient_id)
  UNION ALL SELECT 'documents', substr(text, start_index + 1, end_index - start_index) FROM chunks JOIN documents USING (doc_id)) GROUP BY 1""",
)
def _(v):
    samples = tasks.build_samples(v.tables, tasks.pretrain_fhir()).withColumn("split", F.lit("train"))
    corpus = P.pretrain_corpus(samples, P.report_chunks(v.diagnostic_report).withColumn("split", F.lit("train")))
    return corpus.groupBy("corpus").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
