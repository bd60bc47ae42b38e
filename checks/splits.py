"""Sampling, split and data set checks (SP-*, TB-10, TB-11, SRC-19..22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.tasks import TB01, TB04, with_text_hash
from checks.views import list_sql, ts_sql, with_views
from wardline.functions.times import plus_days
from wardline.operators import splits as S
from wardline.plans import prepare as P
from wardline.plans import tasks as T
from wardline.session import cut_lineage, scratch_path
from wardline.sources import tables as ST

ENC = with_views("encounter")
HASH = "md5('42|' || patient_id)"
RANKED = f"SELECT patient_id, row_number() OVER (ORDER BY {HASH}) AS rank, count(*) OVER () AS total FROM (SELECT DISTINCT patient_id FROM encounter)"


@check(
    "sp02_halve_patients",
    with_views("encounter", more={"r": RANKED})
    + "SELECT patient_id, CASE WHEN rank <= total // 2 THEN 'pretrain' ELSE 'downstream' END AS cohort FROM r",
)
def _(v):
    return S.halve_patients(v.encounter)


@check(
    "sp03_sample_n",
    with_views("encounter", more={"r": RANKED}) + "SELECT patient_id FROM r WHERE rank <= 100",
)
def _(v):
    return S.sample_n(S.distinct_ids(v.encounter), 100, ["patient_id"])


@check(
    "sp04_equal_slices",
    with_views("encounter", more={"r": RANKED})
    + "SELECT patient_id, least((rank - 1) // (total // 7), 6) AS slice FROM r",
)
def _(v):
    return S.equal_slices(S.distinct_ids(v.encounter), 7, ["patient_id"])


def split_sql(source: str, label: str, other: str = "test") -> dict[str, str]:
    return {
        "ids": f"SELECT DISTINCT patient_id FROM {source}",
        "forced": f"SELECT DISTINCT min({{'h': {HASH}, 'p': patient_id}}).p AS patient_id FROM {label} GROUP BY label",
        "rest": f"""SELECT patient_id, row_number() OVER (ORDER BY {HASH}) AS rank FROM ids
  WHERE patient_id NOT IN (SELECT patient_id FROM forced)""",
        "split": f"""SELECT patient_id, 'train' AS split FROM forced UNION ALL SELECT patient_id,
  CASE WHEN rank <= floor(0.8::DOUBLE * (SELECT count(*) FROM ids)) - (SELECT count(*) FROM forced) THEN 'train' ELSE '{other}' END FROM rest""",
    }


COND_LABELS = "SELECT DISTINCT patient_id, split_part(icd_code, '.', 1) AS label FROM condition"


@check(
    "sp05_label_covering_split",
    with_views("condition", more={"lab": COND_LABELS, **split_sql("condition", "lab")}) + "SELECT patient_id, split FROM split",
)
def _(v):
    stems = F.array(F.substring_index("icd_code", ".", 1))
    return S.label_covering_split(v.condition.select("patient_id", stems.alias("labels")))


@check(
    "sp06_stratified_group_split",
    with_views("condition", more={
        "lab": "SELECT patient_id, split_part(icd_code, '.', 1) AS label FROM condition",
        "freq": "SELECT label, count(*) AS n FROM lab GROUP BY 1",
        "strata": "SELECT patient_id, min({'n': n, 'label': label}).label AS stratum FROM lab JOIN freq USING (label) GROUP BY 1",
    })
    + f"SELECT patient_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY {HASH}) - 1 + ('0x' || substr(md5(stratum), 1, 6))::BIGINT) % 5 AS fold FROM strata",
)
def _(v):
    stems = F.array(F.substring_index("icd_code", ".", 1))
    return S.stratified_group_split(v.condition.select("patient_id", stems.alias("labels")))


def start_sql(of: str) -> str:
    return f"('0x' || substr(md5({of}), 1, 6))::BIGINT"


@check(
    "sp06_combo_group_split",
    with_views("condition", more={
        "lab": "SELECT DISTINCT patient_id, split_part(icd_code, '.', 1) AS label FROM condition",
        "holders": "SELECT label, count(*) AS h FROM lab GROUP BY 1",
        "people": """SELECT patient_id, '[' || string_agg('"' || label || '"', ',' ORDER BY label) || ']' AS stratum, min({'h': h, 'label': label}).label AS rarest
  FROM lab JOIN holders USING (label) GROUP BY 1""",
        "strata": "SELECT stratum, rarest, count(*) AS n FROM people GROUP BY ALL",
        "turns": """SELECT *, coalesce(sum(n % 5) OVER (PARTITION BY rarest ORDER BY n DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM strata""",
        "ranked": f"SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {HASH}) AS rank FROM people JOIN turns USING (stratum, rarest)",
    })
    + f"""SELECT patient_id, stratum, (CASE WHEN rank <= n - n % 5 THEN rank - 1 + {start_sql('stratum')}
  ELSE {start_sql('rarest')} + taken + rank - 1 - (n - n % 5) END % 5)::INT AS fold FROM ranked""",
)
def _(v):
    stems = F.array(F.substring_index("icd_code", ".", 1))
    return S.combo_group_split(v.condition.select("patient_id", stems.alias("labels")))


@check(
    "sp07_balance_1_1",
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id)) AS rank FROM labels)
  SELECT doc_id, quality, rank FROM r WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)
def _(v):
    return S.balance_1_1(v.raw("labels").select("doc_id", "quality"), ["doc_id"], "quality")


@check(
    "sp08_balance_weighted",
    """WITH m AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id)) AS rank FROM labels),
  c AS (SELECT count_if(toxic = 1) AS p, count_if(toxic = 0) AS n FROM labels),
  d AS (SELECT least(p / 0.9::DOUBLE, n / (1 - 0.9::DOUBLE)) AS draws FROM c)
  SELECT doc_id FROM m, d WHERE rank <= floor(CASE toxic WHEN 1 THEN draws * 0.9::DOUBLE ELSE draws * (1 - 0.9::DOUBLE) END + 1e-9)""",
)
def _(v):
    rows = v.raw("labels").selectExpr("doc_id", "case when toxic = 1 then array('t') else cast(array() as array<string>) end as labels")
    return S.balance_weighted(rows, ["doc_id"]).select("doc_id")


@check("sp09_first_n", ENC + f"SELECT encounter_id, {ts_sql('start')} AS start FROM encounter ORDER BY encounter.start, encounter_id LIMIT 50")
def _(v):
    return S.first_n(v.encounter.select("encounter_id", "start"), 50, ["start", "encounter_id"])


@check(
    "sp10_top_k_labels",
    with_views("imaging_study")
    + "SELECT modality_code AS label, count(*) AS n FROM imaging_study GROUP BY 1 ORDER BY n DESC, label LIMIT 5",
)
def _(v):
    return S.label_counts(v.imaging_study.select("patient_id", F.col("modality_code").alias("labels")), 5)


@check(
    "tb10_custom_task",
    TB04.replace('"end" AS cut, EXISTS', 'start + INTERVAL 3 DAY AS cut, EXISTS').replace("t.ts <= c.cut", "t.ts < c.cut")
    .replace('n.start > s."end" AND n.start <= s."end" + INTERVAL 30 DAY', 'n.start > s."end" AND n.start <= s."end" + INTERVAL 60 DAY')
    + f"SELECT patient_id, encounter_id, {ts_sql('cut')} AS sample_start, labels, md5(head || 'Notes:' || chr(10) || hist) AS text FROM told",
)
def _(v):
    from wardline.operators.labels import Readmission

    custom = T.Task(
        "my_task",
        cuts=lambda: F.array(plus_days(F.col("start"), 3)),
        text=lambda: F.concat(F.lit("Notes:\n"), F.col("history")),
        labels=Readmission(60),
        output=(
            ("patient_id", "patient_id"),
            ("encounter_id", "encounter_id"),
            ("cut", "sample_start"),
            ("text", "text"),
            ("labels", "labels"),
        ),
    )
    return with_text_hash(T.build_samples(v.tables, custom))


PREPARED = TB01.rstrip() + ",\n" + ",\n".join(
    f"{n} AS ({b})" for n, b in {"lab": "SELECT DISTINCT patient_id, unnest(labels) AS label FROM kept", **split_sql("kept", "lab")}.items()
) + "\n"


@check(
    "tb11_prepare",
    PREPARED
    + f"""SELECT patient_id, encounter_id, {ts_sql('cut')} AS sample_start, split, {list_sql('labels')} AS labels,
  md5(head || 'Duration: ' || duration || chr(10) || 'ICD Version: ' || icd || chr(10) || chr(10) || 'Patient journey:' || chr(10) || hist) AS text
  FROM kept JOIN split USING (patient_id)""",
)
def _(v):
    path = scratch_path(v.spark, "prepare")
    P.prepare(v.spark, lambda: T.build_samples(v.tables, T.ds_icd()), path, "ds_icd")
    schema = "patient_id string, encounter_id string, sample_start timestamp, text string, labels array<string>"
    parts = [ST.read_samples(v.spark, f"{path}/samples", s, schema).withColumn("split", F.lit(s)) for s in ("train", "test")]
    out = with_text_hash(parts[0].unionByName(parts[1]))
    return out


@check(
    "tb11_label_summary",
    PREPARED
    + """, s AS (SELECT split, unnest(labels) AS label FROM kept JOIN split USING (patient_id)),
  c AS (SELECT 'all' AS part, label, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT split, label, count(*) FROM s GROUP BY 1, 2)
  SELECT part, label, n FROM c QUALIFY row_number() OVER (PARTITION BY part ORDER BY n DESC, label) <= 20""",
)
def _(v):
    samples = cut_lineage(T.build_samples(v.tables, T.ds_icd()).select("patient_id", "labels"))
    return P.label_summary(P.split_samples(samples))


@check("src16_window_extract", ENC + f"SELECT encounter_id, {ts_sql('start')} AS start FROM encounter WHERE start BETWEEN TIMESTAMP '1996-05-01' AND TIMESTAMP '1996-08-01'")
def _(v):
    from wardline.operators.rows import window_extract

    lo, hi = (F.lit(t).cast("timestamp") for t in ("1996-05-01", "1996-08-01"))
    return window_extract(v.encounter, lo, hi, "start").select("encounter_id", "start")


@check(
    "src17_fetch_related",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
)
def _(v):
    from wardline.operators.rows import fetch_related

    ids = v.raw("lineitem").where("l_returnflag = 'R'").selectExpr("l_partkey as p_partkey")
    return fetch_related(v.raw("part"), ids, "p_partkey").select("p_partkey", "p_name")


@check("src19_store_load", ENC + f"SELECT encounter_id, patient_id, {ts_sql('start')} AS start FROM encounter")
def _(v):
    path = scratch_path(v.spark, "encounter")
    ST.store(v.encounter, path)
    return ST.load(v.spark, path).select("encounter_id", "patient_id", "start")


@check("src20_build_or_reuse", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(v):
    path = scratch_path(v.spark, "stage")
    orders = v.raw("orders")
    ST.build_or_reuse(v.spark, path, lambda: orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    # the second call finds the finished stage and leaves its builder alone
    return ST.build_or_reuse(v.spark, path, lambda: orders.where("false").groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@check(
    "src21_src22_samples_jsonl",
    with_views("condition", more={"lab": COND_LABELS, **split_sql("condition", "lab")})
    + """SELECT c.patient_id, condition_id, icd_code, split FROM (SELECT DISTINCT patient_id, condition_id, icd_code FROM condition) c
  JOIN split USING (patient_id)""",
)
def _(v):
    rows = v.condition.select("patient_id", "condition_id", "icd_code").distinct()
    labelled = v.condition.select("patient_id", F.array(F.substring_index("icd_code", ".", 1)).alias("labels"))
    path = scratch_path(v.spark, "samples")
    ST.write_samples(rows.join(S.label_covering_split(labelled), "patient_id"), path)
    schema = "patient_id string, condition_id string, icd_code string"
    train, test = (ST.read_samples(v.spark, path, s, schema).withColumn("split", F.lit(s)) for s in ("train", "test"))
    return train.unionByName(test)
