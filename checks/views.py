"""Clinical tables derived from the driver's tables, for Spark and as SQL.

Both forms state the same arithmetic; the engine is then run on the Spark
form and the oracle on the SQL form.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import cut_lineage

LARGE = ("lineitem", "orders", "documents", "events")


class Views:
    """Lazy tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._share_items = False

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
        # a table that is one file with one row group would be read by a single task, however many parts the file is cut
        # into; a row group of documents holds far more text than the parts, so these are always dealt out
        if name not in LARGE:
            return df
        cores, parts = self.spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
        return df.repartition(max(cores, parts)) if name == "documents" or parts < cores else df

    @cached_property
    def encounter(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "cast(o_orderkey as string) as encounter_id",
            "cast(o_custkey as string) as patient_id",
            "o_orderstatus as status",
            "case o_orderstatus when 'O' then 'IMP' when 'F' then 'AMB' end as v3_act_code",
            "substr(o_orderpriority, 1, 1) as type_code",
            "o_orderpriority as type_display",
            "concat('Station ', o_custkey % 7) as fachabteilungsschluessel",
            "case when o_orderkey % 5 > 0 then concat('Anlass ', o_orderkey % 5) end as aufnahmeanlass_display",
            "o_orderdate + make_interval(0,0,0,0,int(o_orderkey % 24)) as start",
            "o_orderdate + make_interval(0,0,0,int(o_orderkey % 12),int(o_orderkey % 24) + 5) as end",
        )

    @cached_property
    def initial_patient(self) -> DataFrame:
        last = self.encounter.groupBy("patient_id").agg(F.max("end").alias("last_end"))
        base = self.raw("customer").selectExpr(
            "cast(c_custkey as string) as patient_id",
            "c_custkey",
            "date_add(date'1920-01-01', int((c_custkey * 37) % 20000)) as birth_date",
            "case c_custkey % 3 when 0 then 'male' when 1 then 'female' else 'other' end as sex",
            "case c_mktsegment when 'BUILDING' then 'PKV' when 'MACHINERY' then 'GKV' else c_mktsegment end as insurance_type",
            "case when c_custkey % 10 = 0 then array(cast(c_custkey + 1 as string)) else array() end as links",
        )
        return base.join(last, "patient_id", "left").select(
            "patient_id",
            "birth_date",
            "sex",
            "insurance_type",
            F.expr("case when c_custkey % 7 = 0 then last_end end").alias("deceased_date"),
            "links",
        )

    @cached_property
    def patient(self) -> DataFrame:
        from wardline.functions.codes import map_insurance

        return self.initial_patient.withColumn("insurance_type", map_insurance(F.col("insurance_type"))).drop("links")

    @cached_property
    def _items(self) -> DataFrame:
        """Lineitems with their order's patient and their part; stored for ``tables``, where five views read them."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        part = self.raw("part").select("p_partkey", "p_name", "p_brand", "p_type")
        columns = "l_orderkey l_linenumber l_partkey l_suppkey l_returnflag l_linestatus l_shipdate".split()
        items = self.raw("lineitem").select(*columns)
        joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(part, items.l_partkey == part.p_partkey)
        joined = joined.select(*columns, "o_custkey", "p_name", "p_brand", "p_type")
        return (cut_lineage(joined) if self._share_items else joined).withColumns(
            {
                "record_id": F.expr("concat(l_orderkey, '-', l_linenumber)"),
                "patient_id": F.col("o_custkey").cast("string"),
                "encounter_id": F.col("l_orderkey").cast("string"),
            }
        )

    @cached_property
    def condition(self) -> DataFrame:
        return self._items.where("l_returnflag = 'R'").selectExpr(
            "record_id as condition_id",
            "patient_id",
            "encounter_id",
            "l_shipdate + make_interval(0,0,0,0,int(l_partkey % 24)) as condition_date",
            "case when l_partkey % 40 = 7 then concat('GB', l_partkey % 100) when l_partkey % 40 = 9 then 'PATSTURZ'"
            " else concat(substr(p_type, 1, 1), '0', l_partkey % 10, '.', l_linenumber) end as icd_code",
            "case when l_partkey % 6 > 0 then p_name end as icd_display",
            "cast(2015 + l_suppkey % 7 as string) as icd_version",
            "case when l_linenumber <= 3 then 'HD' else 'ND' end as code_diagnosis_type",
        )

    @cached_property
    def procedure(self) -> DataFrame:
        return self._items.where("l_returnflag = 'A'").selectExpr(
            "record_id as procedure_id",
            "patient_id",
            "encounter_id",
            "concat('5-', l_partkey % 900) as code",
            "p_name as display",
            "case l_linenumber % 4 when 0 then 'completed' when 1 then 'in-progress' when 2 then 'preparation'"
            " else 'not-done' end as status",
            "l_shipdate + make_interval(0,0,0,0,int(l_suppkey % 24)) as start",
            "l_shipdate + make_interval(0,0,0,0,int(l_suppkey % 24) + 1) as end",
        )

    @cached_property
    def imaging_study(self) -> DataFrame:
        return self._items.where("l_returnflag = 'N'").selectExpr(
            "record_id as imaging_study_id",
            "patient_id",
            "encounter_id",
            "l_shipdate + make_interval(0,0,0,0,int(l_linenumber * 3)) as started",
            "p_name as description",
            "p_brand as procedure_code",
            "element_at(array('CR','CT','MR','US','XA','NM','OT','SR','KO'), int(l_partkey % 9) + 1) as modality_code",
        )

    @cached_property
    def observation(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "cast(event_id as string) as observation_id",
            "cast(user_id as string) as patient_id",
            "ts - make_interval(0,0,0,9125) as effectivedatetime",
            "event_type as code",
            "event_type as display",
            "value as value_quantity",
            "concat('k', get_json_object(props, '$.k')) as value_unit",
        )

    @cached_property
    def medication(self) -> DataFrame:
        return self._items.selectExpr(
            "cast(l_partkey as string) as medication_id",
            "p_name as medication",
            "patient_id",
            "encounter_id",
            "l_linestatus as status",
            "l_shipdate + make_interval(0,0,0,0,int(l_orderkey % 24)) as datetime",
        )

    @cached_property
    def service_request(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "cast(o_orderkey as string) as id",
            "cast(o_custkey as string) as patient_id",
            "case o_orderstatus when 'O' then 'active' when 'F' then 'completed' else 'revoked' end as status",
            "o_orderdate + make_interval(0,0,0,0,int(o_orderkey % 20)) as authored",
            "concat('Anforderung ', o_orderkey % 9) as code_display",
            "o_orderpriority as category_display",
        )

    @cached_property
    def biologically_derived_product(self) -> DataFrame:
        return self._items.selectExpr(
            "record_id as bdp_id",
            "encounter_id as service_request_id",
            "patient_id",
            "l_shipdate + make_interval(0,0,0,0,int(l_linenumber)) as ausgabe_datetime",
            "case when l_linestatus = 'F' then 'AUSGABE' else 'RUECKNAHME' end as ausgabe_type",
            "p_brand as code",
            "p_name as display",
            "concat('Ward ', l_suppkey % 5) as output_to_einskurz",
        )

    @cached_property
    def episode_of_care(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "cast(c_custkey as string) as id",
            "cast(c_custkey as string) as patient_id",
            "timestamp'1996-01-01 00:00:00' + make_interval(0,0,0,int(c_custkey % 1500)) as start",
            "case when c_custkey % 4 = 0 then 'DKG' end as cert",
            "c_custkey % 2 = 0 as primary_case",
            "cast(1996 + c_custkey % 5 as string) as primary_year",
            "case when c_custkey % 3 > 0 then concat(1990 + c_custkey % 8, '-05-01') end as first_diagnosis_date",
            "case c_custkey % 4 when 0 then 'Magen-Darm Tumoren' when 1 then 'Hauttumoren' when 2 then 'Augentumoren' end"
            " as treatment_program",
        )

    @cached_property
    def diagnostic_report(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "cast(doc_id as string) as diagnostic_report_id",
            "cast(doc_id div 2 as string) as patient_id",
            "cast(doc_id as string) as encounter_id",
            "timestamp'1997-01-01 00:00:00' + make_interval(0,0,0,int(doc_id % 1400),int(doc_id % 23)) as date",
            "source as category_display",
            "lang as title",
            "text",
        )

    @cached_property
    def prediction(self) -> DataFrame:
        """One prediction per labelled document: truth and scores from fixed integer arithmetic."""
        return self.raw("labels").selectExpr(
            "doc_id",
            "quality as truth",
            "toxic",
            "((doc_id * 7919) % 101) / 100.0D as score",
            "int(((doc_id * 7919) % 101) > 50) as predicted",
        )

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        names = (
            "encounter patient condition procedure imaging_study observation medication service_request "
            "biologically_derived_product episode_of_care diagnostic_report"
        ).split()
        self._share_items = True
        return {n: getattr(self, n) for n in names}


# SQL form of the same views; each names the views it reads.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "encounter": (
        (),
        """SELECT o_orderkey::VARCHAR AS encounter_id, o_custkey::VARCHAR AS patient_id, o_orderstatus AS status,
  CASE o_orderstatus WHEN 'O' THEN 'IMP' WHEN 'F' THEN 'AMB' END AS v3_act_code,
  substr(o_orderpriority, 1, 1) AS type_code, o_orderpriority AS type_display,
  'Station ' || (o_custkey % 7) AS fachabteilungsschluessel,
  CASE WHEN o_orderkey % 5 > 0 THEN 'Anlass ' || (o_orderkey % 5) END AS aufnahmeanlass_display,
  o_orderdate + to_hours(o_orderkey % 24) AS start,
  o_orderdate + to_hours((o_orderkey % 12) * 24 + o_orderkey % 24 + 5) AS "end" FROM orders""",
    ),
    "initial_patient": (
        ("encounter",),
        """SELECT c_custkey::VARCHAR AS patient_id, DATE '1920-01-01' + ((c_custkey * 37) % 20000)::INTEGER AS birth_date,
  CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS sex,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'PKV' WHEN 'MACHINERY' THEN 'GKV' ELSE c_mktsegment END AS insurance_type,
  CASE WHEN c_custkey % 7 = 0 THEN last_end END AS deceased_date,
  CASE WHEN c_custkey % 10 = 0 THEN [(c_custkey + 1)::VARCHAR] ELSE []::VARCHAR[] END AS links
  FROM customer LEFT JOIN (SELECT patient_id, max("end") AS last_end FROM encounter GROUP BY 1) l
  ON l.patient_id = c_custkey::VARCHAR""",
    ),
    "patient": (
        ("initial_patient",),
        """SELECT patient_id, birth_date, sex, CASE insurance_type WHEN 'PKV' THEN 'privat' WHEN 'GKV' THEN 'gesetzlich'
  ELSE 'unbekannt' END AS insurance_type, deceased_date FROM initial_patient""",
    ),
    "items": (
        (),
        """SELECT l.*, p.p_name, p.p_brand, p.p_type, l_orderkey || '-' || l_linenumber AS record_id,
  o_custkey::VARCHAR AS patient_id, l_orderkey::VARCHAR AS encounter_id
  FROM lineitem l JOIN orders ON o_orderkey = l_orderkey JOIN part p ON p_partkey = l_partkey""",
    ),
    "condition": (
        ("items",),
        """SELECT record_id AS condition_id, patient_id, encounter_id,
  l_shipdate + to_hours(l_partkey % 24) AS condition_date,
  CASE WHEN l_partkey % 40 = 7 THEN 'GB' || (l_partkey % 100) WHEN l_partkey % 40 = 9 THEN 'PATSTURZ'
    ELSE substr(p_type, 1, 1) || '0' || (l_partkey % 10) || '.' || l_linenumber END AS icd_code,
  CASE WHEN l_partkey % 6 > 0 THEN p_name END AS icd_display, (2015 + l_suppkey % 7)::VARCHAR AS icd_version,
  CASE WHEN l_linenumber <= 3 THEN 'HD' ELSE 'ND' END AS code_diagnosis_type
  FROM items WHERE l_returnflag = 'R'""",
    ),
    "procedure_t": (
        ("items",),
        """SELECT record_id AS procedure_id, patient_id, encounter_id, '5-' || (l_partkey % 900) AS code, p_name AS display,
  CASE l_linenumber % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'in-progress' WHEN 2 THEN 'preparation' ELSE 'not-done' END AS status,
  l_shipdate + to_hours(l_suppkey % 24) AS start, l_shipdate + to_hours(l_suppkey % 24 + 1) AS "end"
  FROM items WHERE l_returnflag = 'A'""",
    ),
    "imaging_study": (
        ("items",),
        """SELECT record_id AS imaging_study_id, patient_id, encounter_id, l_shipdate + to_hours(l_linenumber * 3) AS started,
  p_name AS description, p_brand AS procedure_code,
  ['CR','CT','MR','US','XA','NM','OT','SR','KO'][l_partkey % 9 + 1] AS modality_code
  FROM items WHERE l_returnflag = 'N'""",
    ),
    "observation": (
        (),
        """SELECT event_id::VARCHAR AS observation_id, user_id::VARCHAR AS patient_id, ts - to_days(9125) AS effectivedatetime,
  event_type AS code, event_type AS display, value AS value_quantity, 'k' || json_extract_string(props, '$.k') AS value_unit
  FROM events""",
    ),
    "medication": (
        ("items",),
        """SELECT l_partkey::VARCHAR AS medication_id, p_name AS medication, patient_id, encounter_id, l_linestatus AS status,
  l_shipdate + to_hours(l_orderkey % 24) AS datetime FROM items""",
    ),
    "service_request": (
        (),
        """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS patient_id,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'revoked' END AS status,
  o_orderdate + to_hours(o_orderkey % 20) AS authored, 'Anforderung ' || (o_orderkey % 9) AS code_display,
  o_orderpriority AS category_display FROM orders""",
    ),
    "bdp": (
        ("items",),
        """SELECT record_id AS bdp_id, encounter_id AS service_request_id, patient_id,
  l_shipdate + to_hours(l_linenumber) AS ausgabe_datetime,
  CASE WHEN l_linestatus = 'F' THEN 'AUSGABE' ELSE 'RUECKNAHME' END AS ausgabe_type, p_brand AS code, p_name AS display,
  'Ward ' || (l_suppkey % 5) AS output_to_einskurz FROM items""",
    ),
    "episode_of_care": (
        (),
        """SELECT c_custkey::VARCHAR AS id, c_custkey::VARCHAR AS patient_id,
  TIMESTAMP '1996-01-01 00:00:00' + to_days((c_custkey % 1500)::INTEGER) AS start,
  CASE WHEN c_custkey % 4 = 0 THEN 'DKG' END AS cert, c_custkey % 2 = 0 AS primary_case,
  (1996 + c_custkey % 5)::VARCHAR AS primary_year,
  CASE WHEN c_custkey % 3 > 0 THEN (1990 + c_custkey % 8) || '-05-01' END AS first_diagnosis_date,
  CASE c_custkey % 4 WHEN 0 THEN 'Magen-Darm Tumoren' WHEN 1 THEN 'Hauttumoren' WHEN 2 THEN 'Augentumoren' END
    AS treatment_program FROM customer""",
    ),
    "diagnostic_report": (
        (),
        """SELECT doc_id::VARCHAR AS diagnostic_report_id, (doc_id // 2)::VARCHAR AS patient_id, doc_id::VARCHAR AS encounter_id,
  TIMESTAMP '1997-01-01 00:00:00' + to_hours((doc_id % 1400) * 24 + doc_id % 23) AS date,
  source AS category_display, lang AS title, text FROM documents""",
    ),
    "prediction": (
        (),
        """SELECT doc_id, quality AS truth, toxic, ((doc_id * 7919) % 101) / 100.0 AS score,
  (((doc_id * 7919) % 101) > 50)::INTEGER AS predicted FROM labels""",
    ),
}


def with_views(*names: str, more: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named views, what they read, and further CTEs."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, body = SQL_VIEWS[name]
        for need in needs:
            add(need)
        done.setdefault(name, body)

    for name in names:
        add(name)
    done.update(more or {})
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in done.items()) + "\n"


def plain(df: DataFrame) -> DataFrame:
    """Values in a form both engines print alike: times as text, lists joined."""
    out = []
    for f in df.schema:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind == "array":
            col = F.array_join(F.transform(col, lambda x: x.cast("string")), ",", "NULL")
        elif kind in ("double", "float"):
            col = F.round(col.cast("double"), 6)
        out.append(col.alias(f.name))
    return df.select(*out)


def ts_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def list_sql(expr: str) -> str:
    return f"array_to_string({expr}, ',')"
