import pytest
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows."""
    return lambda rows: spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """(DataFrame, rows) of the documents of the smallest table."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
