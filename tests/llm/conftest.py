import duckdb
import pytest
from pyspark.sql import types as T

from postlens.llm.common import read

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows."""
    def make(*rows):
        full = [(*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return read(spark, SF, "documents").cache()


@pytest.fixture(scope="session")
def texts(sf_docs):
    return {r["doc_id"]: r["text"] for r in sf_docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c
