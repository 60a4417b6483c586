import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of(rows): documents of (doc_id, text, ...), short rows filled up with nulls; extra columns with clashing names."""

    def make(rows, extra=()):
        df = spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCS)
        for name in extra:
            df = df.withColumn(name, df.doc_id.cast("string"))
        return df

    return make
