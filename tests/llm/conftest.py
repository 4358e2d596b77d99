import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType())])


@pytest.fixture
def docs(spark, tmp_path):
    """Write rows (doc_id, text[, lang]) as Parquet files and read them."""
    def make(rows, files=2, extra=None):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else None) for r in rows]
        df = spark.createDataFrame(rows, DOCS).repartition(files)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, value)
        path = str(tmp_path / f"docs{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)
    return make


def odd_rows():
    """Nulls, empty texts, ties, repeated rows, odd white space and a long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
    return [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, None), (3, ""), (4, " \n "),
            (None, "no id here at all"), (None, None), (5, long), (6, long), (6, "tab\there  and\n"),
            (7, "Ünï çødé — “x” 日本 語 end"), (8, "special <|endoftext|> inside"), (9, "a")]
