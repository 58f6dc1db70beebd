import pytest


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame([(i, t, None, "key", -1)[: len(schema.split(","))] for i, t in rows], schema)

    return make
