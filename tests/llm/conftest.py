import os

import pytest

TINY = "/root/testdata/sf0.001"


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows as a table and reads it back, as the operators get their input."""

    def make(rows, schema="doc_id long, text string"):
        path = os.path.join(tmp_path, f"t{len(os.listdir(tmp_path))}")
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
