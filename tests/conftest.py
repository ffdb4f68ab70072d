import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from knownwhen.session import local_session

    return local_session(8, partitions=4)


@pytest.fixture()
def frame(spark):
    """``frame(rows, schema)`` with ISO text accepted for timestamp columns."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def build(rows, schema):
        target = T._parse_datatype_string(schema)
        text = T.StructType([T.StructField(f.name, T.StringType() if "timestamp" in f.dataType.simpleString() or "date" == f.dataType.simpleString() else f.dataType)
                             for f in target])
        df = spark.createDataFrame(rows, text)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])

    return build
