import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1").config("spark.sql.warehouse.dir", str(at / "warehouse")).config("spark.checkpoint.dir", str(at / "shared")).config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__

    __spark_entry__.ship(session)
    return session


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples of its columns in the order of their names."""

    def of(df):
        return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)

    return of
