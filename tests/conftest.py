import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# Python workers import the stand-in services defined in the tests.
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])

from loomgraph.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("loomgraph-tests", cores=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Value of a Column expression over a single value."""
    from pyspark.sql import functions as F

    def run(fn, value, ddl="string"):
        df = spark.createDataFrame([(value,)], f"v {ddl}")
        return df.select(fn(F.col("v")).alias("r")).first()["r"]

    return run


def rows(df, *cols):
    """Sorted tuples of the given (or all) columns."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple(str(x) for x in t))
