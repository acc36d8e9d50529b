import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusmill.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session


@pytest.fixture
def column(spark):
    """Evaluate a column function over Python values, in order."""
    from pyspark.sql import functions as F

    def run(fn, values, *more, kind="string"):
        rows = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)]
        n = len(rows[0]) - 1
        schema = "i long, " + ", ".join(f"c{k} {kind}" for k in range(n))
        df = spark.createDataFrame(rows, schema).repartition(2)
        out = df.select("i", fn(*[F.col(f"c{k}") for k in range(n)], *more).alias("o"))
        return [r["o"] for r in sorted(out.collect(), key=lambda r: r["i"])]

    return run
