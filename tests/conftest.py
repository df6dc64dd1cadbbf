import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from studyloom.session import local_session

    return local_session(4, 4, "4g")


@pytest.fixture(scope="session")
def one_row(spark):
    """Evaluate columns on a single row."""

    def run(*columns, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], *[F.lit(0).alias("_zero")])
        return row.select(*columns).first()

    return run
