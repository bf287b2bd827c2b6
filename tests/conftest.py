import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from agora.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="agora-tests")
    yield s


@pytest.fixture
def one(spark):
    """Evaluate a Column expression on a one-row DataFrame built from kwargs."""
    def run(expr, **cols):
        import pandas as pd
        if cols:
            df = spark.createDataFrame(pd.DataFrame({k: [v] for k, v in cols.items()}))
        else:
            df = spark.range(1)
        return df.select(expr.alias("r")).first()["r"]
    return run
