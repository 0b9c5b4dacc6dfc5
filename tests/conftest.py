import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from docketry.session import local_session

    session = local_session(8, 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name."""
    import numbers

    import pandas as pd

    def show(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        return repr(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, bool) and str(v) not in ("True", "False") else str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(show(v) for v in row) for row in frame[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(spark_df, duck_rel):
        (a_cols, a), (b_cols, b) = plain(spark_df.toPandas()), plain(duck_rel.df())
        assert a_cols == b_cols
        assert a == b

    return check
