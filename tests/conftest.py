from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tessera import session

    s = session.build("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _sorted(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(([_plain(r[i]) for i in at] for r in rows), key=repr)


@pytest.fixture(scope="session")
def same():
    """Compares a query's rows with those of SQL over the same Parquet tables."""

    def check(df, sql: str, sf_dir: str):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(want.fetchall(), columns)

    return check
