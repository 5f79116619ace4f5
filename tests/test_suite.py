"""Registered queries against their check SQL on the smallest data set.

A cross-section runs by default; set MARQUEE_ALL=1 for every query. ``tools/check.py`` does the same with timings.
"""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import DATA
from tools.check import rows

FOLDER = f"{DATA}/sf0.001"
SAMPLE = """a01 a04 a10 a14 a18 a22 b05 b15 b23 c02_title_writer c04 d06 d08 d12 d15 e06 e08 e09_quantiles e14 e16 f01 f05 f06 g02 x03
h01 h03 h10 w01 w02 w04 w07 i02 i06 i09 i20 j02 j04 j05 j06 j14 j16 j18_drift k06 k08 l01 l03 l04 l06 l11 m02 m04 m05 m07 m09 m11 m14
n03 n06 n13 n18 n19 n21 n24 n25 n28 n35 n41_bayesian s01 s03 s07_held s08 s09""".split()

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
CHECKED = [n for n in ORACLES if os.environ.get("MARQUEE_ALL") or any(n.startswith(p) for p in SAMPLE)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_check(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
