"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from feederflow.oracle import ORACLE_SQL
from feederflow.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(None if x != x else x for x in r) for r in df.itertuples(index=False, name=None)), key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["lp_rows_commitment", "lp_rows_ties"])
def test_zeros_have_the_signs_of_the_twin(spark, duck, name):
    signs = lambda df: sorted(zip(df["id"], df["k"], df["t"], df["cfamily"], df["cid"], df["ck"], df["ct"], df["val"].map(str), strict=True))
    got, want = signs(QUERIES[name](spark, SF).toPandas()), signs(duck.execute(ORACLE_SQL[name]).df())
    assert got == want and any(r[-1] == "-0.0" for r in want)
