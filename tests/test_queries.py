"""Every query of the library against its SQL twin, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from paperloom.plans.catalogue import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "None" if v != v else f"{float(v):.7g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.sql(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want and want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_finds_planted_passages(spark):
    """A passage's document is first by words; hashed vectors of long documents are noisy, so in the fused ranking it is among the twelve."""
    planted = {(16, 64), (33, 188), (39, 52)}
    by_words = {(r["query_id"], r["doc_id"]) for r in QUERIES["bm25_topk"](spark, SF).where("rank = 1").collect()}
    fused = {(r["query_id"], r["doc_id"]): r["rank"] for r in QUERIES[FLAGSHIP](spark, SF).collect()}
    assert planted <= by_words and planted <= set(fused)
    assert fused[16, 64] == fused[33, 188] == 1
