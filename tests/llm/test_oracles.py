import os

import duckdb
import pytest

from seekstone import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    own, other = llm.queries()[name](spark, SF).toPandas(), con.execute(llm.oracle_sql()[name]).fetchdf()
    cols = sorted(own.columns)
    assert cols == sorted(other.columns)
    rows = lambda f: sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in f[cols].astype(object).values.tolist())
    fix = lambda f: f.assign(**({"refers_to": f.refers_to.astype("Int64")} if "refers_to" in cols else {}))
    assert rows(fix(own).astype(object).where(fix(own).notna(), None)) == rows(fix(other).astype(object).where(fix(other).notna(), None))
