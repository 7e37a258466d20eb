import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pagetide.plans import registry

SF = "/root/testdata/sf0.001"


def _norm(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else round(float(v), 4) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in row) for row in df.itertuples(index=False)), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_against_sql(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLE:
        con = duckdb.connect()
        for t in "documents pages events orders lineitem customer supplier benchmark conversations".split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and _norm(got) == _norm(want)
