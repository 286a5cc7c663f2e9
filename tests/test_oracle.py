"""Every registered query outside llm against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from veraline.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def canon(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    told = frame.map(lambda v: "NULL" if pd.isna(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, float) else str(v))
    return sorted(map(tuple, told.values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine, other = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert canon(mine) == canon(other)
