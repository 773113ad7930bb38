"""Every query with an SQL twin gives its rows."""

import pandas as pd
import pytest

from parchment import queries as registered


def rows(frame: pd.DataFrame) -> list[str]:
    plain = lambda x: None if pd.isna(x) else round(float(x), 9) if isinstance(x, float) else x
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_against_sql(spark, tables, small, name):
    ours = registered.queries()[name](spark, small).toPandas()
    theirs = tables.execute(registered.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert registered.queries().keys() == registered.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert entry.oracle_sql().keys() <= entry.queries().keys()
