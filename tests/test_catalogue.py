"""Every query of the catalogue against its SQL in DuckDB, and the driver's contract."""

from collections import Counter

import pytest

import __spark_entry__
from floorgraph import catalog

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, tables, name):
    df = catalog.queries()[name](spark, sf_dir)
    cursor = tables.execute(catalog.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    order, places = sorted(df.columns), [list(kinds).index(c) for c in sorted(kinds)]
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_names_agree():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_a_fit_takes_all_lines(spark, sf_dir, tables):
    fits = catalog.queries()["axis_fit_lines"](spark, sf_dir).collect()
    assert {r.k: r.n for r in fits} == dict(tables.execute("select l_returnflag, count(*) from lineitem group by 1").fetchall())
