"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as E
from compare import compare
from kontor.plans import registry

from conftest import SF_SMALL

ORACLE = registry.oracle_sql()
NAMES = sorted(registry.queries())


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(NAMES)


_DUCK_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "string": "VARCHAR",
               "date": "DATE", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _duck_type(spark_type) -> str:
    s = spark_type.simpleString()
    return s.upper() if s.startswith("decimal") else _DUCK_NAMES.get(s, s)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF_SMALL)
    res = compare(df, duck, ORACLE[name])
    assert res["cols_match"], res
    assert res["match"], res
    rel = duck.sql(ORACLE[name])
    oracle_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {f.name: _duck_type(f.dataType) for f in df.schema.fields} == oracle_types


def test_entry_registers_every_ledger_query():
    assert set(NAMES) <= set(E.queries())
    assert set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["company_id", "account_code", "account_name", "category", "normal_balance",
                          "total_debit", "total_credit", "balance"]
