"""Every registered query against its DuckDB oracle (the driver's check)."""

import pytest

from tern.plans.registry import oracle_sql, queries
from tern.plans.verify import compare

from .conftest import SF_SMALL

KEYS = sorted(queries())


def test_every_query_has_an_oracle():
    missing = [k for k in KEYS if k not in oracle_sql()]
    assert missing == []


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    res = compare(spark, SF_SMALL, [key], verbose=False)[key]
    assert res.get("ok"), res


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "sum_qty" in df.columns


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
          "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("key", KEYS)
def test_query_types_match_oracle(spark, key):
    """Column types agree with DuckDB's (the driver also compares schemas)."""
    from tern.plans.verify import duck_connection

    sdf = queries()[key](spark, SF_SMALL)
    con = duck_connection(SF_SMALL)
    duck = {r[0]: r[1].replace(" ", "") for r in con.execute(f"DESCRIBE {oracle_sql()[key]}").fetchall()}
    for f in sdf.schema.fields:
        s = f.dataType.simpleString()
        assert _TYPES.get(s, s.upper().replace(" ", "")) == duck[f.name], (f.name, s, duck[f.name])
