"""Queries against their SQL, values and types."""

import pytest

from screenflow.llm.oracle import ORACLE
from screenflow.llm.queries import QUERIES
from tests.comparing import connect, oracle_rows, spark_rows
from tests.conftest import DATA

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = connect(DATA)
    result = QUERIES[name](spark, DATA)
    assert spark_rows(result) == oracle_rows(con, ORACLE[name])
    types = {d[0]: str(d[1]) for d in con.execute(ORACLE[name]).description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in result.schema} == types
