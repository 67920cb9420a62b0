import pytest

import __spark_entry__ as entry
from oracle import compare, connect

LLM = {k for k in entry.queries() if k == "pipeline" or k.startswith("op")}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_same_rows_as_sql(spark, data, name):
    assert compare(entry.queries()[name](spark, data), entry.oracle_sql()[name], connect(data)) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - LLM))
def test_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
