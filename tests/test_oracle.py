"""Every content query with SQL gives the SQL's rows, and not trivially."""

import __spark_entry__ as entry
import pytest
from oracle import both
from topicflow.plans.queries import SQL

SF = "/root/testdata/sf0.001"
#: Empty on this small input, with good reason.
MAY_BE_EMPTY = {"alert_sources", "ledger_attach", "confusion_pairs"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    columns, theirs, mine, want = both(spark, entry, name, SF)
    assert columns == theirs
    assert mine == want
    assert mine or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
