import pytest
from conftest import same_rows

from newsloom.plans.oracles import SQL
from newsloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    rows = got.toPandas()
    assert got.columns and len(set(got.columns)) == len(got.columns)
    if name in SQL:
        assert same_rows(rows, duck.execute(SQL[name]).df())


def test_every_item_has_one_event(spark, data):
    got = QUERIES["cluster_events"](spark, data).toPandas()
    assert got.item_id.is_unique and set(got.event_id) <= set(got.item_id)


def test_entry_without_training_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
