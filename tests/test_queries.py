"""Every registered query of the engine against its SQL."""

import pytest

from siftwell.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, compare, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found) > 0 or name in ("nav_noise_docs", "filter_source_type_date", "wildcard_question_terms")
    if name in SQL:
        compare(found, duck.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
    assert QUERIES.keys() <= e.queries().keys()
