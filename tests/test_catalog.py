"""Every registered query against its DuckDB text on the smallest data.

The selected queries run side by side in a few threads: on small data most of the time
is planning, which uses one core per query.
"""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tests.compare import compare, duck
from tillworks import catalog

QUERIES, CHECKS = catalog.queries(), catalog.checks()


@pytest.fixture(scope="module")
def outcomes(request, spark, folder):
    con = duck(folder)

    def run(key):
        df = QUERIES[key](spark, folder)
        if key in CHECKS:
            return compare(con.cursor(), CHECKS[key], df)
        return df.count(), df.columns

    keys = [i.callspec.params["key"] for i in request.session.items if i.module is request.module and hasattr(i, "callspec")]
    with ThreadPoolExecutor(6) as pool:
        yield {k: pool.submit(run, k) for k in keys}


@pytest.mark.parametrize("key", sorted(CHECKS))
def test_matches_sql(outcomes, key):
    got, want = outcomes[key].result()
    assert got == want


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(outcomes, key):
    n, columns = outcomes[key].result()
    assert n > 0 and len(set(columns)) == len(columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
