"""Every query with an SQL twin gives the twin's rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from rankweave.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    twin = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in twin.description]
    assert sorted(df.columns) == sorted(names)
    mine, other = rows(df.columns, df.collect()), rows(names, twin.fetchall())
    assert len(mine) == len(other)
    for a, b in zip(mine, other, strict=True):
        for x, y in zip(a, b, strict=True):
            near = isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
            assert near or x == y, (name, a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_order_of_the_input_does_not_matter(spark):
    from rankweave.core.contest import contest_view
    from rankweave.operators.history import rolling_history
    from rankweave.plans.history_queries import ENTITY, ORDER, with_targets

    v = with_targets(contest_view(spark, SMALL))
    a = rolling_history(v, ["entity_id"], ORDER, ENTITY)
    b = rolling_history(v.repartition(13, "slot"), ["entity_id"], ORDER, ENTITY)
    key = lambda r: (r["contest_id"], r["slot"])
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)
