"""Every registered query against its SQL on the smallest tables; those without SQL must give rows."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def names():
    from cairnfield.plans import registry

    return sorted(registry.queries())


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", names())
def test_query(spark, db, name):
    from cairnfield.plans import registry

    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = db.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    place = [order.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in place) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_classes_of_tied_means_are_those_of_rows_in_their_order(spark, tmp_path):
    """An order's rows lie in several files; the SQL adds them in the table's order on one thread."""
    import duckdb

    from cairnfield.plans import registry

    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    rows.repartition(4, "l_partkey", "l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["building_rows"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["building_rows"])
    assert [d[0] for d in want.description] == got.columns
    wanted, seen = {r[0]: r for r in want.fetchall()}, {r.building_id: tuple(r) for r in got.collect()}
    assert len(wanted) == len(seen) == 14_743
    assert sum(seen[k] != r for k, r in wanted.items()) == 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r.relative_priority_band for r in rows} <= {"CRITICAL", "HIGH", "MODERATE", "LOW"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
