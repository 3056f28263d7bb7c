"""Every query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tarn.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


GROUPED = ("HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window")
SHUFFLED = ("SortMergeJoin", "ShuffledHashJoin")


def grouped_sides(df):
    """Joins whose one side keeps the partitions of a grouping: Spark can't split these where the other side has a hot key."""
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def children(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return [node.initialPlan()]
        own = node.children()
        return [own.apply(i) for i in range(own.size())]

    def walk(node):
        name = node.nodeName()
        if name.startswith(SHUFFLED):
            for side in children(node):
                while not side.nodeName().startswith(("Exchange", "ShuffleQueryStage", *SHUFFLED)):
                    if side.nodeName().startswith(GROUPED):
                        found.append(f"{name} of {side.nodeName()}")
                        break
                    below = children(side)
                    if len(below) != 1:
                        break
                    side = below[0]
        for child in children(node):
            walk(child)

    walk(plan)
    return found


@pytest.fixture(scope="module", autouse=True)
def joins_are_shuffled(spark):
    """Only hinted sides, whose size is checked, are broadcast, as at any size of input."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert not grouped_sides(df)
    columns = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
