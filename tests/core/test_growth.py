"""What only tables beyond a limit show: results stay whole, and work follows what differs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn.operators import grouping, points, sets, spatial
from tarn.plans import graph
from tarn.plans.catalogue import QUERIES, SQL
from tarn.sinks import publish
from tarn.sources import delimited, jsonld, linked_data
from tarn.storage import stored


def test_blocks_of_rows_have_hashes_of_their_own(spark):
    rows = spark.createDataFrame([(i + 1, f"v{i}") for i in range(40)], "n long, v string")
    blocks = {r["block"]: r["result_sha256"] for r in delimited.block_hashes(rows, "n", ["v"], fan=4).collect()}
    assert sorted(blocks) == [0, 1, 2] and len(set(blocks.values())) == 3
    first = rows.where("n <= 16")
    assert blocks[0] == delimited.result_hash(first, "n", ["v"], fan=4).first()[0]
    assert blocks[0] != delimited.result_hash(rows, "n", ["v"], fan=4).first()[0]


def test_features_of_many_customers_come_in_several_pages(spark, tmp_path):
    spark.range(25_000).selectExpr("id AS c_custkey", "'c' AS c_name", "3 AS c_nationkey", "0.5D AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    found = QUERIES["OP09_features"](spark, str(tmp_path))
    assert found.count() == 25_000 == found.select("feature_id").distinct().count()


@pytest.mark.parametrize("name", ["OP88_sites_in_area", "OP89_sites_on_mainstem", "OP90_sites_by_provider"])
def test_more_sites_than_a_page_holds(spark, tmp_path, name):
    spark.range(27_000).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "CAST(3 AS INT) AS s_nationkey", "0D AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    for table in ("nation", "lineitem", "orders", "part"):
        (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
    with duckdb.connect() as con:
        for table in ("supplier", "nation"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet{'/*.parquet' if table == 'supplier' else ''}')")
        theirs = sorted(r[0] for r in con.execute(f"SELECT site FROM ({SQL[name]})").fetchall())
    mine = sorted(r["site"] for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert mine == theirs and len(mine) > 1000


def test_linked_documents_are_dealt_out_once_and_never_broadcast(spark):
    rows = spark.createDataFrame([(f"p{i}", '{"@id": "https://e.org/%d", "@type": "hyf:HY_X", "schema:subjectOf": {"@type": "schema:Dataset", "schema:name": "d"}}' % i) for i in range(20)], "profile_uri string, body string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    parts = plan(jsonld.documents(rows).select("profile_uri", F.explode("parts").alias("n")))
    assert parts.count("ArrowEvalPython") == 1 and "Exchange" in parts[parts.index("ArrowEvalPython") :]
    for df in (linked_data.datasets(rows), linked_data.locations(rows), publish.document_findings(rows, "1", "p")):
        assert "Broadcast" not in plan(df) and df.count() >= 20


def test_equal_shapes_are_worked_out_once(spark, monkeypatch):
    box = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    areas = spark.createDataFrame([(f"a{i}", box) for i in range(30)], "area_id string, area_wkt string")
    lines = spark.createDataFrame([(f"l{i}", "LINESTRING (1 1, 5 1)") for i in range(20)], "line_id string, line_wkt string")
    kept = {}
    for module in (spatial, points):
        monkeypatch.setattr(module, "stored", lambda df, name: kept.update({name: stored(df, name)}) or kept[name])
    assert spatial.intersecting(areas, lines).count() == 600 and kept["lengths"].count() == 1
    at = spark.range(50).selectExpr("id", "1D AS x", "1D AS y")
    assert points.in_areas(at, F.col("x"), F.col("y"), areas).count() == 1500 and kept["found"].count() == 1


def test_fragments_are_shuffled_once_and_as_they_are(spark, monkeypatch):
    rows = [(i % 5, i % 3, [f"v{i % 7}", None, f"w{i % 2}"], [] if i % 4 else None) for i in range(200)] + [(None, 1, ["x", "x"], ["y"])]
    df = spark.createDataFrame(rows, "node int, o int, v array<string>, w array<string>")
    merged = grouping.merged_fragments(df, "node", "o", ["v", "w"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan
    kept = lambda found: {r["node"]: (r["v"], r["w"]) for r in found.collect()}
    whole = kept(merged)
    assert whole[None] == (["x"], ["y"]) and len(whole) == 6
    assert kept(grouping._merged_by_value(df, "node", "o", ["v", "w"])) == whole
    monkeypatch.setattr(grouping, "GATHERED", 1)
    split = grouping.merged_fragments(df, "node", "o", ["v", "w"])
    assert kept(split) == whole and split.count() == 6


def test_distinct_values_are_counted_by_all_tasks(spark):
    df = spark.range(300).selectExpr("id % 3 AS k", "id % 7 AS a", "IF(id % 5 = 0, NULL, concat('v', id % 11)) AS b")
    counted = grouping.distinct_coverage(df, "k", a_count="a", b_count="b", again="a")
    assert "REPARTITION_BY_NUM" in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counted.collect())) == [(k, 7, 11, 7) for k in range(3)]


def test_datasets_of_a_variable_are_distinct_before_they_are_combined(spark):
    pairs = lambda names, rows: spark.createDataFrame(rows + rows[:1], ", ".join(f"{n} string" for n in names.split()))
    tables = {
        "subject_of": pairs("site dataset", [("s1", "d1"), ("s2", "d1"), ("s1", "d2"), ("s1", "d3")]), "datasets": pairs("dataset dataset_name temporal_coverage", [("d1", "one", None), ("d2", None, None), ("d3", "x", None)]),
        "distributions": pairs("dataset distribution access_url media_type", [("d1", "a", "u", "m"), ("d1", "b", "u", None)]), "measured": pairs("dataset variable", [("d1", "v1"), ("d1", "v2"), ("d2", "v1"), ("d3", "v3")]),
        "variables": pairs("variable variable_name variable_match unit_uri unit_label", [("v1", "n", "flow", None, "l"), ("v2", "n", "flow", None, "l"), ("v3", "n", "other", None, "l")]),
    }
    found = graph.datasets_by_variable(graph.Graph(sites=None, positions=None, providers=None, **tables), "flow")
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r["site"], r["dataset"], r["distribution"], r["variable"]) for r in found.collect()]
    assert rows == sorted((s, "d1", d, v) for s in ("s1", "s2") for d in "ab" for v in ("v1", "v2"))[:4] + [("s1", "d2", None, "v1")] + [("s2", "d1", d, v) for d in "ab" for v in ("v1", "v2")]


def test_references_are_followed_within_a_documents_row(spark, monkeypatch):
    """Odd graphs, against plain Python; in more tasks where there is more; by joins where a document has very many."""
    own = random.Random(5)
    graphs = {f"g{g}": {f"n{i}": [f"n{own.randrange(12)}" for _ in range(own.choice([0, 0, 1, 2, 5]))] for i in range(9)} for g in range(30)}
    graphs |= {"chain": {f"n{i}": [f"n{i + 1}"] for i in range(14)}, "own": {"n0": ["n0", "n0"]}, "none": {"n0": []}}
    rows = [(p, node, 0, [], {"a": [(None, r) for r in refs[:2]] + [("text", None)], "b": [(None, r) for r in refs[1:]]}) for p, graph in graphs.items() for node, refs in graph.items()]
    nodes = spark.createDataFrame([*rows, (None, "n0", 0, [], {"a": [(None, "n1")]}), ("g0", None, 0, [], {"a": [(None, "n1")]}), ("bare", "n0", 0, [], None)], f"profile_uri string, {jsonld.NODE.replace('id', 'node', 1)}")
    begun = [(p, s) for p in graphs for s in ("n0", "n3", "elsewhere")]
    odd = [(None, "n0"), ("g0", None), ("bare", "n0"), ("not there", "n0")]
    starts = spark.createDataFrame([*begun, *begun[:5], *odd], "profile_uri string, node string")
    want = {(p, s, s, 0) for p, s in odd}
    for p, s in begun:
        found = {s: 0}
        for node in (queue := [s]):
            new = dict.fromkeys(r for r in graphs[p].get(node, []) if r not in found)
            found |= dict.fromkeys(new, found[node] + 1)
            queue += new
        want |= {(p, s, node, steps) for node, steps in found.items()}

    def check(tables):
        written = []
        monkeypatch.setattr(jsonld, "stored", lambda df, name: written.append(name) or stored(df, name))
        reached = jsonld.reached(nodes, starts)
        rows = [(r["profile_uri"], r["start"], r["node"], r["steps"]) for r in reached.collect()]
        assert len(rows) == len(want) and set(rows) == want and set(written) == tables
        return reached

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole = check({"links", "hot"})
    assert "Join" not in plan(whole) and plan(whole).split("Initial Plan")[-1].count("Exchange ") == 1 and whole.rdd.getNumPartitions() == 4
    monkeypatch.setattr(jsonld, "ENTRIES", 50)
    assert check({"links", "hot"}).rdd.getNumPartitions() > 8
    for gathered in (25, 0):  # those with most, or all
        monkeypatch.setattr(jsonld, "GATHERED", gathered)
        check({"links", "hot", "edges", "reached", "newest"})


@pytest.mark.parametrize("many", ["left", "right"])
def test_results_are_handed_back_by_tasks_that_follow_from_their_rows(spark, monkeypatch, many):
    """Whichever side a key has more rows of; with keys that are one task's, and keys that are several tasks' in both directions."""
    own = random.Random(9)
    counts = {"left": {f"a{i}": own.choice([0, 1, 3]) for i in range(6)} | {"a0": 90}, "right": {f"b{i}": own.choice([0, 1, 2]) for i in range(6)} | {"b0": 3}}
    if many == "right":
        counts = {"left": dict(zip(counts["left"], counts["right"].values())), "right": dict(zip(counts["right"], counts["left"].values()))}
    rows = {side: [(key, None if side == "right" and i == 1 else f"{key}-{i}") for key, n in of.items() for i in range(n)] for side, of in counts.items()}
    pairs = [(f"a{i}", f"b{j}", 10 * i + j) for i in range(6) for j in range(6) if i == j or own.random() < 0.4] + [("a0", "elsewhere", 1)]
    want = sorted(((x, k, y) for a, b, k in pairs for key, x in rows["left"] if key == a for other, y in rows["right"] if other == b), key=repr)
    df = [spark.createDataFrame(rows[side], f"_{side} string, {side} string") for side in ("left", "right")]
    found = lambda: sets.handed_back(df[0], spark.createDataFrame(pairs, "_left string, _right string, k long"), df[1])
    read = lambda x: sorted(map(tuple, x.collect()), key=repr)
    whole = found()
    assert read(whole) == want and len(want) > 200 and whole.columns == ["left", "k", "right"] and whole.rdd.getNumPartitions() == 4
    for held in (2, 1 << 16):
        for name, value in {"TASK_ROWS": 30, "LEAST": 10, "HELD": held}.items():
            monkeypatch.setattr(sets, name, value)
        dealt = found()
        assert read(dealt) == want and dealt.rdd.getNumPartitions() == -(-len(want) // 30)
        sizes = [n for n in dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
        assert max(sizes) < len(want) / 2
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.index("SortMergeJoin") < plan.index("Exchange")  # nothing is shuffled after the join that makes the rows


def test_areas_and_points_meet_in_as_many_tasks_as_their_result_asks_for(spark, monkeypatch):
    monkeypatch.setattr(sets, "TASK_ROWS", 100)
    monkeypatch.setattr(sets, "LEAST", 10)
    box = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    areas = spark.createDataFrame([(f"a{i}", box) for i in range(30)], "area_id string, area_wkt string")
    lines = spark.createDataFrame([(f"l{i}", "LINESTRING (1 1, 5 1)") for i in range(20)], "line_id string, line_wkt string")
    found = spatial.intersecting(areas, lines, digits=2)
    assert found.rdd.getNumPartitions() == 6 and found.distinct().count() == 600 and {r["km"] for r in found.collect()} == {111.18}
    at = spark.createDataFrame([(i, 1.0, 1.0) for i in range(50)], "id long, x double, y double")
    inside = points.in_areas(at, F.col("x"), F.col("y"), areas)
    assert inside.rdd.getNumPartitions() == 15 and inside.distinct().count() == 1500
