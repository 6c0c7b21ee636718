import pytest

from quarry.operators import model
from quarry.plans import pattern


@pytest.fixture(scope="module")
def tables(spark):
    names = [f.name for f in model.NODE]
    row = lambda i, name, kind="function", meta=None: tuple({"id": i, "project_id": 1, "kind": kind, "name": name, "file_path": "f", "metadata": meta, "complexity": i}.get(n) for n in names)
    nodes = spark.createDataFrame([row(1, "main"), row(2, "compute"), row(3, "unused_func", meta='{"lang": "rust", "n": 5}'), row(4, "t", "test_contract")], model.NODE)
    edges = spark.createDataFrame([(1, 1, 1, 2, "calls", None, None), (2, 1, 3, 3, "calls", None, None)], model.EDGE)
    return nodes, edges


def run(tables, text):
    return pattern.run(text, *tables)


def test_equality_hop_and_not_exists(tables):
    assert [r.n_name for r in run(tables, "MATCH (n:Function) WHERE n.name = 'main' RETURN n.name").collect()] == ["main"]
    assert [tuple(r) for r in run(tables, "MATCH (f)-[:calls]->(g) WHERE f.name = 'main' RETURN f.name, g.name").collect()] == [("main", "compute")]
    assert {r.n_name for r in run(tables, "MATCH (n:Function) WHERE NOT EXISTS { (n)<-[:calls]-() } RETURN n.name").collect()} == {"main"}


def test_undirected_leaves_loops_out_and_repeated_variables_are_one(tables):
    assert {tuple(r) for r in run(tables, "MATCH (a)-[:calls]-(b) RETURN a.id, b.id").collect()} == {(1, 2), (2, 1)}
    assert [r.a_id for r in run(tables, "MATCH (a)-[:calls]->(a) RETURN a.id").collect()] == [3]


def test_labels_json_order_and_limit(tables):
    assert run(tables, "MATCH (n:TestContract) RETURN n.id").count() == 1
    assert [r.n_id for r in run(tables, "MATCH (n) WHERE n.lang = 'rust' RETURN n.id").collect()] == [3]
    assert run(tables, "MATCH (n) WHERE n.n = '5' RETURN n.id").count() == 0
    assert [r.n_id for r in run(tables, "MATCH (n) RETURN n.id ORDER BY n.complexity DESC LIMIT 2").collect()] == [4, 3]
    assert run(tables, "MATCH (n) WHERE n.complexity = '2' RETURN n").columns[0] == "id"
    assert "a_id" in run(tables, "MATCH (a)-->(b) RETURN a, b").columns


@pytest.mark.parametrize("text", ["RETURN n", "MATCH (n) RETURN n LIMIT abc", "MATCH (n) RETURN n nonsense", "MATCH (n) RETURN COUNT(n)", "MATCH (n RETURN n", "MATCH (n) WHERE n.a > 1 RETURN n", "MATCH (n) RETURN m.id"])
def test_errors_are_told(tables, text):
    with pytest.raises(pattern.PatternError):
        run(tables, text)
