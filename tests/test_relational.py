import pytest
from pyspark.sql import functions as F

from quarry.functions.text import canonical_route, ignore_regex, truncate_to_tokens
from quarry.operators import relational, risk, search, similarity
from quarry.sources import extract


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "want"), [("/users/:id", "/users/{}"), ("/api/orders/{id}", "/api/orders/{}"), ("/posts/<int:post_id>", "/posts/{}"), ("/docs/${version}", "/docs/{}"), ("//api//v1/:id//", "/api/v1/{}"), ("/", "/"), ("/health", "/health")])
def test_routes(spark, path, want):
    assert one(spark, canonical_route(F.col("p")), p=path) == want


@pytest.mark.parametrize(("text", "kind", "share"), [("fix typo in documentation comment", "documentation", 0.15), ("add debug logging to payment flow", "logging", 0.25), ("fix SQL injection vulnerability in auth handler", "security", 1.0), ("xyz", "unknown", 1.0), (None, "unknown", 1.0)])
def test_intents(spark, text, kind, share):
    got = spark.createDataFrame([(text,)], "t string").select(risk.intent(F.col("t")).alias("x")).first().x
    assert got.intent == kind and got.multiplier == share


def test_commit_kinds(spark):
    rows = spark.createDataFrame([("feat: a",), ("fix: b",), ("refactor: c",), ("chore: d",), ("random commit",)], "m string")
    assert [r.k for r in rows.select(relational.commit_kind(F.col("m")).alias("k")).collect()] == ["feat", "fix", "refactor", "chore", "other"]


def test_cosine_and_zero_vector(spark):
    vectors = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(search.cosine(F.col("a"), F.col("b")).alias("x")).first().x
    assert vectors([1.0, 2.0], [2.0, 4.0]) == pytest.approx(1.0)
    assert vectors([1.0, 0.0], [0.0, 1.0]) == 0.0
    assert vectors([0.0, 0.0], [0.0, 1.0]) is None


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "hello_world fn hello_world() {}"), (2, "other running runs run"), (3, "x nothing here at all"), (4, "y hello again")], "id long, text string")
    asked = spark.createDataFrame([(1, "hello")], "query_id long, query string")
    got = [(r.doc, r.score) for r in search.bm25(docs, "id", "text", asked).orderBy("rank").collect()]
    assert [d for d, _ in got] == [1, 4] and got[0][1] == pytest.approx(-1.309982e-06, rel=0.06)


def test_vector_search_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "node_id long, embedding array<double>")
    got = search.vector_search(rows, rows.where("node_id < 3").withColumnRenamed("node_id", "query_id"), 5, block=2).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(3):
        want = [int(i) for i in np.argsort(-(unit @ unit[q]))[:5] if (unit @ unit[q])[i] > 0]
        assert [r.node_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_similarity_measures(spark):
    a = "fn parse(s: &str) -> Result<Data> { let mut out = Data::new(); for part in s.split(',') { out.push(part.trim()); } Ok(out) }"
    b = a.replace("part", "item")
    sign = lambda t: similarity._signature("".join(t.split()))
    share = sum(x == y for x, y in zip(sign(a), sign(b), strict=True)) / 100
    other = sum(x == y for x, y in zip(sign(a), sign("struct Point { x: f64, y: f64 } impl Point { fn norm(&self) -> f64 { self.x } }"), strict=True)) / 100
    assert share > 0.5 > 0.2 > other
    rows = spark.createDataFrame([("controllers/user.rs", "controllers/auth.rs", "models/user.rs")], "a string, b string, c string")
    got = rows.select(similarity.directory_proximity(F.col("a"), F.col("b")).alias("x"), similarity.directory_proximity(F.col("a"), F.col("c")).alias("y"), similarity.token_overlap(F.lit(""), F.lit("")).alias("z")).first()
    assert got.x == 1.0 and got.y == 0.0 and got.z == 1.0


def test_safe_order():
    assert [t for t, _ in risk.safe_order([(1, 0.1), (2, 0.2), (3, 0.3)], [(1, 2), (2, 3)])] == [3, 2, 1]
    cycle = risk.safe_order([(1, 0.1), (2, 0.2)], [(1, 2), (2, 1)])
    assert len(cycle) == 2 and "cycle" in cycle[0][1]


def test_file_structure_prefers_exact_paths(spark):
    rows = spark.createDataFrame([(1, 1, "a/b.rs", 1), (2, 1, "x/a/b.rs", 1)], "id long, project_id long, file_path string, start_line long")
    assert [r.id for r in relational.file_structure(rows, "a/b.rs").collect()] == [1]
    assert [r.id for r in relational.file_structure(rows, "b.rs").collect()] == [1, 2]


def test_extraction_of_entities_manifests_and_infrastructure():
    found = extract.entities("class A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n", "python")
    assert [(e[0], e[1], e[2], e[3]) for e in found] == [("class", "A", 1, 3), ("function", "f", 2, 3), ("function", "g", 5, 6)]
    assert [e[1] for e in extract.entities("func (s *T) Run(a int) int {\n\treturn 1\n}\ntype T struct {\n}\n", "go")] == ["Run", "T"]
    assert extract.manifest("a/package.json", '{"name": "x", "dependencies": {"y": "1"}}') == ("x", [("y", "1")])
    assert extract.manifest("go.mod", "module m\nrequire (\n\ta/b v1.2\n)\n") == ("m", [("a/b", "v1.2")])
    assert extract.manifest("package.json", "{") == (None, [])
    kinds = [x[0] for x in extract.infrastructure("k8s.yaml", "apiVersion: v1\nkind: Pod\nmetadata:\n  name: p\nspec:\n  containers:\n  - image: img\n")]
    assert kinds == ["k8s_resource", "docker_image"]
    assert extract.infrastructure("Dockerfile", "FROM a\nFROM b\nEXPOSE 80 81\n")[0][2] == '{"base_image": "b", "exposed_ports": ["80", "81"]}'


def test_calls_resolve_in_three_steps(spark):
    cols = "id long, project_id long, file_path string, kind string, name string, is_exported boolean, source string"
    rows = spark.createDataFrame([
        (1, 1, "a/x.rs", "function", "f", True, "fn f() { g(); h(); k(); if (x) {} f(); o.m(); }"), (2, 1, "a/x.rs", "function", "g", True, "fn g() {}"), (3, 1, "a/y.rs", "function", "h", False, ""),
        (4, 1, "b/z.rs", "function", "k", True, ""), (5, 1, "a/x.rs", "method", "m", True, ""), (6, 1, "b/z.py", "function", "h", False, None),
    ], cols)
    assert {(r.source_node_id, r.target_node_id) for r in extract.resolve_calls(rows).collect()} == {(1, 2), (1, 3), (1, 4), (1, 5)}


def test_state_and_semantic_diff(spark):
    a = spark.createDataFrame([(1, "a", "1"), (1, "b", "1"), (1, "c", None)], "project_id long, file_path string, content_hash string")
    b = spark.createDataFrame([(1, "b", "2"), (1, "c", None), (1, "d", "1")], "project_id long, file_path string, content_hash string")
    assert {(r.file_path, r.status) for r in extract.state_diff(a, b).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "same"), ("d", "new")}
    node = "project_id long, file_path string, name string, kind string, complexity long"
    old = spark.createDataFrame([(1, "f", "x", "function", 1), (1, "f", "y", "function", 1)], node)
    new = spark.createDataFrame([(1, "f", "y", "function", 9), (1, "f", "z", "function", 1)], node)
    assert {(r.name, r.change) for r in extract.semantic_diff(old, new).collect()} == {("x", "removed"), ("z", "introduced"), ("y", "complexity")}


def test_ignore_rules_and_token_cuts(spark):
    import re

    out, back = ignore_regex(["target/", "*.log", "!keep.log", "# x", ""])
    assert re.search(out, "a/target/x.rs") and re.search(out, "b.log") and not re.search(out, "src/targets.rs") and re.search(back, "keep.log")
    assert one(spark, truncate_to_tokens(F.col("t"), 1), t="ééé") == "éé"


def test_declarations_of_python_that_does_not_parse():
    source = 'class A:\n    """doc\ndef no(): pass\n    """\n    def f(\n        self,\n    ):\n        return 1\n\n    # def no():\n    async def g(self):\n        return (1\n\ndef h(x):\n    return x\n\nx = = 1\n'
    assert [e[:4] for e in extract.entities(source, "python")] == [("class", "A", 1, 12), ("function", "f", 5, 8), ("function", "g", 11, 12), ("function", "h", 14, 15)]
    whole = 'import os\n\n@cached\ndef a(x, y=")"):\n    def b():\n        pass\n    return b\n\nclass C(B):\n    x = """\nlow\n"""\n\n    def d(self): return 1\n'
    assert extract._by_indentation(whole) == [(*e[:5], e[5].rstrip("\n")) for e in extract.entities(whole, "python")]
