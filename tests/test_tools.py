import pytest
from pyspark.sql import DataFrame

from quarry.context import SessionMemory
from quarry.store import Store
from quarry.tools import Graph


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "src").mkdir()
    (root / "tests").mkdir()
    (root / "src/a.py").write_text("def main():\n    compute(1)\n\n\ndef compute(x):\n    # adds things up for the report\n    total = helper(x)\n    return total\n")
    (root / "src/b.py").write_text("def helper(x):\n    return x + 1\n")
    (root / "tests/test_a.py").write_text("def test_compute():\n    assert compute(1)\n")
    g = Graph(spark, Store(spark, f"file://{tmp_path_factory.mktemp('store')}/g"))
    g.call("index_repository", repo_path=str(root), name="p")
    return g, root


def ids(g):
    return {r["name"]: r["id"] for r in g.nodes("p").where("kind <> 'file'").collect()}


def test_all_names_are_there(indexed):
    assert len(indexed[0].tools) == 53


def test_index_search_and_traverse(indexed):
    g, _ = indexed
    n = ids(g)
    assert {r["name"] for r in g.call("get_callers", node_id=n["helper"]).collect()} == {"compute", "main", "test_compute"}
    assert [r["name"] for r in g.call("get_callees", node_id=n["main"], max_depth=1).collect()] == ["compute"]
    assert [(r["src"], r["dst"]) for r in g.call("find_path", from_node_id=n["main"], to_node_id=n["helper"]).collect()] == [(n["main"], n["compute"]), (n["compute"], n["helper"])]
    assert g.call("search_symbol", project="p", query="comp").first()["name"] == "compute"
    assert g.call("search_code", project="p", query="report things").first()["name"] in ("compute", "a.py")
    assert g.call("query_graph", project="p", query="MATCH (f:File)-[:contains]->(n) RETURN n.name").count() == 4
    assert {r["name"] for r in g.call("find_dead_code", project="p").collect()} == {"test_compute"}
    assert g.call("get_contracts", project="p", node_id=n["compute"]).first()["tests"] == 1


def test_incremental_refresh(indexed):
    g, root = indexed
    before = g.nodes("p").count()
    assert not {"new", "changed", "deleted"} & set(g.call("index_repository", repo_path=str(root), name="p"))
    (root / "src/b.py").write_text("def helper(x):\n    return x + 2\n\n\ndef extra():\n    return 0\n")
    g.call("index_repository", repo_path=str(root), name="p")
    assert g.nodes("p").count() == before + 1
    assert ("extra", "introduced") in {(r["name"], r["change"]) for r in g.call("get_recent_semantic_changes", project="p").collect()}
    (root / "src/b.py").write_text("def helper(x):\n    return x + 1\n")
    g.call("index_repository", repo_path=str(root), name="p")
    assert g.nodes("p").count() == before


def test_every_reading_tool_answers(indexed):
    g, _ = indexed
    n = ids(g)
    g.record_access(n["main"], "p")
    g.embed_pending()
    g.call("memory_store", project="p", content="compute is slow", kind="insight")
    g.call("session_remember", key="k", value="v")
    assert g.call("session_recall", key="k")["value"] == "v"
    number = g.call("manage_adr", project="p", action="create", title="t", context="c")["id"]
    g.call("manage_adr", project="p", action="update", adr_id=number, status="accepted")
    row = g.call("manage_adr", project="p", action="get", adr_id=number).first()
    assert (row["title"], row["status"]) == ("t", "accepted")
    p, node = {"project": "p"}, {"node_id": n["compute"]}
    calls = {"list_projects": {}, "get_status": {}, "project_overview": p, "get_stats": p, "get_clusters": p, "suggest_boundaries": p, "check_boundaries": p, "get_architecture": p, "get_route_map": p, "suggest_tests": p, "get_hotspots": p, "technical_debt_map": p, "detect_change_coupling": p, "get_working_set": p, "memory_list": p, "memory_search": p | {"query": "slow"}, "get_imports": node, "get_dependents": node, "impact_analysis": node, "find_similar": node, "get_pagerank": p | node, "git_archaeology": p | node, "get_context": node, "get_edit_context": p | node, "explain_code": p | node, "hybrid_search": p | {"query": "compute total"}, "semantic_search": p | {"query": "helper"}, "find_symbol_everywhere": {"symbol_name": "main"}, "get_file_structure": p | {"file_path": "a.py"}, "prepare_task_context": p | {"task": "compute report"}}
    for name, arguments in calls.items():
        got = g.call(name, **arguments)
        assert isinstance(got, DataFrame) and got.collect() is not None, name
    plan = g.call("evaluate_plan_risk", project="p", targets=[{"file_path": "src/a.py", "symbol_name": "compute", "change_intent": "fix bug"}, {"file_path": "nowhere.py"}])
    assert plan["targets"][1]["score"] == 0.05 and plan["targets"][0]["intent"] == "bugfix" and plan["order"]
    assert "Cluster" in g.call("generate_wiki", project="p")["wiki"] and "tests" in g.call("plan_change", project="p", description="x", files=["src/a.py"])
    g.call("link_cross_project", source_node_id=n["main"], target_node_id=n["helper"], project="p")
    assert g.edges("p").where("kind = 'cross_project'").count() == 1
    g.call("memory_delete", id=1)
    assert g.call("memory_list", project="p").count() == 0 and g.call("get_job_status", job_id="x")["jobs"] == []
    with pytest.raises(KeyError):
        g.call("no_such_tool")


def test_session_memory_evicts_the_oldest():
    memory = SessionMemory(2)
    for key in ("a", "b", "c"):
        memory.remember(key, key)
    assert [k for k, _ in memory.all()] == ["b", "c"] and memory.search("C")[0][0] == "c"


def test_indexing_reads_routes_manifests_and_infrastructure(spark, tmp_path):
    root = tmp_path / "app"
    (root / "k8s").mkdir(parents=True)
    (root / "sub").mkdir()
    (root / "server.py").write_text("@app.get('/items/{id}')\ndef item(id):\n    return id\n\n\n@app.route('/plain')\ndef plain():\n    return 1\n")
    (root / "package.json").write_text('{"name": "shop", "dependencies": {"left-pad": "1.0.0"}}')
    (root / "Dockerfile").write_text("FROM python:3.13\nEXPOSE 80\n")
    (root / "k8s/web.yaml").write_text("apiVersion: v1\nkind: Pod\nmetadata:\n  name: web\nspec:\n  containers:\n    - image: shop:1\n")
    (root / "sub/.gitignore").write_text("hidden.py\n")
    (root / "sub/hidden.py").write_text("def no():\n    return 1\n")
    (root / "sub/shown.py").write_text("def yes():\n    return 1\n")
    g = Graph(spark, Store(spark, f"file://{tmp_path}/store"), rules=[{"from": "server.py", "deny": ["sub/**"]}])
    answer = g.call("index_repository", repo_path=str(root), name="shop")
    assert answer["job_id"].startswith("index-")
    assert {(r["method"], r["path"], r["handler"]) for r in g.call("get_route_map", project="shop").collect()} == {("GET", "/items/{}", "server.py"), ("ROUTE", "/plain", "server.py")}
    named = {r["id"]: (r["kind"], r["name"]) for r in g.nodes("shop").collect()}
    assert ("function", "yes") in named.values() and ("function", "no") not in named.values()
    edges = {(named[r["source_node_id"]], r["kind"], named[r["target_node_id"]]) for r in g.edges("shop").collect()}
    assert {(("manifest", "shop"), "depends_on", ("library", "left-pad")), (("file", "package.json"), "contains", ("manifest", "shop")), (("dockerfile", "Dockerfile"), "derived_from", ("docker_image", "python:3.13")), (("k8s_resource", "Pod/web"), "deploys_image", ("docker_image", "shop:1"))} <= edges
    assert {"package", "route"} <= {r["section"] for r in g.call("get_architecture", project="shop").collect()}
    embedded = g.store.read("vectors")
    assert embedded.count() == embedded.select("node_id").distinct().count() == g.nodes("shop").where("source is not null").count()
    assert g.call("hybrid_search", project="shop", query="plain").count()
    assert g.call("index_repository", repo_path=str(root), name="shop").keys() >= {"project_id", "job_id"}
    assert g.call("get_route_map", project="shop").count() == 2 and {(named[r["source_node_id"]], r["kind"], named[r["target_node_id"]]) for r in g.edges("shop").collect()} == edges


def test_plan_risk(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/plan")
    node = "id long, project_id long, file_path string, kind string, name string, qualified_name string, complexity long, start_line long, end_line long, is_exported boolean, source string"
    nodes = [(1, 1, "a/x.py", "file", "x.py", None, None, 1, 9, False, None), (2, 1, "b/y.py", "file", "y.py", None, None, 1, 9, False, None), (3, 1, "a/x.py", "function", "work", None, 8, 1, 5, True, None), (4, 1, "b/y.py", "function", "work", None, 2, 1, 5, True, None), *[(10 + k, 1, f"c/{k}.py", "function", f"user{k}", None, 1, 1, 5, True, None) for k in range(7)]]
    store.write("nodes", spark.createDataFrame(nodes, node))
    store.write("projects", spark.createDataFrame([(1, "p", "/p")], "id long, name string, root_path string"))
    arcs = [(3, 4, "calls"), (1, 2, "imports"), *[(10 + k, 3, "calls") for k in range(7)]]
    store.write("edges", spark.createDataFrame([(i, 1, a, b, k, None) for i, (a, b, k) in enumerate(arcs)], "id long, project_id long, source_node_id long, target_node_id long, kind string, metadata string"))
    store.write("commit_node_links", spark.createDataFrame([(1, f"h{k}", n) for k in range(9) for n in (3, 1, 2)], "project_id long, commit_hash string, node_id long"))
    store.write("node_pagerank", spark.createDataFrame([(1, n, 0.3 if n == 3 else 0.05) for n, *_ in nodes], "project_id long, node_id long, pagerank double"))
    g = Graph(spark, store, rules=[{"from": "a/**", "deny": ["b/**"]}])
    plain = g.call("evaluate_plan_risk", project="p", targets=[{"file_path": "a/x.py", "symbol_name": "work"}, {"file_path": "y.py"}, {"file_path": "none.py"}])
    scores = [t["score"] for t in plain["targets"]]
    assert [t["node_id"] for t in plain["targets"]] == [3, 2, None] and scores[2] == 0.05
    assert plain["violations"] == ["a/x.py -> b/y.py violates b/**"] and plain["overall"] == pytest.approx(min(1.0, sum(scores) / 3 + 0.15))
    found = {(s["node_id"], s["strategy"]) for s in plain["strategies"]}
    assert {(3, "extract_interface"), (3, "add_test_contract"), (3, "refactor_hotspot"), (3, "divide_and_conquer"), (3, "account_change_coupling"), (2, "partition_changes")} <= found and not plain["pruned"]
    chained = g.call("evaluate_plan_risk", project="p", targets=[{"file_path": "a/x.py", "symbol_name": "work", "change_intent": "fix a typo in the readme"}, {"file_path": "b/y.py", "symbol_name": "work"}])
    told = chained["targets"][0]
    assert told["intent"] == "documentation" and told["score"] < scores[0] and {s["strategy"] for s in chained["pruned"]} >= {"extract_interface", "add_test_contract"}
    assert chained["overall"] == pytest.approx(min(1.0, sum(t["score"] for t in chained["targets"]) / 2 + 0.15 + 0.05))
    assert [n for n, _ in chained["order"]] == [4, 3]
    assert g.call("evaluate_plan_risk", project="p", targets=[])["overall"] == 0


def test_stems_and_marks():
    from quarry.operators.search import folded, stem

    words = "caresses ponies ties caress cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer differently analogously vietnamization operator feudalism hopefulness formaliti sensibiliti triplicate formative formalize electrical goodness revival allowance inference adjustment dependent adoption communism effective bowdlerize probate rate cease controll roll generalizations".split()
    want = "caress poni ti caress cat feed agre plaster motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit differ analog vietnam oper feudal hope formal sensibl triplic form formal electr good reviv allow infer adjust depend adopt commun effect bowdler probat rate ceas control roll gener".split()
    assert [stem(w) for w in words] == want and folded("Überläufe") == "Uberlaufe" and folded("日本") == "日本"
