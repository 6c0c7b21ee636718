import random

import pytest

from quarry.operators import graph


def edges(spark, pairs, project=1):
    return spark.createDataFrame([(project, a, b) for a, b in pairs], "project_id long, src long, dst long")


def members(spark, ids, project=1):
    return spark.createDataFrame([(project, i) for i in ids], "project_id long, node_id long")


def ranks(spark, ids, pairs, **kw):
    return {r.node_id: r.pagerank for r in graph.pagerank(members(spark, ids), edges(spark, pairs), **kw).collect()}


def test_pagerank_goldens(spark):
    assert ranks(spark, [1], [])[1] == pytest.approx(1.0, abs=0.01)
    hub = ranks(spark, [1, 2], [(1, 2)])
    assert hub[1] == pytest.approx(0.350878, abs=1e-5) and hub[2] == pytest.approx(0.649122, abs=1e-5)
    assert ranks(spark, [1, 2, 3], [(1, 2), (2, 3), (3, 1)], iterations=3)[2] == pytest.approx(1 / 3)


def sequential_ranks(ids, pairs, rounds):
    out = {i: sum(1 for a, _ in pairs if a == i) for i in ids}
    r = {i: 1 / len(ids) for i in ids}
    for _ in range(rounds):
        lost = sum(r[i] for i in ids if not out[i])
        r = {i: 0.15 / len(ids) + 0.85 * (sum(r[a] / out[a] for a, b in pairs if b == i) + lost / len(ids)) for i in ids}
    return r


def test_pagerank_against_plain_python(spark):
    rng = random.Random(5)
    ids = list(range(1, 21))
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(50)]
    got, want = ranks(spark, ids, pairs, iterations=4, epsilon=0), sequential_ranks(ids, pairs, 4)
    assert sum(got.values()) == pytest.approx(1.0)
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in ids)


def clusters(spark, ids, pairs):
    return {r.node_id: r.cluster_id for r in graph.communities(members(spark, ids), edges(spark, pairs)).collect()}


def test_community_goldens(spark):
    clique = lambda xs: [(a, b) for a in xs for b in xs if a != b]
    got = clusters(spark, range(1, 7), clique([1, 2, 3]) + clique([4, 5, 6]))
    assert got == {1: 2, 2: 2, 3: 2, 4: 5, 5: 5, 6: 5}
    assert clusters(spark, [1, 2, 3], [(1, 2)]) == {1: 2, 2: 2, 3: 0}
    assert clusters(spark, [1], []) == {1: 1}


def test_communities_do_not_depend_on_the_route(spark, monkeypatch):
    monkeypatch.setattr(graph, "_BUCKET", 3)
    rng = random.Random(1)
    ids = rng.sample(range(-500, 500), 14)
    pairs = [tuple(rng.sample(ids[:12], 2)) for _ in range(22)]
    one, two = ({r.node_id: r.cluster_id for r in graph.communities(members(spark, ids), edges(spark, pairs), task_arcs=n).collect()} for n in (1_000_000, 0))
    assert one == two and len(one) == 14


def test_pagerank_does_not_depend_on_the_route(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(30), rng.randrange(40)) for _ in range(80)]
    one, two = (ranks(spark, range(32), pairs, task_rows=n) for n in (1_000_000, 0))
    assert one == pytest.approx(two, abs=1e-12) and len(one) == 32


def test_places_are_counted_by_ranges(spark):
    got = graph._ranked(spark.createDataFrame([(p, i * 7 % 101) for p in (1, 2) for i in range(60)], "project_id long, node_id long").repartition(7)).collect()
    for p in (1, 2):
        assert [r.rank for r in sorted((r for r in got if r.project_id == p), key=lambda r: r.node_id)] == list(range(1, 61))


def test_modularity_golden(spark):
    clique = lambda xs: [(a, b) for a in xs for b in xs if a != b]
    assignment = spark.createDataFrame([(i, 2 if i < 4 else 5) for i in range(1, 7)], "node_id long, cluster_id long")
    assert graph.modularity(assignment, edges(spark, clique([1, 2, 3]) + clique([4, 5, 6]))).first().modularity == pytest.approx(2 / 3, abs=1e-6)


def test_reachability_with_a_cycle_and_depths(spark):
    arcs = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    seeds = spark.createDataFrame([(1,)], "seed long")
    got = {(r.node_id, r.hops) for r in graph.reachable(arcs, seeds, 3).collect()}
    assert got == {(2, 1), (3, 2), (1, 3), (4, 3)}
    assert {r.node_id for r in graph.reachable(arcs, seeds, 0).collect()} == {2}


def test_paths_are_whole_and_ids_do_not_match_by_substring(spark):
    arcs = edges(spark, [(12, 1), (1, 5), (12, 7), (7, 8), (8, 5)])
    pairs = spark.createDataFrame([(12, 5), (5, 12)], "seed long, goal long")
    got = graph.paths(arcs, pairs, 5)
    assert [(r.src, r.dst) for r in got.orderBy("seq").collect()] == [(12, 1), (1, 5)]
    assert [tuple(r) for r in graph.last_edges(got).collect()] == [(12, 5, 1, 5)]


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node_id: r.component for r in graph.components(edges(spark, pairs)).collect()}
    assert got == {x: find(x) for x in root}


def test_boundaries(spark):
    files = spark.createDataFrame([(1, "src/api/users"), (2, "src/db/user_repo"), (3, "src/db/shared.rs")], "node_id long, file_path string")
    rule = {"from": "src/api/**", "deny": ["src/db/**"]}
    arcs = edges(spark, [(1, 2), (1, 3)])
    assert {r.to_path for r in graph.check_boundaries(arcs, files, [rule]).collect()} == {"src/db/user_repo", "src/db/shared.rs"}
    assert {r.to_path for r in graph.check_boundaries(arcs, files, [rule | {"allow": ["src/db/shared.rs"]}]).collect()} == {"src/db/user_repo"}
    assert graph.check_boundaries(arcs, files, []).count() == 0
    assert graph.load_rules('[[rules]]\nfrom = "a/**"\ndeny = ["b/**"]') == [{"from": "a/**", "deny": ["b/**"]}]


def test_wiki_is_deterministic():
    page = graph.render_wiki([(2, "b"), (2, "a"), (1, "c")], 0.5)
    assert page.index("Cluster 1") < page.index("Cluster 2") and "Modularity: 0.5000" in page
