"""Traversal, paths, PageRank, communities and boundaries over edges as DataFrames.

Iterative operators keep their state in DataFrames and write it to the shared folder every round;
nothing that grows with the graph is collected.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import places
from quarry.session import cut_lineage


def dependency_edges(edges: DataFrame, kinds: tuple[str, ...] = ("imports", "calls", "references", "depends_on")) -> DataFrame:
    """(project_id, src, dst), one row an edge and kind."""
    return edges.where(F.col("kind").isin(*kinds)).select("project_id", F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"))


# --- traversal -------------------------------------------------------------------------------------------

def reachable(edges: DataFrame, seeds: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(seed, node_id, hops): the nodes within 1 to max(1, depth) hops of each seed, by the least number of hops.

    ``edges`` has (src, dst), ``seeds`` has (seed). A seed is reached itself only along a cycle. A level joins
    only the pairs first reached in the one before, so walks never multiply.
    """
    here, there = ("dst", "src") if backward else ("src", "dst")
    steps = edges.select(F.col(here).alias("at"), F.col(there).alias("to")).distinct()
    frontier = seeds.select("seed", F.col("seed").alias("at")).distinct()
    seen: DataFrame | None = None
    for hop in range(1, max(1, depth) + 1):
        found = frontier.join(steps, "at").select("seed", F.col("to").alias("node_id")).distinct()
        new = found if seen is None else found.join(seen, ["seed", "node_id"], "left_anti")
        new = cut_lineage(new.withColumn("hops", F.lit(hop)))
        seen = new if seen is None else seen.unionByName(new)
        if hop == max(1, depth) or new.isEmpty():
            break
        frontier = new.select("seed", F.col("node_id").alias("at"))
    return seen


def callers(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node_id, hops) of the nodes that call the seeds, directly or through others."""
    return reachable(dependency_edges(edges, ("calls",)), seeds, depth, backward=True)


def callees(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node_id, hops) of the nodes the seeds call, directly or through others."""
    return reachable(dependency_edges(edges, ("calls",)), seeds, depth)


def impact(edges: DataFrame, nodes: DataFrame, ranks: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Per seed: direct and transitive callers, their files with the seed's own, and a risk level.

    ``total_symbols`` is direct plus transitive, which counts direct callers twice; ``distinct_symbols`` does not.
    """
    found = callers(edges, seeds, depth)
    paths = nodes.select(F.col("id").alias("node_id"), "file_path").distinct()
    located = found.join(paths, "node_id").unionByName(seeds.select(F.col("seed").alias("node_id"), "seed", F.lit(0).alias("hops")).join(paths, "node_id"))
    summed = located.groupBy("seed").agg(F.count_if(F.col("hops") == 1).alias("direct"), F.count_if(F.col("hops") >= 1).alias("distinct_symbols"), F.countDistinct("file_path").alias("files"))
    ranked = summed.join(ranks.select(F.col("node_id").alias("seed"), "pagerank"), "seed", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    transitive = F.col("distinct_symbols") if depth > 1 else F.lit(0)
    level = F.when((F.col("pagerank") > 0.05) | (F.col("direct") > 10), "high").when((F.col("pagerank") > 0.01) | (F.col("direct") > 3), "medium").otherwise("low")
    return ranked.select("seed", "direct", "distinct_symbols", (F.col("direct") + transitive).alias("total_symbols"), "files", level.alias("risk"))


def paths(edges: DataFrame, pairs: DataFrame, depth: int = 10) -> DataFrame:
    """(seed, goal, seq, src, dst): the edges of a shortest path from each seed to its goal, in order.

    ``pairs`` has (seed, goal), ``edges`` (src, dst). Of equally short paths that through the least node ids,
    seen from the goal backwards, is given. Pairs without a path of at most ``depth`` edges give no rows.
    """
    steps = edges.select("src", "dst").distinct()
    goals = pairs.select("seed", "goal").distinct()
    levels: list[DataFrame] = []
    frontier = goals.select("seed", F.col("seed").alias("src")).distinct()
    reached = frontier.withColumnRenamed("src", "dst")
    for hop in range(1, depth + 1):
        found = frontier.join(steps, "src").groupBy("seed", "dst").agg(F.min("src").alias("src"))
        new = cut_lineage(found.join(reached, ["seed", "dst"], "left_anti").withColumn("hop", F.lit(hop)))
        levels.append(new)
        if hop == depth or new.isEmpty():
            break
        reached = reached.unionByName(new.select("seed", "dst"))
        frontier = new.select("seed", F.col("dst").alias("src"))
    at = goals.where("seed <> goal").select("seed", "goal", F.col("goal").alias("dst"))
    out: DataFrame | None = None
    for level in reversed(levels):
        used = at.join(level, ["seed", "dst"])
        used = cut_lineage(used.select("seed", "goal", F.col("hop").alias("seq"), "src", "dst"))
        out = used if out is None else out.unionByName(used)
        rest = at.join(used.select("seed", "goal", "dst"), ["seed", "goal", "dst"], "left_anti")
        at = rest.unionByName(used.select("seed", "goal", F.col("src").alias("dst")).where("seed <> dst"))
    return out


def last_edges(path: DataFrame) -> DataFrame:
    """(seed, goal, src, dst) of the last edge of each path."""
    last = path.groupBy("seed", "goal").agg(F.max_by(F.struct("src", "dst"), "seq").alias("e"))
    return last.select("seed", "goal", "e.src", "e.dst")


# --- PageRank --------------------------------------------------------------------------------------------

def _rank_project(pdf: pd.DataFrame, damping: float, iterations: int, epsilon: float) -> pd.DataFrame:
    """The ranks of one project held in a task: rows without ``dst`` are its nodes (``was`` their former rank), the rest its arcs."""
    is_node = pdf["dst"].isna().to_numpy()
    own = pdf[is_node].sort_values("src")
    ids = own["src"].to_numpy()
    src, dst = pdf["src"].to_numpy()[~is_node], pdf["dst"].to_numpy()[~is_node].astype(np.int64)
    at, to = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    n, out = len(ids), np.bincount(at, minlength=len(ids))
    ranks = own["was"].fillna(1.0 / n).to_numpy(float)
    for _ in range(iterations):
        got = np.bincount(to, weights=ranks[at] / out[at], minlength=n) if len(at) else np.zeros(n)
        new = (1 - damping) / n + damping * (got + ranks[out == 0].sum() / n)
        moved, ranks = np.abs(new - ranks).sum(), new
        if moved < epsilon:
            break
    return pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "node_id": ids, "pagerank": ranks})


def _rank_distributed(members: DataFrame, arcs: DataFrame, damping: float, iterations: int, epsilon: float) -> DataFrame:
    """As ``_rank_project`` for projects of any size: one join and aggregation a round, projects that have settled stay."""
    sizes = members.groupBy("project_id").agg(F.count("*").alias("n"))
    degree = arcs.groupBy("src").agg(F.count("*").alias("out"))
    shares = cut_lineage(arcs.join(degree, "src").groupBy("src", "dst").agg((F.count("*") / F.first("out")).alias("share")))
    base = members.join(sizes, "project_id").join(degree.withColumnRenamed("src", "node_id"), "node_id", "left")
    state = cut_lineage(base.select("project_id", "node_id", "n", F.col("out").isNull().alias("sink"), F.coalesce("was", 1 / F.col("n")).alias("pagerank"), F.lit(float("inf")).alias("moved")))
    for number in range(iterations):
        lost = state.groupBy("project_id").agg(F.sum(F.when(F.col("sink"), F.col("pagerank")).otherwise(0.0)).alias("lost"), (F.sum("moved") >= epsilon).alias("going"))
        if number and not lost.agg(F.max("going")).first()[0]:
            break
        got = state.select(F.col("node_id").alias("src"), "pagerank").join(shares, "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        value = F.when(F.col("going"), (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).otherwise(F.col("pagerank"))
        both = state.join(got, "node_id", "left").join(lost, "project_id")
        state = cut_lineage(both.select("project_id", "node_id", "n", "sink", value.alias("pagerank"), F.abs(value - F.col("pagerank")).alias("moved")), instead_of=state)
    return state.select("project_id", "node_id", "pagerank")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 30, epsilon: float = 1e-5, previous: DataFrame | None = None, task_rows: int = 1_000_000) -> DataFrame:
    """(project_id, node_id, pagerank) of every project; parallel edges count, sinks spread evenly over their project.

    ``nodes`` has (project_id, node_id), ``edges`` (project_id, src, dst); edges to nodes outside their project do
    not count. A warm start takes ``previous`` ranks where they exist. A project stops once its ranks move by less
    than ``epsilon`` in sum, or after ``iterations``. Projects of at most ``task_rows`` nodes and arcs are iterated
    in one task each, larger ones in distributed rounds by the same rule.
    """
    members = nodes.select("project_id", "node_id").distinct()
    inside = members.select("project_id", F.col("node_id").alias("src"))
    arcs = edges.select("project_id", "src", "dst").join(inside, ["project_id", "src"], "left_semi").join(inside.withColumnRenamed("src", "dst"), ["project_id", "dst"], "left_semi")
    started = members.join(previous.select("node_id", F.col("pagerank").alias("was")).dropDuplicates(["node_id"]), "node_id", "left") if previous is not None else members.withColumn("was", F.lit(None).cast("double"))
    rows = cut_lineage(started.select("project_id", F.col("node_id").alias("src"), F.lit(None).cast("long").alias("dst"), "was").unionByName(arcs.select("project_id", "src", "dst", F.lit(None).cast("double").alias("was"))))
    large = rows.groupBy("project_id").agg(F.count("*").alias("n")).where(F.col("n") > task_rows).select("project_id")
    some_large = not large.isEmpty()
    small = rows.join(large, "project_id", "left_anti") if some_large else rows
    ranks = small.groupBy("project_id").applyInPandas(lambda pdf: _rank_project(pdf, damping, iterations, epsilon), "project_id long, node_id long, pagerank double")
    if some_large:
        rest = rows.join(large, "project_id", "left_semi")
        ranks = ranks.unionByName(_rank_distributed(rest.where("dst is null").select("project_id", F.col("src").alias("node_id"), "was"), rest.where("dst is not null").select("src", "dst"), damping, iterations, epsilon))
    return cut_lineage(ranks)


# --- components and communities --------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node id connected with each node, edges taken undirected.

    Large-star and small-star rounds; each is written to the shared folder.
    """
    arcs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    loops = edges.where("src = dst").select(F.col("src").alias("node_id"))
    arcs = cut_lineage(arcs)
    while True:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = cut_lineage(small.select("e.*").where("u > v").distinct())
        if new.exceptAll(arcs).isEmpty() and arcs.exceptAll(new).isEmpty():
            break
        arcs = new
    roots = arcs.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    tops = arcs.select(F.col("v").alias("node_id"), F.col("v").alias("component")).distinct()
    alone = loops.distinct().join(roots.unionByName(tops), "node_id", "left_anti").select("node_id", F.col("node_id").alias("component"))
    return roots.unionByName(tops).unionByName(alone).dropDuplicates(["node_id"])


def _move_nodes(pdf: pd.DataFrame, sweeps: int, gamma: float) -> pd.DataFrame:
    """Local moves of one connected component, then the connected parts of each community, both in order of node ids."""
    total = float(pdf["m2"].iloc[0])
    near: dict[int, dict[int, float]] = {}
    for a, b, weight in zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True):
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0.0) + weight
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0.0) + weight
    nodes = sorted(near)
    degree = {n: sum(near[n].values()) for n in nodes}
    group = {n: n for n in nodes}
    load = dict(degree)
    for _ in range(sweeps):
        moved = False
        for n in nodes:
            pull: dict[int, float] = {}
            for other, weight in near[n].items():
                pull[group[other]] = pull.get(group[other], 0.0) + weight
            own = group[n]
            best, gain = own, 0.0
            for candidate in sorted(pull):
                if candidate == own:
                    continue
                delta = (pull[candidate] - pull.get(own, 0.0)) / total - gamma * degree[n] * (load[candidate] - load[own] + degree[n]) / (total * total)
                if delta > gain or delta == gain and candidate < best:
                    best, gain = candidate, delta
            if best != own:
                load[own] -= degree[n]
                load[best] = load.get(best, 0.0) + degree[n]
                group[n], moved = best, True
        if not moved:
            break
    part: dict[int, int] = {}
    parts: dict[int, int] = {}
    for n in nodes:
        if n in part:
            continue
        number = parts[group[n]] = parts.get(group[n], -1) + 1
        part[n], todo = number, [n]
        while todo:
            for other in near[todo.pop()]:
                if other not in part and group[other] == group[n]:
                    part[other] = number
                    todo.append(other)
    return pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "node_id": nodes, "community": [group[n] for n in nodes], "part": [part[n] for n in nodes]})


def _ranked(members: DataFrame) -> DataFrame:
    """(project_id, node_id, rank): the place, from 1, of each node in its project's order of ids."""
    return places(members, "project_id", F.col("node_id")).withColumnRenamed("place", "rank")


#: Places of one project's order that share a bucket of the running loads.
_BUCKET = 50_000


def _loads_at(asked: DataFrame, moves: DataFrame) -> DataFrame:
    """``asked`` (node_id, rank, community, ...) with ``change``: what the moves of nodes of lower rank add to the community's load.

    Running sums in two steps, over buckets of places and within a bucket, so a community of any size is spread over tasks.
    """
    events = moves.select("rank", "degree", F.explode(F.array(F.struct(F.col("was").alias("community"), F.lit(-1.0).alias("sign")), F.struct(F.col("now").alias("community"), F.lit(1.0).alias("sign")))).alias("e")).select("rank", F.col("e.community").alias("community"), (F.col("degree") * F.col("e.sign")).alias("delta"))
    bucket = F.floor(F.col("rank") / _BUCKET)
    totals = events.groupBy("community", bucket.alias("bucket")).agg(F.sum("delta").alias("total"))
    places = asked.select("community", "rank").distinct()
    wanted = places.select("community", bucket.alias("bucket")).distinct()
    upto = Window.partitionBy("community").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.join(totals, ["community", "bucket"], "full").select("community", "bucket", F.coalesce(F.sum("total").over(upto), F.lit(0.0)).alias("carried"))
    within = Window.partitionBy("community", "bucket").orderBy("rank", "kind").rowsBetween(Window.unboundedPreceding, 0)
    mixed = events.select("community", "rank", F.lit(1).alias("kind"), "delta").unionByName(places.select("community", "rank", F.lit(0).alias("kind"), F.lit(0.0).alias("delta"))).withColumn("bucket", bucket)
    local = mixed.withColumn("local", F.sum("delta").over(within)).where("kind = 0").join(carried, ["community", "bucket"])
    return asked.join(local.select("community", "rank", (F.col("local") + F.col("carried")).alias("change")), ["community", "rank"])


def _move_distributed(arcs: DataFrame, sweeps: int, gamma: float) -> DataFrame:
    """As ``_move_nodes``, with the same result, for components too large for one task.

    A sweep moves its nodes in order of rank, each seeing the moves of those before it. All moves of a sweep are
    guessed at once and computed again from the guess until they no longer change: the first node is right after one
    round, and whatever depends only on right nodes in the next, so what stands still is the sweep done in order.
    """
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("src_rank").alias("rank"), F.col("dst").alias("b"), F.col("dst_rank").alias("other_rank")), F.struct(F.col("dst").alias("a"), F.col("dst_rank").alias("rank"), F.col("src").alias("b"), F.col("src_rank").alias("other_rank")))
    both = cut_lineage(arcs.select("project_id", "m2", "weight", F.explode(ways).alias("w")).select("project_id", "m2", "weight", "w.*"))
    state = cut_lineage(both.groupBy("project_id", F.col("a").alias("node_id"), "rank").agg(F.sum("weight").alias("degree"), F.first("m2").alias("m2")).withColumn("community", F.col("node_id")))
    for _ in range(sweeps):
        load = cut_lineage(state.groupBy("community").agg(F.sum("degree").alias("load")))
        guess = cut_lineage(state.select("node_id", "rank", "degree", F.col("community").alias("was"), F.col("community").alias("now")).limit(0))
        while True:
            shown = state.select(F.col("node_id").alias("b"), "community").join(guess.select(F.col("node_id").alias("b"), "now"), "b", "left")
            seen = F.when(F.col("other_rank") < F.col("rank"), F.coalesce("now", "community")).otherwise(F.col("community"))
            near = both.join(shown, "b").groupBy(F.col("a").alias("node_id"), seen.alias("candidate")).agg(F.sum("weight").alias("pull"))
            tried = near.join(state, "node_id")
            home = tried.where("candidate = community").select("node_id", F.col("pull").alias("own_pull"))
            asked = tried.select("node_id", "rank", F.col("candidate").alias("community")).unionByName(state.select("node_id", "rank", "community")).distinct()
            loads = _loads_at(asked, guess).join(load, "community").select("node_id", "community", (F.col("load") + F.col("change")).alias("load"))
            held = tried.where("candidate <> community").join(home, "node_id", "left").join(loads, ["node_id", "community"])
            held = held.join(loads.select("node_id", F.col("community").alias("candidate"), F.col("load").alias("other")), ["node_id", "candidate"])
            delta = (F.col("pull") - F.coalesce("own_pull", F.lit(0.0))) / F.col("m2") - F.lit(gamma) * F.col("degree") * (F.col("other") - F.col("load") + F.col("degree")) / (F.col("m2") * F.col("m2"))
            better = held.withColumn("delta", delta).where((F.col("delta") > 0) | (F.col("delta") == 0) & (F.col("candidate") < F.col("community")))
            best = better.groupBy("node_id", "rank", "degree", F.col("community").alias("was")).agg(F.min(F.struct(-F.col("delta"), F.col("candidate")))["candidate"].alias("now"))
            fresh = cut_lineage(best)
            same = fresh.select("node_id", "now").exceptAll(guess.select("node_id", "now")).isEmpty() and guess.select("node_id", "now").exceptAll(fresh.select("node_id", "now")).isEmpty()
            guess = fresh
            if same:
                break
        if guess.isEmpty():
            break
        state = cut_lineage(state.join(guess.select("node_id", "now"), "node_id", "left").withColumn("community", F.coalesce("now", "community")).drop("now"), instead_of=state)
    a, b = state.select(F.col("node_id").alias("src"), F.col("community").alias("ca")), state.select(F.col("node_id").alias("dst"), F.col("community").alias("cb"))
    inner = arcs.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst")
    whole = state.join(components(inner), "node_id", "left").select("project_id", "node_id", "community", F.coalesce("component", "node_id").alias("component"))
    order = Window.partitionBy("project_id", "community").orderBy("component")
    parts = whole.select("project_id", "community", "component").distinct().withColumn("part", (F.row_number().over(order) - 1).cast("int"))
    return whole.join(parts, ["project_id", "community", "component"]).select("project_id", "node_id", "community", "part")


def communities(nodes: DataFrame, edges: DataFrame, sweeps: int = 50, gamma: float = 1.0, smallest: int = 2, task_arcs: int = 1_000_000) -> DataFrame:
    """(project_id, node_id, cluster_id) of every project: local moves by modularity, disconnected communities split.

    Moves depend only on a node's connected component and its project's total weight, so components are
    handled apart, with results equal to those of the whole. Communities below ``smallest`` and isolated
    nodes get cluster 0; a project without edges keeps one cluster a node. A component of up to ``task_arcs``
    pairs is one task; larger ones move in distributed rounds that give the same result.
    """
    members = nodes.select("project_id", "node_id").distinct()
    ranked = cut_lineage(_ranked(members))
    arcs = edges.where("src <> dst").select("project_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).groupBy("project_id", "src", "dst").agg(F.count("*").cast("double").alias("weight"))
    a, b = ranked.select("project_id", F.col("node_id").alias("src"), F.col("rank").alias("src_rank")), ranked.select("project_id", F.col("node_id").alias("dst"), F.col("rank").alias("dst_rank"))
    arcs = cut_lineage(arcs.join(a, ["project_id", "src"]).join(b, ["project_id", "dst"]))
    total = arcs.groupBy("project_id").agg((2 * F.sum("weight")).alias("m2"))
    located = cut_lineage(arcs.join(total, "project_id").join(components(arcs).withColumnRenamed("node_id", "src"), "src"))
    large = cut_lineage(located.groupBy("project_id", "component").agg(F.count("*").alias("n")).where(F.col("n") > task_arcs).drop("n"))
    grouped = located.join(large, ["project_id", "component"], "left_anti").groupBy("project_id", "component").applyInPandas(lambda pdf: _move_nodes(pdf, sweeps, gamma), "project_id long, node_id long, community long, part int")
    if not large.isEmpty():
        grouped = grouped.unionByName(_move_distributed(located.join(large, ["project_id", "component"], "left_semi"), sweeps, gamma))
    # A community is named by a node; from here on by that node's rank.
    moved = cut_lineage(grouped.join(ranked.select("project_id", F.col("node_id").alias("community"), "rank"), ["project_id", "community"]).select("project_id", "node_id", F.col("rank").alias("community"), "part"))
    # Later parts of a community get fresh ids after all others, in order of community and part.
    fresh = moved.where("part > 0").select("project_id", "community", "part").distinct()
    numbered = fresh.withColumn("fresh", F.row_number().over(Window.partitionBy("project_id").orderBy("community", "part")))
    top = ranked.groupBy("project_id").agg(F.max("rank").alias("top"))
    named = moved.join(numbered, ["project_id", "community", "part"], "left").join(top, "project_id")
    named = named.select("project_id", "node_id", F.when(F.col("part") == 0, F.col("community")).otherwise(F.col("top") + F.col("fresh")).alias("cluster_id"))
    small = named.groupBy("project_id", "cluster_id").agg(F.count("*").alias("n")).where(F.col("n") < smallest)
    folded = named.join(small, ["project_id", "cluster_id"], "left").select("project_id", "node_id", F.when(F.col("n").isNull(), F.col("cluster_id")).otherwise(F.lit(0)).alias("cluster_id"))
    alone = ranked.join(folded.select("node_id"), "node_id", "left_anti").join(total, "project_id", "left")
    return folded.unionByName(alone.select("project_id", "node_id", F.when(F.col("m2").isNull(), F.col("rank")).otherwise(F.lit(0)).alias("cluster_id")))


def file_clusters(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, file_path, cluster_id): each file has the cluster of its node of the greatest id."""
    located = clusters.join(nodes.select(F.col("id").alias("node_id"), "file_path"), "node_id").where("file_path is not null")
    return located.groupBy("project_id", "file_path").agg(F.max_by("cluster_id", "node_id").alias("cluster_id"))


def modularity(assignment: DataFrame, edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(project_id, modularity): sum over adjacent pairs of one cluster of (w - k_i k_j / 2m) / 2m, loops and unassigned ends left out.

    ``assignment`` has (node_id, cluster_id), ``edges`` (project_id, src, dst).
    """
    both = edges.where("src <> dst").select("project_id", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("project_id", "e.*")
    a = assignment.select(F.col("node_id").alias("src"), F.col("cluster_id").alias("c1"))
    b = assignment.select(F.col("node_id").alias("dst"), F.col("cluster_id").alias("c2"))
    weights = both.join(a, "src").join(b, "dst").groupBy("project_id", "src", "dst", "c1", "c2").agg(F.count("*").cast("double").alias("w"))
    degree = weights.groupBy("src").agg(F.sum("w").alias("k"))
    total = weights.groupBy("project_id").agg(F.sum("w").alias("m2"))
    same = weights.where("c1 = c2").join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("k").alias("k2")), "dst").join(total, "project_id")
    inside = same.groupBy("project_id").agg(F.sum((F.col("w") - gamma * F.col("k") * F.col("k2") / F.col("m2")) / F.col("m2")).alias("q"))
    return total.join(inside, "project_id", "left").select("project_id", F.coalesce("q", F.lit(0.0)).alias("modularity"))


# --- boundaries ------------------------------------------------------------------------------------------

def glob_regex(glob: str) -> str:
    """The regular expression of a path glob: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] in "*?":
            out, k = out + ("[^/]*" if glob[k] == "*" else "[^/]"), k + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return f"^{out}$"


def check_boundaries(edges: DataFrame, files: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_index, from_path, to_path, deny): edges between files that a rule denies and none of its allowances permits.

    ``files`` has (node_id, file_path); ``rules`` are dicts of ``from``, ``deny`` and ``allow`` globs, few by nature,
    and become one predicate each, so the edges are read once and nothing is crossed.
    """
    located = edges.join(files.select(F.col("node_id").alias("src"), F.col("file_path").alias("from_path")), "src").join(files.select(F.col("node_id").alias("dst"), F.col("file_path").alias("to_path")), "dst").select("from_path", "to_path").distinct()
    hits = []
    for index, rule in enumerate(rules):
        allowed = F.lit(False)
        for allow in rule.get("allow", ()):
            allowed |= F.col("to_path").rlike(glob_regex(allow))
        for deny in rule.get("deny", ()):
            broken = F.col("from_path").rlike(glob_regex(rule["from"])) & F.col("to_path").rlike(glob_regex(deny)) & ~allowed
            hits.append(F.when(broken, F.struct(F.lit(index).alias("rule_index"), F.lit(deny).alias("deny"))))
    if not hits:
        return located.limit(0).select(F.lit(0).alias("rule_index"), "from_path", "to_path", F.lit("").alias("deny"))
    return located.select("from_path", "to_path", F.explode(F.array_compact(F.array(*hits))).alias("v")).select("v.rule_index", "from_path", "to_path", "v.deny")


def suggest_boundaries(clusters: DataFrame, base: str = "src/") -> DataFrame:
    """(project_id, cluster_id, prefix): the two-part path prefixes of each cluster's files below ``base``; cluster 0 is left out."""
    inside = clusters.where((F.col("cluster_id") != 0) & F.col("file_path").startswith(base))
    return inside.select("project_id", "cluster_id", F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/").alias("prefix")).distinct()


def load_rules(text: str) -> list[dict]:
    """Boundary rules of a TOML text with ``[[rule]]`` or ``[[rules]]`` tables."""
    import tomllib

    data = tomllib.loads(text)
    return data.get("rules") or data.get("rule") or []


def render_wiki(clusters: list[tuple[int, str]], quality: float, violations: list[str] = (), most_files: int = 20) -> str:
    """A Markdown page of clusters and their files; for reports, so of data already reduced to a page's size."""
    lines = ["# Architecture", "", f"Modularity: {quality:.4f}", ""]
    names: dict[int, list[str]] = {}
    for cluster, path in sorted(clusters):
        names.setdefault(cluster, []).append(path)
    for cluster, files in sorted(names.items()):
        lines += [f"## Cluster {cluster}", ""] + [f"- {p}" for p in files[:most_files]] + ([f"- and {len(files) - most_files} more"] if len(files) > most_files else []) + [""]
    if violations:
        lines += ["## Boundary violations", ""] + [f"- {v}" for v in violations]
    return "\n".join(lines)
