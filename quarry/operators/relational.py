"""Look-ups, searches by name and aggregates over the property graph, for all projects at once."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.model import CALLABLE_KINDS, SYMBOL_KINDS, language_of


def like_pattern(text: str, literal: bool = False) -> str:
    """A contains-pattern; ``%`` and ``_`` of the text act as wildcards unless ``literal``. Backslashes are literal."""
    escaped = text.replace("\\", "\\\\")
    return "%" + (escaped.replace("%", r"\%").replace("_", r"\_") if literal else escaped) + "%"


def by_id(rows: DataFrame, node_id: int) -> DataFrame:
    """The row of one id."""
    return rows.where(F.col("id") == node_id).limit(1)


def nodes_by_file(nodes: DataFrame, file_path: str) -> DataFrame:
    """The nodes of a file by line."""
    return nodes.where(F.col("file_path") == file_path).orderBy("start_line", "id")


def file_structure(nodes: DataFrame, file_path: str) -> DataFrame:
    """The nodes of the file of exactly this path or, if there is none, of files whose path ends with it."""
    path = file_path.replace("\\", "/")
    found = nodes.where(F.lower("file_path").endswith(path.lower())).withColumn("_exact", F.col("file_path") == path)
    return found.withColumn("_any", F.max("_exact").over(Window.partitionBy("project_id"))).where(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any").orderBy("project_id", "start_line", "id")


def name_rank(pattern: str) -> Column:
    """0 exact name, 1 name begins so, 2 qualified name contains it, 3 other."""
    plain = pattern.replace("\\", "\\\\")
    return F.when(F.col("name") == pattern, 0).when(F.col("name").ilike(plain + "%"), 1).when(F.col("qualified_name").ilike("%" + plain + "%"), 2).otherwise(3)


def search_symbol(nodes: DataFrame, pattern: str, limit: int = 20, offset: int = 0, literal: bool = False) -> DataFrame:
    """Nodes whose name or qualified name contains the pattern, best matches first; letter case does not count."""
    like = like_pattern(pattern, literal)
    hits = nodes.where(F.col("name").ilike(like) | F.col("qualified_name").ilike(like))
    return hits.withColumn("match", name_rank(pattern)).orderBy("match", F.col("name").asc_nulls_first(), "id").offset(offset).limit(limit)


def symbol_everywhere(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of any project of this name or with a qualified name that ends with ``::name``, and how many projects have it."""
    suffix = "%::" + name.replace("\\", "\\\\")
    found = nodes.where((F.col("name") == name) | F.col("qualified_name").ilike(suffix))
    projects = found.agg(F.countDistinct("project_id").alias("projects"))
    return found.join(projects)


def shared_names(nodes: DataFrame) -> DataFrame:
    """(name, projects, nodes) of the names that several projects have."""
    return nodes.where("name is not null").groupBy("name").agg(F.countDistinct("project_id").alias("projects"), F.count("*").alias("nodes")).where("projects > 1")


def status(nodes: DataFrame, edges: DataFrame, commits: DataFrame, vectors: DataFrame) -> DataFrame:
    """(metric, value): the sizes of the tables, and how many nodes have no vector."""
    parts = [rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value") for name, rows in (("nodes", nodes), ("edges", edges), ("commits", commits), ("vectors", vectors), ("pending", pending(nodes, vectors)))]
    return functools.reduce(DataFrame.unionByName, parts)


def project_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, metric, value): a count for each kind of node, all nodes, edges and distinct files."""
    per_kind = nodes.groupBy("project_id", F.col("kind").alias("metric")).agg(F.count("*").alias("value"))
    totals = nodes.groupBy("project_id").agg(F.count("*").alias("total_nodes"), F.countDistinct("file_path").alias("files"))
    long = totals.select("project_id", F.explode(F.create_map(F.lit("total_nodes"), "total_nodes", F.lit("files"), "files")).alias("metric", "value"))
    edge_count = edges.groupBy("project_id").agg(F.lit("total_edges").alias("metric"), F.count("*").alias("value"))
    return per_kind.unionByName(long).unionByName(edge_count)


def churn(links: DataFrame) -> DataFrame:
    """(node_id, churn): distinct commits of each node; links must be distinct."""
    return links.groupBy("node_id").agg(F.countDistinct("hash").alias("churn"))


def hotspots(nodes: DataFrame, links: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` symbols of each project with the greatest complexity * (1 + churn); the score is logarithmic in churn."""
    symbols = nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).select("project_id", "id", "name", "kind", "file_path", F.coalesce("complexity", F.lit(1)).alias("complexity"))
    counted = symbols.where("complexity > 0").join(churn(links).withColumnRenamed("node_id", "id"), "id", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    order = Window.partitionBy("project_id").orderBy((F.col("complexity") * (1 + F.col("churn"))).desc(), "id")
    ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("project_id", "rank", "id", "name", "kind", "file_path", "complexity", "churn", (F.col("complexity") * (1 + F.log1p(F.col("churn").cast("double")))).alias("score"))


def technical_debt(nodes: DataFrame, links: DataFrame, limit: int = 50, exact: bool = False) -> DataFrame:
    """Files by debt. By default a symbol's complexity counts once for each of its commits (at least once); ``exact`` counts it once."""
    symbols = nodes.where(F.col("kind").isin(*SYMBOL_KINDS) & F.col("file_path").isNotNull()).select("project_id", "file_path", F.col("id").alias("node_id"), F.coalesce("complexity", F.lit(1)).alias("complexity"))
    counted = symbols.join(churn(links), "node_id", "left")
    weight = F.lit(1) if exact else F.greatest(F.coalesce("churn", F.lit(0)), F.lit(1))
    per_file = counted.groupBy("project_id", "file_path").agg(F.sum(F.col("complexity") * weight).alias("complexity"))
    touched = symbols.join(links.select("node_id", "hash"), "node_id").groupBy("project_id", "file_path").agg(F.countDistinct("hash").alias("churn"))
    both = per_file.join(touched, ["project_id", "file_path"], "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    order = Window.partitionBy("project_id").orderBy((F.col("complexity") * (1 + F.col("churn"))).desc(), "file_path")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("score", F.col("complexity") * (1 + F.log1p(F.col("churn").cast("double"))))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that no call targets, but for those called ``main``."""
    called = edges.where("kind = 'calls'").select(F.col("target_node_id").alias("id"))
    return nodes.where(F.col("kind").isin(*CALLABLE_KINDS) & (F.col("name") != "main")).join(called, "id", "left_anti")


def suggest_tests(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, limit: int = 15) -> DataFrame:
    """Untested functions and methods of complexity above 3 by complexity * (1 + 100 * pagerank), with the reasons."""
    tested = edges.where("kind = 'test_of'").select(F.col("target_node_id").alias("id"))
    dependents = edges.where(F.col("kind").isin("called_by", "referenced_by")).groupBy(F.col("target_node_id").alias("id")).agg(F.count("*").alias("dependents"))
    rows = nodes.where(F.col("kind").isin(*CALLABLE_KINDS) & (F.col("complexity") > 3)).join(tested, "id", "left_anti")
    scored = rows.join(ranks.select(F.col("node_id").alias("id"), "pagerank"), "id", "left").join(dependents, "id", "left")
    scored = scored.withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0))).withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    scored = scored.withColumn("score", F.col("complexity") * (1 + 100 * F.col("pagerank")))
    reasons = F.array_compact(F.array(
        F.when(F.col("complexity") > 10, "high complexity").when(F.col("complexity") > 5, "moderate complexity"), F.when(F.col("pagerank") > 0.05, "architectural hub"),
        F.when(F.col("dependents") > 5, "many dependents"), F.lit("no test coverage"),
    ))
    order = Window.partitionBy("project_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("project_id", "rank", "id", "name", "file_path", "complexity", "pagerank", "dependents", "score", F.array_join(reasons, "; ").alias("reasons"))


# --- co-change -----------------------------------------------------------------------------------------

def change_coupling(nodes: DataFrame, links: DataFrame, min_co_changes: int = 3, max_nodes: int = 50) -> DataFrame:
    """(project_id, source_node_id, target_node_id, co_changes) of file nodes changed together; commits of more nodes do not count."""
    sizes = links.groupBy("project_id", "hash").agg(F.count("*").alias("n")).where(F.col("n") > max_nodes)
    small = links.join(sizes, ["project_id", "hash"], "left_anti")
    files = nodes.where("kind = 'file'").select(F.col("id").alias("node_id"))
    kept = small.join(files, "node_id", "left_semi")
    frequent = kept.groupBy("node_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_co_changes)
    kept = kept.join(frequent, "node_id", "left_semi")
    a, b = kept.select("project_id", "hash", F.col("node_id").alias("source_node_id")), kept.select("project_id", "hash", F.col("node_id").alias("target_node_id"))
    pairs = a.join(b, ["project_id", "hash"]).where("source_node_id < target_node_id")
    return pairs.groupBy("project_id", "source_node_id", "target_node_id").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= min_co_changes)


def coupled_nodes(coupling: DataFrame) -> DataFrame:
    """(node_id, neighbour_id, co_changes) in both directions, the greater weight of a neighbour listed twice."""
    one = coupling.select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("neighbour_id"), "co_changes")
    two = coupling.select(F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("neighbour_id"), "co_changes")
    return one.unionByName(two).groupBy("node_id", "neighbour_id").agg(F.max("co_changes").alias("co_changes"))


def coupling_strength(coupling: DataFrame) -> DataFrame:
    """(node_id, couplings, strength, max_co_changes): number, sum and greatest weight of a node's couplings."""
    return coupled_nodes(coupling).groupBy("node_id").agg(F.count("*").alias("couplings"), F.sum("co_changes").alias("strength"), F.max("co_changes").alias("max_co_changes"))


# --- architecture ----------------------------------------------------------------------------------------

def languages(nodes: DataFrame) -> DataFrame:
    """(project_id, language, files) of the file nodes by extension."""
    files = nodes.where("kind = 'file'").withColumn("language", language_of(F.col("file_path"))).where("language is not null")
    return files.groupBy("project_id", "language").agg(F.countDistinct("file_path").alias("files"))


def entry_points(nodes: DataFrame) -> DataFrame:
    """(project_id, file_path) of files that hold ``main`` or are named like an entry point."""
    named = F.col("file_path").rlike(r"(?i)/(main\.rs|index\.(ts|js)|app\.py|server\.(ts|js))$")
    return nodes.where((F.col("name") == "main") | named).select("project_id", "file_path").distinct()


def complex_files(nodes: DataFrame, limit: int = 5) -> DataFrame:
    """The files of each project with the greatest sum of complexity, and how many symbols they hold."""
    summed = nodes.where("complexity is not null and file_path is not null").groupBy("project_id", "file_path").agg(F.sum("complexity").alias("complexity"), F.count("*").alias("symbols"))
    order = Window.partitionBy("project_id").orderBy(F.col("complexity").desc(), "file_path")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def test_split(nodes: DataFrame) -> DataFrame:
    """(project_id, test_files, other_files): files whose path has ``test`` or ``spec`` in it, and the rest."""
    files = nodes.where("kind = 'file'").select("project_id", "file_path").distinct()
    is_test = F.col("file_path").rlike("(?i)test|spec")
    return files.groupBy("project_id").agg(F.count_if(is_test).alias("test_files"), F.count_if(~is_test).alias("other_files"))


def is_test_file(path: Column) -> Column:
    """Whether a path is that of a test by name or folder."""
    return path.rlike(r"(^|/)(test_[^/]*\.py|[^/]*_test\.(py|go|rs)|[^/]*\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)|[^/]*Tests?\.(java|cs|php))$") | path.rlike(r"(^|/)(tests?|__tests__|spec)/")


def routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Route nodes with the file that handles them, if an edge says which; method and path from the metadata."""
    route = nodes.where("kind = 'route'").select("project_id", F.col("id").alias("route_id"), F.col("name").alias("route"), F.get_json_object("metadata", "$.method").alias("method"), F.get_json_object("metadata", "$.path").alias("path"))
    handles = edges.where("kind = 'handles'").select(F.col("target_node_id").alias("route_id"), "source_node_id")
    files = nodes.select(F.col("id").alias("source_node_id"), F.col("file_path").alias("handler"))
    return route.join(handles, "route_id", "left").join(files, "source_node_id", "left").drop("source_node_id")


def contracts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, tests, test_ids): the tests that cover each node."""
    tests = edges.where("kind = 'test_of'").groupBy(F.col("target_node_id").alias("node_id")).agg(F.count("*").alias("tests"), F.array_join(F.array_sort(F.collect_set("source_node_id")), ",").alias("test_ids"))
    return nodes.select(F.col("id").alias("node_id")).join(tests, "node_id")


def pending(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes without a vector."""
    return nodes.join(vectors.select(F.col("node_id").alias("id")), "id", "left_anti")


def related(edges: DataFrame, nodes: DataFrame, kind: str, outgoing: bool = True) -> DataFrame:
    """(node_id, related_id, name, file_path) along edges of one kind in one direction, for all nodes."""
    here, there = ("source_node_id", "target_node_id") if outgoing else ("target_node_id", "source_node_id")
    ends = edges.where(F.col("kind") == kind).select(F.col(here).alias("node_id"), F.col(there).alias("related_id")).distinct()
    return ends.join(nodes.select(F.col("id").alias("related_id"), "name", "file_path"), "related_id")


# --- time ------------------------------------------------------------------------------------------------

def recent(changes: DataFrame, time: str, hours: int, limit: int | None = 200, as_of: str | None = None) -> DataFrame:
    """Rows of the last hours before ``as_of`` (a timestamp literal; the latest row's time if None), newest first."""
    now = F.lit(as_of).cast("timestamp") if as_of else None
    rows = changes if now is not None else changes.join(changes.agg(F.max(time).alias("_now")))
    kept = rows.where(F.col(time) >= (now if now is not None else F.col("_now")) - F.expr(f"interval {int(hours)} hours")).drop("_now")
    ordered = kept.orderBy(F.col(time).desc())
    return ordered.limit(limit) if limit else ordered


def working_set(access: DataFrame, hours: int = 24, limit: int = 30) -> DataFrame:
    """(node_id, accesses, last_access, score) of the nodes accessed in the last hours, by accesses / (1 + age in hours)."""
    seen = access.groupBy("node_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))
    timed = seen.join(access.agg(F.max("ts").alias("now")))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_access").cast("timestamp"))) / 3.6e9
    scored = timed.where(age <= hours).select("node_id", "accesses", "last_access", (F.col("accesses") / (1 + age)).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), "node_id").limit(limit)


def decay_scores(access: DataFrame, scale_seconds: float = 3600.0) -> DataFrame:
    """(node_id, score) with score exp(-age / scale) * ln(1 + accesses)."""
    seen = access.groupBy("node_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access")).join(access.agg(F.max("ts").alias("now")))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_access").cast("timestamp"))) / 1e6
    return seen.select("node_id", (F.exp(-age / scale_seconds) * F.log1p(F.col("accesses").cast("double"))).alias("score"))


def search_notes(notes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Notes whose content or tags contain the query, the most and last accessed first."""
    like = like_pattern(query)
    return notes.where(F.col("content").ilike(like) | F.col("tags").ilike(like)).orderBy(F.col("access_count").desc(), F.col("last_accessed").desc(), "id").limit(limit)


# --- history ---------------------------------------------------------------------------------------------

def node_history(links: DataFrame, commits: DataFrame, limit: int = 50) -> DataFrame:
    """(node_id, hash, intent_kind, author, committed_at, rank): the latest commits of every node."""
    joined = links.select("node_id", "hash").join(commits.select("hash", "intent_kind", "author", "message", "committed_at").dropDuplicates(["hash"]), "hash")
    order = Window.partitionBy("node_id").orderBy(F.col("committed_at").desc(), "hash")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def intent_breakdown(history: DataFrame) -> DataFrame:
    """Per node: commits by intent, the first and the last of the listed history."""
    counts = [F.count_if(F.col("intent_kind") == k).alias(k) for k in ("feat", "fix", "refactor", "perf")]
    other = F.count_if(~F.coalesce(F.col("intent_kind"), F.lit("")).isin("feat", "fix", "refactor", "perf")).alias("other")
    return history.groupBy("node_id").agg(F.count("*").alias("commits"), *counts, other, F.max_by("hash", F.struct(F.col("rank"))).alias("first_hash"), F.min_by("hash", F.struct(F.col("rank"))).alias("last_hash"))


# Beginnings of a commit message's first line, by the kind of commit, in order.
COMMIT_PREFIXES = {
    "feat": ("feat", "add ", "implement"), "fix": ("fix", "bug", "patch"), "refactor": ("refactor", "rename", "restructure"), "test": ("test", "spec"),
    "perf": ("perf", "optim", "speed"), "docs": ("doc", "readme"), "chore": ("chore", "ci", "build"),
}


def commit_kind(message: Column) -> Column:
    """The kind of a commit by the beginning of its message's first line, else ``other``."""
    line = F.lower(F.element_at(F.split(message, "\n"), 1))
    out = F
    for kind, beginnings in COMMIT_PREFIXES.items():
        out = out.when(line.rlike("^(" + "|".join(beginnings) + ")"), kind)
    return out.otherwise("other")
