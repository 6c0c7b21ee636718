"""Change risk: features of every node, the score, intent, confidence and a safe order of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import places

# Keywords of a change's intent and the share of coupling risk it keeps, in order of precedence.
INTENTS = {
    "documentation": (0.15, ("doc", "document", "comment", "readme", "typo", "spelling", "javadoc", "markdown", "wiki")),
    "logging": (0.25, ("log", "logging", "logger", "trace", "debug print", "println", "console.log", "slog", "tracing")),
    "formatting": (0.10, ("format", "fmt", "indent", "whitespace", "lint", "clippy", "prettier", "style", "import order", "sort import")),
    "refactor": (0.6, ("refactor", "rename", "extract", "move", "restructure", "reorganize", "cleanup", "clean up", "modularize")),
    "feature": (1.0, ("add", "implement", "feature", "support", "introduce", "new", "enable", "create")),
    "bugfix": (1.0, ("fix", "bug", "broken", "crash", "regression", "incorrect", "wrong", "error", "panic", "patch")),
    "security": (1.0, ("security", "vulnerab", "auth", "inject", "xss", "csrf", "secret", "token", "password", "cve", "sanitiz")),
    "performance": (1.0, ("performance", "perf", "optimize", "speed", "latency", "slow", "cache", "memory", "throughput", "alloc")),
}

# Strategies that are false alarms where the stated intent of a change is of a category.
PRUNED = {
    "documentation": ("account_change_coupling", "add_test_contract", "add_self_test", "interface_segregation", "extract_interface", "isolate_call_chain"),
    "logging": ("account_change_coupling", "add_test_contract", "add_self_test"),
    "formatting": ("account_change_coupling", "add_test_contract", "add_self_test", "interface_segregation", "extract_interface", "divide_and_conquer", "refactor_hotspot", "partition_changes", "isolate_call_chain"),
    "refactor": ("add_test_contract", "add_self_test"),
}


def intent(text: Column) -> Column:
    """(intent, confidence, multiplier): the category with the most of its keywords in the text; the first of equals."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array(*[sum((low.contains(w).cast("int") for w in words), F.lit(0)) for _, words in INTENTS.values()])
    names, shares = F.array(*[F.lit(n) for n in INTENTS]), F.array(*[F.lit(m) for m, _ in INTENTS.values()])

    def judged(h: Column) -> Column:
        best, total = F.array_max(h), F.aggregate(h, F.lit(0), lambda s, v: s + v)
        place = F.array_position(h, best).cast("int")
        return F.struct(
            F.when(best > 0, F.element_at(names, place)).otherwise("unknown").alias("intent"), F.coalesce(F.try_divide(best, total), F.lit(0.0)).alias("confidence"),
            F.when(best > 0, F.element_at(shares, place)).otherwise(F.lit(1.0)).alias("multiplier"),
        )

    # The counts are bound once, as the one element of an array.
    return F.element_at(F.transform(F.array(hits), judged), 1)


def node_features(nodes: DataFrame, edges: DataFrame, links: DataFrame, ranks: DataFrame, coupling: DataFrame) -> DataFrame:
    """One row a node: pagerank, files and untested nodes among its callers within two hops, churn, complexity, coupling.

    Callers are found for all nodes at once by two joins on the call edges; the second hop starts from distinct
    pairs of the first. ``coupling`` has (node_id, couplings, strength, max_co_changes); functions and methods have the
    coupling of their file's node, if there is one.
    """
    calls = edges.where("kind = 'calls'").select(F.col("source_node_id").alias("caller"), F.col("target_node_id").alias("node_id")).distinct()
    second = calls.select("node_id", F.col("caller").alias("middle")).join(calls.select(F.col("node_id").alias("middle"), "caller"), "middle").select("caller", "node_id")
    within = calls.select("caller", "node_id").unionByName(second).distinct()
    tested = edges.where("kind = 'test_of'").select(F.col("target_node_id").alias("caller"), F.lit(True).alias("tested")).distinct()
    paths = nodes.select(F.col("id").alias("caller"), F.col("file_path").alias("caller_path"))
    around = within.join(paths, "caller").join(tested, "caller", "left").groupBy("node_id").agg(F.countDistinct("caller_path").alias("blast_radius_files"), F.count_if(F.col("tested").isNull()).alias("untested_dependents"))
    churned = links.groupBy("node_id").agg(F.countDistinct("hash").alias("git_churn"))
    own = tested.select(F.col("caller").alias("node_id"), F.lit(True).alias("self_tested"))
    rows = nodes.select("project_id", F.col("id").alias("node_id"), "kind", "name", "file_path", F.coalesce("complexity", F.lit(1)).alias("complexity"))
    files = nodes.where("kind = 'file'").groupBy("project_id", "file_path").agg(F.min("id").alias("_file"))
    rows = rows.join(files, ["project_id", "file_path"], "left").withColumn("_coupled", F.when(F.col("kind").isin("function", "method"), F.coalesce("_file", "node_id")).otherwise(F.col("node_id")))
    rows = rows.join(coupling.select(F.col("node_id").alias("_coupled"), F.col("strength").alias("change_coupling_count")), "_coupled", "left").drop("_coupled", "_file")
    for part in (ranks.select("node_id", "pagerank"), around, churned, own):
        rows = rows.join(part, "node_id", "left")
    zero = {"pagerank": 0.0, "blast_radius_files": 0, "untested_dependents": 0, "git_churn": 0, "change_coupling_count": 0, "self_tested": False}
    return rows.fillna(zero)


def baselines(nodes: DataFrame, ranks: DataFrame, coupling: DataFrame) -> DataFrame:
    """Per project: greatest pagerank and complexity, file nodes, greatest co-change, and the pagerank at 80 % of the falling order."""
    files = F.countDistinct(F.when(F.col("kind") == "file", F.col("file_path")))
    shape = nodes.groupBy("project_id").agg(F.greatest(F.max("complexity"), F.lit(1)).alias("max_complexity"), F.greatest(files, F.lit(1)).alias("total_files"))
    sizes = ranks.groupBy("project_id").agg(F.count("*").alias("n"))
    placed = places(ranks.select("project_id", "node_id", "pagerank"), "project_id", F.col("pagerank").desc(), F.col("node_id"))
    at = placed.join(sizes, "project_id").where(F.col("place") == F.floor(F.col("n") * 0.8) + 1).select("project_id", F.greatest("pagerank", F.lit(0.001)).alias("pagerank_percentile_80"))
    top = ranks.groupBy("project_id").agg(F.greatest(F.max("pagerank"), F.lit(0.001)).alias("max_pagerank")).join(at, "project_id", "left")
    most = coupling.groupBy("project_id").agg(F.max("co_changes").alias("max_co_changes"))
    joined = shape.join(top, "project_id", "left").join(most, "project_id", "left")
    return joined.fillna({"max_pagerank": 0.001, "pagerank_percentile_80": 0.05, "max_co_changes": 0})


def risk_score(pagerank: Column, max_pagerank: Column, blast: Column, files: Column, churn: Column, untested: Column, self_tested: Column, complexity: Column, max_complexity: Column, coupling: Column, max_co_changes: Column) -> Column:
    """The weighted risk of a change; the share of untested dependents may exceed 1."""
    one = F.lit(1.0)
    central = F.least(F.log1p(pagerank * 100) / F.log1p(max_pagerank * 100), one)
    ceiling = F.least(F.greatest(files * 0.3, F.lit(5.0)), F.lit(20.0))
    gap = F.when(blast > 0, untested / F.nullif(blast, F.lit(0).cast("long"))).when(self_tested, F.lit(0.0)).otherwise(F.lit(0.5))
    joint = F.when(max_co_changes > 0, F.least(coupling / F.nullif(F.least(max_co_changes.cast("double"), F.lit(20.0)), F.lit(0.0)), one)).otherwise(F.lit(0.0))
    return 0.25 * central + 0.20 * F.least(blast / ceiling, one) + 0.15 * F.least(churn / F.lit(15.0), one) + 0.15 * gap + 0.10 * F.least(complexity / max_complexity, one) + 0.15 * joint


def level(score: Column) -> Column:
    """CRITICAL from 0.7, MEDIUM from 0.4, else LOW."""
    return F.when(score >= 0.7, "CRITICAL").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def node_risk(features: DataFrame, base: DataFrame) -> DataFrame:
    """(project_id, node_id, score, level) of every node of a feature table."""
    c = F.col
    joined = features.join(base, "project_id")
    score = risk_score(c("pagerank"), c("max_pagerank"), c("blast_radius_files"), c("total_files"), c("git_churn"), c("untested_dependents"), c("self_tested"), c("complexity"), c("max_complexity"), c("change_coupling_count"), c("max_co_changes"))
    return joined.select("project_id", "node_id", score.alias("score")).withColumn("level", level(F.col("score")))


def plan_scores(targets: DataFrame) -> DataFrame:
    """(plan_id, targets, score, top_score, level) of stored plans of factors; ceilings are those of the plan itself.

    ``targets`` has the factor columns; nulls count as 0, missing tests as none.
    """
    rows = targets.select("plan_id", "node_id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blast_radius_files", "git_churn", "complexity", "change_coupling_count", "max_co_changes")], F.coalesce(F.size("missing_tests"), F.lit(0)).cast("long").alias("untested")).distinct()
    top = rows.groupBy("plan_id").agg(F.greatest(F.max("pagerank"), F.lit(0.001)).alias("top_pagerank"), F.greatest(F.max("complexity"), F.lit(1).cast("long")).alias("top_complexity"), F.count("*").alias("n"))
    c = F.col
    score = risk_score(c("pagerank"), c("top_pagerank"), c("blast_radius_files"), c("n"), c("git_churn"), c("untested"), F.lit(False), c("complexity"), c("top_complexity"), c("change_coupling_count"), c("max_co_changes"))
    summed = rows.join(top, "plan_id").select("plan_id", score.alias("score")).groupBy("plan_id").agg(F.count("*").alias("targets"), F.avg("score").alias("score"), F.max("score").alias("top_score"))
    return summed.withColumn("level", level(F.col("score")))


def confidence(nodes: DataFrame, commits: DataFrame) -> DataFrame:
    """(project_id, confidence): 1, less 0.3 without commits, less 0.2 without nodes of kind ``test``."""
    tests = nodes.groupBy("project_id").agg(F.max((F.col("kind") == "test").cast("int")).alias("tests"))
    history = commits.select("project_id", F.lit(1).alias("history")).distinct()
    return tests.join(history, "project_id", "left").select("project_id", (1.0 - F.when(F.col("history").isNull(), 0.3).otherwise(0.0) - F.when(F.col("tests") == 1, 0.0).otherwise(0.2)).alias("confidence"))


def strategies(rows: DataFrame, base: DataFrame, interfaces: DataFrame, alternatives: DataFrame, central: DataFrame) -> DataFrame:
    """(project_id, node_id, strategy, delta, priority): what would lower the risk of each node, by rules on its features.

    ``rows`` are features with ``score``; ``interfaces``, ``alternatives`` and ``central`` (callers) have (node_id) of the nodes
    that have any. A node of no name has no interface to extract or extend.
    """
    c = F.col
    joined = rows.join(base, "project_id")
    for part, name in ((interfaces, "_interfaces"), (alternatives, "_alternatives"), (central, "_central")):
        joined = joined.join(part.select("node_id").distinct().withColumn(name, F.lit(True)), "node_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    rank, weight = c("pagerank") / c("max_pagerank"), c("complexity") / c("max_complexity")
    joint = F.when(c("max_co_changes") > 0, F.least(c("change_coupling_count") / F.nullif(F.least(c("max_co_changes").cast("double"), F.lit(20.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    exposed = ((rank > 0.3) | (c("blast_radius_files") > 5)) & c("name").isNotNull()
    churned = F.round(0.15 * F.least(c("git_churn") / 15, F.lit(1.0)) * 0.4, 3)
    untested = F.when(c("blast_radius_files") > 0, F.round(0.2 * c("untested_dependents") / F.nullif(c("blast_radius_files"), F.lit(0).cast("long")), 3)).otherwise(0.0)
    found = [
        ("interface_segregation", exposed & c("_interfaces"), F.lit(0.08)), ("extract_interface", exposed & ~c("_interfaces"), F.lit(0.06)),
        ("add_test_contract", c("untested_dependents") > 0, untested), ("add_self_test", ~c("self_tested") & (c("score") >= 0.4), F.lit(0.1)),
        ("refactor_hotspot", (c("git_churn") > 7) & c("_alternatives"), churned), ("partition_changes", (c("git_churn") > 7) & ~c("_alternatives"), churned),
        ("divide_and_conquer", weight > 0.5, F.round(0.1 * F.least(weight, F.lit(1.0)) / 2, 3)), ("isolate_call_chain", (rank > 0.2) & c("_central"), F.lit(0.07)),
        ("account_change_coupling", F.round(0.15 * joint, 3) > 0, F.round(0.15 * joint, 3)),
    ]
    listed = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("strategy"), delta.cast("double").alias("delta"))) for name, when, delta in found]))
    out = joined.select("project_id", "node_id", F.explode(listed).alias("s")).select("project_id", "node_id", "s.*")
    return out.withColumn("priority", F.when(F.col("delta") >= 0.10, "HIGH").when(F.col("delta") >= 0.05, "MEDIUM").otherwise("LOW"))


def guarded_files(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, least_rank: float = 0.05, least_sources: int = 10) -> DataFrame:
    """(project_id, file_path, pagerank, sources, blocked): the greatest rank in each file and the distinct nodes with edges into it."""
    own = nodes.where("file_path is not null").select("project_id", "file_path", F.col("id").alias("node_id"))
    ranked = own.join(ranks.select("node_id", "pagerank"), "node_id", "left").groupBy("project_id", "file_path").agg(F.coalesce(F.max("pagerank"), F.lit(0.0)).alias("pagerank"))
    into = own.join(edges.select(F.col("target_node_id").alias("node_id"), "source_node_id"), "node_id").groupBy("project_id", "file_path").agg(F.countDistinct("source_node_id").alias("sources"))
    joined = ranked.join(into, ["project_id", "file_path"], "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    return joined.withColumn("blocked", (F.col("pagerank") >= least_rank) | (F.col("sources") >= least_sources))


def alternatives(nodes: DataFrame, limit: int = 5) -> DataFrame:
    """(node_id, alternative_id, rank): other functions named like a node's name without ``_alt``, ``_v2`` and ``_old``, or with one of the first two.

    Nodes of a name below four bytes have none. Of each name only its ``limit`` + 1 least ids can be listed, so names
    are cut to these before they meet.
    """
    rows = nodes.where(F.col("kind").isin("function", "method") & F.col("name").isNotNull()).select("id", "name").distinct()
    base = F.col("name")
    for ending in ("_alt", "_v2", "_old"):
        base = F.regexp_replace(base, f"({ending})+$", "")
    wanted = rows.where(F.octet_length("name") >= 4).select(F.col("id").alias("node_id"), F.explode(F.array(base, F.concat(base, F.lit("_alt")), F.concat(base, F.lit("_v2")))).alias("name"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("_n") <= limit + 1).select(F.col("id").alias("alternative_id"), "name")
    found = wanted.join(first, "name").where("node_id <> alternative_id").select("node_id", "alternative_id").distinct()
    order = Window.partitionBy("node_id").orderBy("alternative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def extraction_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, candidate_id): the functions and methods each node calls directly."""
    rows = nodes.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("candidate_id"))
    return edges.where("kind = 'calls'").select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("candidate_id")).distinct().join(rows, "candidate_id", "left_semi")


def central_callers(edges: DataFrame, ranks: DataFrame, base: DataFrame) -> DataFrame:
    """(node_id, caller_id): direct callers whose rank reaches their project's stored percentile."""
    central = ranks.join(base.select("project_id", "pagerank_percentile_80"), "project_id").where("pagerank >= pagerank_percentile_80").select(F.col("node_id").alias("caller_id"))
    return edges.where("kind = 'calls'").select(F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("caller_id")).distinct().join(central, "caller_id", "left_semi")


def interfaces(edges: DataFrame) -> DataFrame:
    """(node_id, interface_id): what a node, or the node that contains it, implements or extends."""
    up = edges.where(F.col("kind").isin("implements", "extends")).select(F.col("source_node_id").alias("owner"), F.col("target_node_id").alias("interface_id"))
    inside = edges.where("kind = 'contains'").select(F.col("source_node_id").alias("owner"), F.col("target_node_id").alias("node_id"))
    return up.withColumnRenamed("owner", "node_id").unionByName(inside.join(up, "owner").select("node_id", "interface_id")).distinct()


def safe_order(targets: list[tuple[int, float]], depends: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(target, why) of a plan's few targets: those called first, ties by lower risk, a cycle's rest by risk.

    ``depends`` has (caller, called) pairs among the targets.
    """
    risk = dict(targets)
    waits = {t: {b for a, b in depends if a == t and b in risk and b != t} for t in risk}
    out: list[tuple[int, str]] = []
    while waits:
        free = sorted((t for t, w in waits.items() if not w), key=lambda t: (risk[t], t))
        if not free:
            return out + [(t, "part of a dependency cycle") for t in sorted(waits, key=lambda t: (risk[t], t))]
        out.append((free[0], "no remaining dependencies"))
        del waits[free[0]]
        for w in waits.values():
            w.discard(free[0])
    return out
