"""Queries of the core operators over the project tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import canonical_route, content_hash, estimate_tokens
from quarry.operators import graph, model, relational, risk, search, similarity, snapshots
from quarry.plans import pattern
from quarry.sources import extract
from quarry.tables import table

#: The operator's own bounds; the SQL unrolls as many rounds and stops by the same rule.
PAGERANK_ROUNDS, PAGERANK_EPSILON = 30, 1e-5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions shared by the SQL texts: nodes, unique edges, links, commits.
WITH_N = r"""N AS (SELECT DISTINCT id, project_id, replace(file_path, '\', '/') AS file_path, kind, name, qualified_name, complexity, is_exported, start_line, end_line, metadata FROM nodes)"""
WITH_E = """E AS (SELECT project_id, source_node_id, target_node_id, kind, metadata FROM (SELECT *, row_number() OVER (PARTITION BY source_node_id, target_node_id, kind ORDER BY id) AS rn FROM edges) WHERE rn = 1)"""
WITH_L = """L AS (SELECT DISTINCT project_id, lower(commit_hash) AS hash, node_id FROM commit_node_links WHERE commit_hash IS NOT NULL AND node_id IS NOT NULL)"""
WITH_C = """C AS (SELECT DISTINCT id, project_id, lower(hash) AS hash, message, author, committed_at, intent_kind, files_changed FROM git_commits)"""
WITH_COUPLING = """F AS (SELECT DISTINCT id FROM N WHERE kind = 'file'),
big AS (SELECT project_id, hash FROM L GROUP BY ALL HAVING count(*) > 50),
K AS (SELECT L.* FROM L ANTI JOIN big USING (project_id, hash) SEMI JOIN F ON F.id = L.node_id),
P AS (SELECT a.project_id, a.node_id AS source_node_id, b.node_id AS target_node_id, count(*) AS co_changes FROM K a JOIN K b ON a.project_id = b.project_id AND a.hash = b.hash AND a.node_id < b.node_id GROUP BY ALL HAVING count(*) >= 2)"""
RULES = [{"from": "src/**", "deny": ["lib/**", "pkg/**"], "allow": ["lib/util/**"]}, {"from": "**/api/**", "deny": ["**/store/**"]}]


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL where there is one."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    return model.nodes(spark, folder, "id").where("id % 100 = 0").select(F.col("id").alias("seed")).distinct()


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    members = model.nodes(spark, folder, "id", "project_id").select("project_id", F.col("id").alias("node_id"))
    return graph.pagerank(members, graph.dependency_edges(model.edges(spark, folder)), iterations=PAGERANK_ROUNDS, epsilon=PAGERANK_EPSILON)


def _relative(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """Nodes with ``file_path`` below their project's root."""
    roots = projects.select(F.col("id").alias("project_id"), F.rtrim(F.regexp_replace("root_path", r"\\", "/"), F.lit("/")).alias("root"))
    return nodes.join(roots, "project_id", "left").withColumn("file_path", F.when(F.col("file_path").startswith(F.concat("root", F.lit("/"))), F.expr("substring(file_path, length(root) + 2)")).otherwise(F.col("file_path"))).drop("root")


WITH_R = r"""R AS (SELECT id AS project_id, rtrim(replace(root_path, '\', '/'), '/') AS root FROM projects),
M AS (SELECT N.* REPLACE (CASE WHEN starts_with(file_path, root || '/') THEN substr(file_path, length(root) + 2) ELSE file_path END AS file_path) FROM N LEFT JOIN R USING (project_id))"""


def _pagerank_sql(rounds: int) -> str:
    """The rank iteration unrolled; a project that has settled stays."""
    steps = [f"{WITH_E}, V AS (SELECT DISTINCT project_id, id FROM nodes), sz AS (SELECT project_id, count(*) AS n FROM V GROUP BY 1)",
             "A AS (SELECT source_node_id AS src, target_node_id AS dst FROM E WHERE kind IN ('imports', 'calls', 'references', 'depends_on') AND (project_id, source_node_id) IN (SELECT (project_id, id) FROM V) AND (project_id, target_node_id) IN (SELECT (project_id, id) FROM V))",
             "D AS (SELECT src, count(*) AS o FROM A GROUP BY 1), W AS MATERIALIZED (SELECT A.src, dst, count(*) / any_value(o) AS share FROM A JOIN D ON A.src = D.src GROUP BY 1, 2)",
             "r0 AS MATERIALIZED (SELECT V.project_id, V.id, n, o IS NULL AS sink, 1.0::DOUBLE / n AS pr FROM V JOIN sz USING (project_id) LEFT JOIN D ON D.src = V.id)"]
    for k in range(rounds):
        going = f"sum(moved) >= {PAGERANK_EPSILON}" if k else "true"
        value = "0.15 / n + 0.85 * (coalesce(g.got, 0) + l.lost / n)"
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT r.project_id, r.id, n, sink, CASE WHEN go THEN {value} ELSE pr END AS pr, CASE WHEN go THEN abs({value} - pr) ELSE 0 END AS moved FROM r{k} r LEFT JOIN (SELECT dst, sum(pr * share) AS got FROM r{k} JOIN W ON W.src = r{k}.id GROUP BY 1) g ON g.dst = r.id JOIN (SELECT project_id, sum(CASE WHEN sink THEN pr ELSE 0 END) AS lost, {going} AS go FROM r{k} GROUP BY 1) l ON l.project_id = r.project_id)")
    return "WITH " + ",\n".join(steps)


WITH_RANKS = _pagerank_sql(PAGERANK_ROUNDS)

# --- snapshots ------------------------------------------------------------------------------------------

P3_SQL = r"""
WITH l AS (SELECT project_id, snapshot_no, qualified_name, lower(content_hash) AS content_hash, replace(file_path, '\', '/') AS file_path,
             row_number() OVER (PARTITION BY project_id, snapshot_no, qualified_name ORDER BY delivered_at DESC NULLS LAST,
               lower(content_hash) DESC NULLS LAST, replace(file_path, '\', '/') DESC NULLS LAST) AS rn
           FROM node_snapshots WHERE project_id IS NOT NULL AND snapshot_no IS NOT NULL AND qualified_name IS NOT NULL),
s AS (SELECT * FROM l WHERE rn = 1),
d AS (SELECT project_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project_id ORDER BY snapshot_no) AS prev
      FROM (SELECT DISTINCT project_id, snapshot_no FROM snapshot_deliveries WHERE status = 'complete')),
p AS (SELECT * FROM d WHERE prev IS NOT NULL),
n AS (SELECT s.*, p.snapshot_no AS pn FROM s JOIN p ON p.project_id = s.project_id AND p.snapshot_no = s.snapshot_no),
o AS (SELECT s.*, p.snapshot_no AS pn FROM s JOIN p ON p.project_id = s.project_id AND p.prev = s.snapshot_no)
SELECT coalesce(n.project_id, o.project_id) AS project_id, CAST(coalesce(n.pn, o.pn) AS INTEGER) AS snapshot_no,
  coalesce(n.qualified_name, o.qualified_name) AS qualified_name,
  CASE WHEN o.qualified_name IS NULL THEN 'added' WHEN n.qualified_name IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.project_id = o.project_id AND n.pn = o.pn AND n.qualified_name = o.qualified_name
WHERE o.qualified_name IS NULL OR n.qualified_name IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash OR n.file_path IS DISTINCT FROM o.file_path
"""


@query(P3_SQL)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, folder, "node_snapshots"), table(spark, folder, "snapshot_deliveries"))


# --- look-ups and aggregates ------------------------------------------------------------------------------

@query("SELECT id, name, root_path FROM projects ORDER BY name")
def list_projects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "projects").select("id", "name", "root_path").orderBy("name")


@query(f"""WITH {WITH_N}, {WITH_E} SELECT project_id, kind AS metric, count(*) AS value FROM N GROUP BY ALL
UNION ALL SELECT project_id, 'total_nodes', count(*) FROM N GROUP BY ALL UNION ALL SELECT project_id, 'files', count(DISTINCT file_path) FROM N GROUP BY ALL
UNION ALL SELECT project_id, 'total_edges', count(*) FROM E GROUP BY ALL""")
def project_stats(spark: SparkSession, folder: str) -> DataFrame:
    return relational.project_stats(model.nodes(spark, folder), model.edges(spark, folder))


@query(f"""WITH {WITH_N}, {WITH_E}, {WITH_C} SELECT 'nodes' AS metric, count(*) AS value FROM N UNION ALL SELECT 'edges', count(*) FROM E UNION ALL SELECT 'commits', count(*) FROM C
UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'pending', count(*) FROM N WHERE id NOT IN (SELECT vec_id FROM embeddings)""")
def status(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"))
    return relational.status(model.nodes(spark, folder), model.edges(spark, folder), model.commits(spark, folder), vectors)


@query(f"""WITH {WITH_N}, {WITH_L}, s AS (SELECT project_id, id, name, kind, file_path, coalesce(complexity, 1) AS complexity FROM N WHERE kind IN ('function', 'method', 'class', 'struct')),
c AS (SELECT node_id, count(DISTINCT hash) AS churn FROM L GROUP BY 1),
j AS (SELECT s.*, coalesce(churn, 0) AS churn FROM s LEFT JOIN c ON c.node_id = s.id WHERE complexity > 0)
SELECT project_id, CAST(rank AS INTEGER) AS rank, id, name, kind, file_path, complexity, churn, round(complexity * (1 + ln(1 + churn)), 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY complexity * (1 + churn) DESC, id) AS rank FROM j) WHERE rank <= 20""")
def hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return relational.hotspots(model.nodes(spark, folder), model.links(spark, folder)).withColumn("score", F.round("score", 6))


_DEBT = f"""WITH {WITH_N}, {WITH_L}, s AS (SELECT project_id, file_path, id AS node_id, coalesce(complexity, 1) AS complexity FROM N WHERE kind IN ('function', 'method', 'class', 'struct') AND file_path IS NOT NULL),
c AS (SELECT node_id, count(DISTINCT hash) AS churn FROM L GROUP BY 1),
f AS (SELECT project_id, file_path, CAST(sum(complexity * {{weight}}) AS BIGINT) AS complexity FROM s LEFT JOIN c USING (node_id) GROUP BY ALL),
t AS (SELECT project_id, file_path, count(DISTINCT hash) AS churn FROM s JOIN (SELECT node_id, hash FROM L) USING (node_id) GROUP BY ALL),
j AS (SELECT f.*, coalesce(churn, 0) AS churn FROM f LEFT JOIN t USING (project_id, file_path))
SELECT project_id, file_path, complexity, churn, CAST(rank AS INTEGER) AS rank, round(complexity * (1 + ln(1 + churn)), 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY complexity * (1 + churn) DESC, file_path) AS rank FROM j) WHERE rank <= 50"""


@query(_DEBT.format(weight="greatest(coalesce(churn, 0), 1)"))
def technical_debt(spark: SparkSession, folder: str) -> DataFrame:
    return relational.technical_debt(model.nodes(spark, folder), model.links(spark, folder)).withColumn("score", F.round("score", 6))


@query(_DEBT.format(weight="1"))
def technical_debt_exact(spark: SparkSession, folder: str) -> DataFrame:
    return relational.technical_debt(model.nodes(spark, folder), model.links(spark, folder), exact=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {WITH_N}, {WITH_E} SELECT project_id, id, name, file_path, start_line FROM N WHERE kind IN ('function', 'method') AND name <> 'main'
AND NOT EXISTS (SELECT 1 FROM E WHERE E.kind = 'calls' AND E.target_node_id = N.id)""")
def dead_code(spark: SparkSession, folder: str) -> DataFrame:
    return relational.dead_code(model.nodes(spark, folder), model.edges(spark, folder)).select("project_id", "id", "name", "file_path", "start_line")


@query(f"""{WITH_RANKS}, {WITH_N}, c AS (SELECT N.project_id, N.id, name, file_path, complexity, pr AS pagerank, 0::BIGINT AS dependents, complexity * (1 + 100 * pr) AS score FROM N JOIN r{PAGERANK_ROUNDS} r ON r.id = N.id
WHERE N.kind IN ('function', 'method') AND complexity > 3 AND NOT EXISTS (SELECT 1 FROM E WHERE E.kind = 'test_of' AND E.target_node_id = N.id))
SELECT project_id, CAST(rank AS INTEGER) AS rank, id, name, file_path, complexity, round(pagerank, 6) AS pagerank, dependents, round(score, 6) AS score,
concat_ws('; ', CASE WHEN complexity > 10 THEN 'high complexity' WHEN complexity > 5 THEN 'moderate complexity' END, CASE WHEN pagerank > 0.05 THEN 'architectural hub' END, 'no test coverage') AS reasons
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY round(score, 9) DESC, id) AS rank FROM c) WHERE rank <= 15""")
def suggest_tests(spark: SparkSession, folder: str) -> DataFrame:
    found = relational.suggest_tests(model.nodes(spark, folder), model.edges(spark, folder), _ranks(spark, folder))
    return found.withColumn("score", F.round("score", 6)).withColumn("pagerank", F.round("pagerank", 6))


@query(f"WITH {WITH_N}, {WITH_L}, {WITH_COUPLING} SELECT * FROM P")
def change_coupling(spark: SparkSession, folder: str) -> DataFrame:
    return relational.change_coupling(model.nodes(spark, folder), model.links(spark, folder), min_co_changes=2)


@query(f"""WITH {WITH_N}, {WITH_L}, {WITH_COUPLING}, B AS (SELECT source_node_id AS node_id, target_node_id AS other, co_changes FROM P UNION ALL SELECT target_node_id, source_node_id, co_changes FROM P),
U AS (SELECT node_id, other, max(co_changes) AS co_changes FROM B GROUP BY 1, 2)
SELECT node_id, count(*) AS couplings, CAST(sum(co_changes) AS BIGINT) AS strength, max(co_changes) AS max_co_changes FROM U GROUP BY 1""")
def coupling_strength(spark: SparkSession, folder: str) -> DataFrame:
    return relational.coupling_strength(relational.change_coupling(model.nodes(spark, folder), model.links(spark, folder), min_co_changes=2))


def _language_case() -> str:
    cases = " ".join(f"WHEN lower(regexp_extract(file_path, '\\.([A-Za-z0-9+]+)$', 1)) IN ({', '.join(repr(e) for e in es)}) THEN '{name}'" for name, es in model.LANGUAGES.items())
    return f"CASE {cases} END"


@query(f"WITH {WITH_N} SELECT project_id, language, count(DISTINCT file_path) AS files FROM (SELECT *, {_language_case()} AS language FROM N WHERE kind = 'file') WHERE language IS NOT NULL GROUP BY ALL")
def architecture_languages(spark: SparkSession, folder: str) -> DataFrame:
    return relational.languages(model.nodes(spark, folder))


@query(f"WITH {WITH_N} SELECT DISTINCT project_id, file_path FROM N WHERE name = 'main' OR regexp_matches(file_path, '(?i)/(main\\.rs|index\\.(ts|js)|app\\.py|server\\.(ts|js))$')")
def architecture_entry_points(spark: SparkSession, folder: str) -> DataFrame:
    return relational.entry_points(model.nodes(spark, folder))


@query(f"""WITH {WITH_N}, f AS (SELECT project_id, file_path, CAST(sum(complexity) AS BIGINT) AS complexity, count(*) AS symbols FROM N WHERE complexity IS NOT NULL AND file_path IS NOT NULL GROUP BY ALL)
SELECT project_id, file_path, complexity, symbols, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY complexity DESC, file_path) AS rank FROM f) WHERE rank <= 5""")
def architecture_complex_files(spark: SparkSession, folder: str) -> DataFrame:
    return relational.complex_files(model.nodes(spark, folder))


@query(f"""WITH {WITH_N}, f AS (SELECT DISTINCT project_id, file_path FROM N WHERE kind = 'file')
SELECT project_id, count(*) FILTER (regexp_matches(file_path, '(?i)test|spec')) AS test_files, count(*) FILTER (NOT regexp_matches(file_path, '(?i)test|spec')) AS other_files FROM f GROUP BY 1""")
def architecture_test_split(spark: SparkSession, folder: str) -> DataFrame:
    return relational.test_split(model.nodes(spark, folder))


@query(f"""WITH {WITH_N}, {WITH_E} SELECT N.project_id, N.id AS route_id, N.name AS route, N.metadata ->> '$.method' AS method, N.metadata ->> '$.path' AS path, f.file_path AS handler
FROM N LEFT JOIN E ON E.target_node_id = N.id AND E.kind = 'handles' LEFT JOIN N f ON f.id = E.source_node_id WHERE N.kind = 'route'""")
def route_map(spark: SparkSession, folder: str) -> DataFrame:
    return relational.routes(model.nodes(spark, folder), model.edges(spark, folder))


@query(f"""WITH {WITH_N}, {WITH_E}, t AS (SELECT DISTINCT target_node_id, source_node_id FROM E WHERE kind = 'test_of')
SELECT N.id AS node_id, count(*) AS tests, string_agg(source_node_id::VARCHAR, ',' ORDER BY source_node_id) AS test_ids FROM N JOIN t ON t.target_node_id = N.id GROUP BY 1""")
def contracts(spark: SparkSession, folder: str) -> DataFrame:
    return relational.contracts(model.nodes(spark, folder), model.edges(spark, folder))


@query(f"WITH {WITH_N} SELECT project_id, count(*) AS pending FROM N WHERE id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1")
def pending_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"))
    return relational.pending(model.nodes(spark, folder), vectors).groupBy("project_id").agg(F.count("*").alias("pending"))


def _related_sql(kind: str, outgoing: bool) -> str:
    here, there = ("source_node_id", "target_node_id") if outgoing else ("target_node_id", "source_node_id")
    return f"WITH {WITH_N}, {WITH_E} SELECT DISTINCT E.{here} AS node_id, E.{there} AS related_id, N.name, N.file_path FROM E JOIN N ON N.id = E.{there} WHERE E.kind = '{kind}'"


@query(_related_sql("imports", True))
def imports(spark: SparkSession, folder: str) -> DataFrame:
    return relational.related(model.edges(spark, folder), model.nodes(spark, folder), "imports")


@query(_related_sql("calls", False))
def dependents(spark: SparkSession, folder: str) -> DataFrame:
    return relational.related(model.edges(spark, folder), model.nodes(spark, folder), "calls", outgoing=False)


@query(f"""WITH {WITH_N}, h AS (SELECT *, CASE WHEN name = 'render' THEN 0 WHEN name ILIKE 'render%' THEN 1 WHEN qualified_name ILIKE '%render%' THEN 2 ELSE 3 END AS match FROM N WHERE name ILIKE '%render%' OR qualified_name ILIKE '%render%')
SELECT id, project_id, name, CAST(match AS INTEGER) AS match FROM h ORDER BY match, name NULLS FIRST, id LIMIT 20""")
def search_symbol(spark: SparkSession, folder: str) -> DataFrame:
    return relational.search_symbol(model.nodes(spark, folder), "render").select("id", "project_id", "name", "match")


@query(f"""WITH {WITH_N}, f AS (SELECT * FROM N WHERE name = 'render_pattern' OR qualified_name ILIKE '%::render_pattern') SELECT id, project_id, name, (SELECT count(DISTINCT project_id) FROM f) AS projects FROM f""")
def symbol_everywhere(spark: SparkSession, folder: str) -> DataFrame:
    return relational.symbol_everywhere(model.nodes(spark, folder), "render_pattern").select("id", "project_id", "name", "projects")


@query(f"WITH {WITH_N} SELECT name, count(DISTINCT project_id) AS projects, count(*) AS nodes FROM N WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT project_id) > 1")
def symbols_everywhere(spark: SparkSession, folder: str) -> DataFrame:
    return relational.shared_names(model.nodes(spark, folder))


@query(f"""WITH {WITH_E} , k AS (SELECT source_node_id AS a, target_node_id AS b, coalesce(TRY_CAST(metadata ->> '$.jaccard_score' AS DOUBLE), 0) AS s FROM E WHERE kind = 'similar_to')
SELECT node_id, similar_id, max(s) AS score FROM (SELECT a AS node_id, b AS similar_id, s FROM k WHERE s >= 0.7 UNION ALL SELECT b, a, s FROM k WHERE s >= 0.7) GROUP BY 1, 2""")
def similar_stored(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.similar_to(model.edges(spark, folder))


# --- time and history ----------------------------------------------------------------------------------------

@query("""WITH s AS (SELECT user_id AS node_id, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events),
a AS (SELECT node_id, accesses, (epoch_us(now) - epoch_us(last_access)) / 3.6e9 AS age FROM s, n)
SELECT node_id, accesses, round(accesses / (1 + age), 6) AS score FROM a WHERE age <= 24 ORDER BY round(accesses / (1 + age), 9) DESC, node_id LIMIT 30""")
def working_set(spark: SparkSession, folder: str) -> DataFrame:
    access = table(spark, folder, "events").select(F.col("user_id").alias("node_id"), "ts")
    return relational.working_set(access).select("node_id", "accesses", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT user_id AS node_id, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT node_id, round(exp(-(epoch_us(now) - epoch_us(last_access)) / 1e6 / 86400) * ln(1 + accesses), 6) AS score FROM s, n""")
def decay_scores(spark: SparkSession, folder: str) -> DataFrame:
    access = table(spark, folder, "events").select(F.col("user_id").alias("node_id"), "ts")
    return relational.decay_scores(access, 86400.0).select("node_id", F.round("score", 6).alias("score"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def recent_changes(spark: SparkSession, folder: str) -> DataFrame:
    return relational.recent(table(spark, folder, "events"), "ts", 24, limit=None).select("event_id", "user_id", "event_type")


@query(f"""WITH {WITH_L}, {WITH_C}, U AS (SELECT DISTINCT ON (hash) hash, intent_kind, committed_at FROM C ORDER BY hash),
h AS (SELECT DISTINCT L.node_id, hash, intent_kind, committed_at FROM L JOIN U USING (hash)),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY committed_at DESC, hash) AS rank FROM h),
t AS (SELECT * FROM r WHERE rank <= 50)
SELECT node_id, count(*) AS commits, count(*) FILTER (intent_kind = 'feat') AS feat, count(*) FILTER (intent_kind = 'fix') AS fix, count(*) FILTER (intent_kind = 'refactor') AS refactor, count(*) FILTER (intent_kind = 'perf') AS perf,
count(*) FILTER (coalesce(intent_kind, '') NOT IN ('feat', 'fix', 'refactor', 'perf')) AS other, arg_max(hash, rank) AS first_hash, arg_min(hash, rank) AS last_hash FROM t GROUP BY 1""")
def archaeology(spark: SparkSession, folder: str) -> DataFrame:
    return relational.intent_breakdown(relational.node_history(model.links(spark, folder), model.commits(spark, folder)))


def _commit_kind_case() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(split_part(message, chr(10), 1)), '^({'|'.join(begins)})') THEN '{kind}'" for kind, begins in relational.COMMIT_PREFIXES.items())
    return f"CASE {cases} ELSE 'other' END"


@query(f"WITH {WITH_C} SELECT {_commit_kind_case()} AS kind, intent_kind, count(*) AS commits FROM C WHERE message IS NOT NULL GROUP BY ALL")
def commit_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = model.commits(spark, folder).where("message is not null")
    return rows.select(relational.commit_kind(F.col("message")).alias("kind"), "intent_kind").groupBy("kind", "intent_kind").agg(F.count("*").alias("commits"))


def _intent_sql() -> str:
    hits = {name: " + ".join(f"CAST(contains(m, '{w}') AS INTEGER)" for w in words) for name, (_, words) in risk.INTENTS.items()}
    scores = ", ".join(f"{sql} AS {name}" for name, sql in hits.items())
    best = f"greatest({', '.join(hits)})"
    cases = " ".join(f"WHEN {name} = best THEN '{name}'" for name in hits)
    return f"""WITH {WITH_C}, t AS (SELECT id, lower(coalesce(message, '')) AS m FROM C), s AS (SELECT id, {scores} FROM t), b AS (SELECT *, {best} AS best, {' + '.join(hits)} AS total FROM s)
SELECT id, CASE WHEN best = 0 THEN 'unknown' {cases} END AS intent, round(CASE WHEN total = 0 THEN 0 ELSE best / total END, 6) AS confidence FROM b"""


@query(_intent_sql())
def change_intents(spark: SparkSession, folder: str) -> DataFrame:
    found = model.commits(spark, folder).select("id", risk.intent(F.col("message")).alias("i"))
    return found.select("id", "i.intent", F.round("i.confidence", 6).alias("confidence"))


# --- traversal -------------------------------------------------------------------------------------------------

def _reach_sql(depth: int, backward: bool) -> str:
    here, there = ("dst", "src") if backward else ("src", "dst")
    return f"""WITH RECURSIVE {WITH_E}, A AS (SELECT DISTINCT source_node_id AS src, target_node_id AS dst FROM E WHERE kind = 'calls'),
S AS (SELECT DISTINCT id AS seed FROM nodes WHERE id % 100 = 0),
T AS (SELECT seed, {there} AS node_id, 1 AS hops FROM S JOIN A ON {here} = seed UNION SELECT seed, A.{there}, hops + 1 FROM T JOIN A ON A.{here} = T.node_id WHERE hops < {depth})
SELECT seed, node_id, CAST(min(hops) AS INTEGER) AS hops FROM T GROUP BY 1, 2"""


@query(_reach_sql(3, True))
def callers(spark: SparkSession, folder: str) -> DataFrame:
    return graph.callers(model.edges(spark, folder), _seeds(spark, folder), 3)


@query(_reach_sql(3, False))
def callees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.callees(model.edges(spark, folder), _seeds(spark, folder), 3)


@query(_reach_sql(5, True).replace("WITH RECURSIVE", f"{WITH_RANKS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {WITH_N},", 1).replace(f" {WITH_E}, A AS (SELECT DISTINCT", " CA AS (SELECT DISTINCT", 1).replace("JOIN A ON", "JOIN CA A ON").split("SELECT seed, node_id, CAST(min")[0] + f""", Q AS (SELECT seed, node_id, min(hops) AS hops FROM T GROUP BY 1, 2),
G AS (SELECT seed, hops, file_path FROM Q JOIN N ON N.id = Q.node_id UNION ALL SELECT seed, 0, file_path FROM S JOIN N ON N.id = S.seed),
I AS (SELECT seed, count(*) FILTER (hops = 1) AS direct, count(*) FILTER (hops >= 1) AS distinct_symbols, count(DISTINCT file_path) AS files FROM G GROUP BY 1)
SELECT seed, direct, distinct_symbols, direct + distinct_symbols AS total_symbols, files, CASE WHEN pr > 0.05 OR direct > 10 THEN 'high' WHEN pr > 0.01 OR direct > 3 THEN 'medium' ELSE 'low' END AS risk FROM I JOIN r{PAGERANK_ROUNDS} r ON r.id = seed""")
def impact_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return graph.impact(model.edges(spark, folder), model.nodes(spark, folder), _ranks(spark, folder), _seeds(spark, folder), 5)


PATH_DEPTH = 10


@query(f"""WITH RECURSIVE {WITH_E}, A AS (SELECT DISTINCT source_node_id AS src, target_node_id AS dst FROM E WHERE kind IN ('imports', 'calls', 'references', 'depends_on')),
S AS (SELECT DISTINCT id AS seed FROM nodes WHERE id % 100 = 0),
T AS (SELECT seed, dst AS node_id, 1 AS hops FROM S JOIN A ON src = seed UNION SELECT seed, A.dst, hops + 1 FROM T JOIN A ON A.src = T.node_id WHERE hops < {PATH_DEPTH}),
M AS (SELECT seed, node_id AS goal, min(hops) AS hops FROM T GROUP BY 1, 2)
SELECT seed, goal, CAST(hops AS INTEGER) AS edges FROM M WHERE seed <> goal""")
def path_lengths(spark: SparkSession, folder: str) -> DataFrame:
    arcs = graph.dependency_edges(model.edges(spark, folder)).select("src", "dst")
    found = graph.reachable(arcs, _seeds(spark, folder), PATH_DEPTH).where("node_id <> seed").select("seed", F.col("node_id").alias("goal"))
    way = graph.paths(arcs, found, PATH_DEPTH)
    return way.groupBy("seed", "goal").agg(F.count("*").cast("int").alias("edges"))


@query(f"""WITH RECURSIVE {WITH_E}, A AS (SELECT DISTINCT source_node_id AS src, target_node_id AS dst FROM E WHERE kind IN ('imports', 'calls', 'references', 'depends_on')),
S AS (SELECT DISTINCT id AS seed FROM nodes WHERE id % 100 = 0),
T AS (SELECT seed, dst AS node_id, 1 AS hops FROM S JOIN A ON src = seed UNION SELECT seed, A.dst, hops + 1 FROM T JOIN A ON A.src = T.node_id WHERE hops < {PATH_DEPTH}),
M AS (SELECT seed, node_id, min(hops) AS hops FROM T GROUP BY 1, 2 UNION ALL SELECT seed, seed, 0 FROM S),
B AS (SELECT m.seed, m.node_id AS goal, min(p.node_id) AS src FROM M m JOIN A ON A.dst = m.node_id JOIN M p ON p.seed = m.seed AND p.node_id = A.src AND p.hops = m.hops - 1 WHERE m.node_id <> m.seed GROUP BY 1, 2)
SELECT seed, goal, src, goal AS dst FROM B""")
def path_last_edges(spark: SparkSession, folder: str) -> DataFrame:
    arcs = graph.dependency_edges(model.edges(spark, folder)).select("src", "dst")
    found = graph.reachable(arcs, _seeds(spark, folder), PATH_DEPTH).where("node_id <> seed").select("seed", F.col("node_id").alias("goal"))
    return graph.last_edges(graph.paths(arcs, found, PATH_DEPTH))


@query(f"{WITH_RANKS} SELECT project_id, id AS node_id, round(pr, 6) AS pagerank FROM r{PAGERANK_ROUNDS}")
def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return _ranks(spark, folder).select("project_id", "node_id", F.round("pagerank", 6).alias("pagerank"))


@query(f"""{WITH_RANKS} SELECT project_id, node_id, round(pagerank, 6) AS pagerank, pagerank > 0.05 AS is_hub, CAST(rank AS INTEGER) AS rank
FROM (SELECT project_id, id AS node_id, pr AS pagerank, row_number() OVER (PARTITION BY project_id ORDER BY round(pr, 9) DESC, id) AS rank FROM r{PAGERANK_ROUNDS}) WHERE rank <= 10""")
def pagerank_top(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("project_id").orderBy(F.round("pagerank", 9).desc(), "node_id")
    top = _ranks(spark, folder).withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return top.select("project_id", "node_id", F.round("pagerank", 6).alias("pagerank"), (F.col("pagerank") > 0.05).alias("is_hub"), "rank")


@query(f"""WITH RECURSIVE {WITH_E}, A AS (SELECT source_node_id AS s, target_node_id AS d FROM E WHERE kind IN ('imports', 'calls', 'references', 'depends_on')),
B AS (SELECT s, d FROM A UNION SELECT d, s FROM A), T AS (SELECT s AS node_id, s AS other FROM B UNION SELECT T.node_id, B.d FROM T JOIN B ON B.s = T.other)
SELECT node_id, min(other) AS component FROM T GROUP BY 1""")
def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(graph.dependency_edges(model.edges(spark, folder)).select("src", "dst"))


@query()
def clusters(spark: SparkSession, folder: str) -> DataFrame:
    members = model.nodes(spark, folder, "id", "project_id").select("project_id", F.col("id").alias("node_id"))
    return graph.communities(members, graph.dependency_edges(model.edges(spark, folder)))


@query(f"""WITH {WITH_N}, {WITH_E}, A AS (SELECT project_id, source_node_id AS src, target_node_id AS dst FROM E WHERE kind IN ('imports', 'calls', 'references', 'depends_on') AND source_node_id <> target_node_id),
B AS (SELECT project_id, src, dst FROM A UNION ALL SELECT project_id, dst, src FROM A),
Z AS (SELECT DISTINCT id, kind FROM N), W AS (SELECT B.project_id, src, dst, a.kind AS c1, b.kind AS c2, count(*)::DOUBLE AS w FROM B JOIN Z a ON a.id = src JOIN Z b ON b.id = dst GROUP BY ALL),
D AS (SELECT src, sum(w) AS k FROM W GROUP BY 1), T AS (SELECT project_id, sum(w) AS m2 FROM W GROUP BY 1)
SELECT T.project_id, round(coalesce(sum(CASE WHEN c1 = c2 THEN (w - a.k * b.k / m2) / m2 END), 0), 6) AS modularity FROM T JOIN W USING (project_id) JOIN D a ON a.src = W.src JOIN D b ON b.src = W.dst GROUP BY 1""")
def modularity_of_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = model.nodes(spark, folder, "id", "kind").select(F.col("id").alias("node_id"), F.col("kind").alias("cluster_id"))
    return graph.modularity(kinds, graph.dependency_edges(model.edges(spark, folder))).select("project_id", F.round("modularity", 6).alias("modularity"))


def _boundary_sql() -> str:
    parts = []
    for k, rule in enumerate(RULES):
        allowed = " OR ".join(f"regexp_matches(to_path, '{graph.glob_regex(a)}')" for a in rule.get("allow", ())) or "false"
        for deny in rule["deny"]:
            parts.append(f"SELECT {k} AS rule_index, from_path, to_path, '{deny}' AS deny FROM X WHERE regexp_matches(from_path, '{graph.glob_regex(rule['from'])}') AND regexp_matches(to_path, '{graph.glob_regex(deny)}') AND NOT ({allowed})")
    return f"""WITH {WITH_N}, {WITH_R}, {WITH_E}, X AS (SELECT DISTINCT a.file_path AS from_path, b.file_path AS to_path FROM E JOIN M a ON a.id = source_node_id JOIN M b ON b.id = target_node_id
WHERE E.kind IN ('imports', 'calls', 'references', 'depends_on')) """ + " UNION ALL ".join(parts)


@query(_boundary_sql())
def boundaries(spark: SparkSession, folder: str) -> DataFrame:
    located = _relative(model.nodes(spark, folder), table(spark, folder, "projects")).select(F.col("id").alias("node_id"), "file_path")
    return graph.check_boundaries(graph.dependency_edges(model.edges(spark, folder)), located, RULES)


@query()
def suggested_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _relative(model.nodes(spark, folder), table(spark, folder, "projects"))
    return graph.suggest_boundaries(graph.file_clusters(clusters(spark, folder), nodes))


# --- pattern language ----------------------------------------------------------------------------------------------

PATTERNS = {
    "pattern_equality": ("MATCH (n:Function) WHERE n.complexity = '7' RETURN n.id, n.name, n.complexity", f"WITH {WITH_N} SELECT id AS n_id, name AS n_name, complexity AS n_complexity FROM N WHERE kind = 'function' AND complexity = 7"),
    "pattern_hop": ("MATCH (f)-[:calls]->(g:Method) RETURN f.id, g.id", f"WITH {WITH_N}, {WITH_E} SELECT f.id AS f_id, g.id AS g_id FROM E JOIN N f ON f.id = source_node_id JOIN N g ON g.id = target_node_id AND g.project_id = f.project_id WHERE E.kind = 'calls' AND g.kind = 'method'"),
    "pattern_undirected": ("MATCH (a:Class)-[:references]-(b) RETURN a.id, b.id", f"WITH {WITH_N}, {WITH_E} SELECT a.id AS a_id, b.id AS b_id FROM E JOIN N a ON (a.id = source_node_id OR a.id = target_node_id) JOIN N b ON (b.id = source_node_id OR b.id = target_node_id) AND b.id <> a.id AND b.project_id = a.project_id WHERE E.kind = 'references' AND a.kind = 'class'"),
    "pattern_chain": ("MATCH (f:File)-[:contains]->(m)-[:calls]->(g) RETURN f.file_path, m.id, g.id", f"WITH {WITH_N}, {WITH_E} SELECT f.file_path AS f_file_path, m.id AS m_id, g.id AS g_id FROM E e JOIN N f ON f.id = e.source_node_id JOIN N m ON m.id = e.target_node_id AND m.project_id = f.project_id JOIN E h ON h.source_node_id = m.id AND h.kind = 'calls' JOIN N g ON g.id = h.target_node_id AND g.project_id = m.project_id WHERE e.kind = 'contains' AND f.kind = 'file'"),
    "pattern_not_exists": ("MATCH (n:Function) WHERE NOT EXISTS { (n)<-[:calls]-() } RETURN n.id", f"WITH {WITH_N}, {WITH_E} SELECT id AS n_id FROM N WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM E WHERE E.kind = 'calls' AND target_node_id = N.id)"),
    "pattern_json": ("MATCH (n) WHERE n.lang = 'rust' RETURN n.id, n.lines", f"""WITH {WITH_N} SELECT id AS n_id, metadata ->> '$.lines' AS n_lines FROM N WHERE metadata ->> '$.lang' = 'rust'"""),
    "pattern_ordered": ("MATCH (n:Method) RETURN n.name, n.id ORDER BY n.id DESC LIMIT 25", f"WITH {WITH_N} SELECT name AS n_name, id AS n_id FROM N WHERE kind = 'method' ORDER BY id DESC LIMIT 25"),
}


def _pattern(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: pattern.run(text, model.nodes(spark, folder), model.edges(spark, folder))


for _name, (_text, _sql) in PATTERNS.items():
    QUERIES[_name], SQL[_name] = _pattern(_text), _sql


# --- search ------------------------------------------------------------------------------------------------------------

def _project_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "projects").select(F.col("id").alias("query_id"), F.col("name").alias("query"))


WITH_BM25 = r"""Q AS (SELECT DISTINCT id AS query_id, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) AS term FROM projects),
T AS MATERIALIZED (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
st AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM T),
H AS (SELECT doc, term, length, count(*) AS tf FROM (SELECT doc, len(words) AS length, unnest(words) AS term FROM T) WHERE term IN (SELECT term FROM Q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM H GROUP BY 1),
sc AS (SELECT H.term, doc, (CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS w FROM H JOIN df ON df.term = H.term, st),
su AS (SELECT query_id, doc, -sum(w) AS score FROM sc JOIN Q ON Q.term = sc.term GROUP BY 1, 2),
B AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc) AS rank FROM su)"""


@query(f"WITH {WITH_BM25} SELECT query_id, doc, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM B WHERE rank <= 20")
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    found = search.bm25(table(spark, folder, "documents"), "doc_id", "text", _project_queries(spark, folder))
    return found.select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query()
def search_text_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    found = search.bm25(table(spark, folder, "documents"), "doc_id", "text", _project_queries(spark, folder), stemmed=True)
    return found.select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


WITH_COSINE = """X AS (SELECT q.vec_id AS query_id, v.vec_id AS node_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS similarity FROM embeddings q, embeddings v WHERE {where}),
Y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, node_id) AS rank FROM X)"""


@query(f"WITH {WITH_COSINE.format(where='q.vec_id % 100 = 0')} SELECT query_id, node_id, round(similarity, 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM Y WHERE rank <= 10 AND similarity > 0")
def search_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    found = search.vector_search(rows, rows.where("node_id % 100 = 0").withColumnRenamed("node_id", "query_id"))
    return found.select("query_id", "node_id", F.round("similarity", 5).alias("similarity"), "rank")


@query(f"""{WITH_RANKS}, {WITH_BM25}, {WITH_COSINE.format(where='q.vec_id IN (SELECT id FROM projects)')},
lists AS (SELECT query_id, doc AS item, rank FROM B WHERE rank <= 20 UNION ALL SELECT query_id, node_id, rank FROM Y WHERE rank <= 20 AND similarity > 0),
f AS (SELECT query_id, item, sum(1.0 / (60 + rank)) * (1 + 5 * coalesce(any_value(pr), 0)) AS score FROM lists LEFT JOIN r{PAGERANK_ROUNDS} r ON r.id = item GROUP BY 1, 2)
SELECT query_id, item, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item) AS rank FROM f) WHERE rank <= 20""")
def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    text = search.bm25(table(spark, folder, "documents"), "doc_id", "text", _project_queries(spark, folder)).withColumnRenamed("doc", "item")
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    asked = rows.join(table(spark, folder, "projects").select(F.col("id").alias("node_id")), "node_id").select(F.col("node_id").alias("query_id"), "embedding")
    vectors = search.vector_search(rows, asked, 20).withColumnRenamed("node_id", "item")
    return search.fuse([text, vectors], _ranks(spark, folder)).select("query_id", "item", F.round("score", 6).alias("score"), "rank")


# --- similarity ------------------------------------------------------------------------------------------------------------

@query(r"""WITH s AS (SELECT DISTINCT id, source FROM nodes WHERE kind IN ('function', 'method') AND source IS NOT NULL),
l AS (SELECT id, list_filter(list_transform(string_split(source, chr(10)), lambda x: trim(regexp_replace(x, '\s', ' ', 'g'))), lambda x: NOT starts_with(x, '//') AND NOT starts_with(x, '#')) AS lines FROM s)
SELECT id, md5(regexp_replace(array_to_string(lines, ''), '\s', '', 'g')) AS normalized FROM l""")
def normalized_code(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nodes").where(F.col("kind").isin("function", "method") & F.col("source").isNotNull()).select("id", "source").distinct()
    return rows.select("id", F.md5(similarity.normalize_code(F.col("source"))).alias("normalized"))


@query()
def similar_code(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nodes").select("id", "kind", "source", "start_line", "end_line")
    return similarity.similar_pairs(similarity.signatures(rows))


@query(r"""WITH s AS (SELECT DISTINCT id, source FROM nodes WHERE source IS NOT NULL), a AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM edges WHERE kind = 'similar_to'),
t AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(source), '[^\p{L}\p{N}_]+'), lambda x: strlen(x) > 1)) AS toks FROM s WHERE id IN (SELECT a FROM a UNION SELECT b FROM a))
SELECT a, b, round(CASE WHEN len(list_distinct(list_concat(x.toks, y.toks))) = 0 THEN 1 ELSE len(list_intersect(x.toks, y.toks)) / len(list_distinct(list_concat(x.toks, y.toks))) END, 6) AS overlap FROM a JOIN t x ON x.id = a JOIN t y ON y.id = b""")
def token_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "edges").where("kind = 'similar_to'").select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")).distinct()
    texts = table(spark, folder, "nodes").where("source is not null").select("id", "source").distinct()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("source").alias("sa")), "a").join(texts.select(F.col("id").alias("b"), F.col("source").alias("sb")), "b")
    return both.select("a", "b", F.round(similarity.token_overlap(F.col("sa"), F.col("sb")), 6).alias("overlap"))


@query()
def semantic_scores(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "edges").where("kind = 'similar_to'").select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")).distinct()
    rows = model.nodes(spark, folder, "id", "source", "file_path", "start_line", "end_line", "complexity", "is_exported")
    return similarity.semantic_scores(pairs, rows)


# --- risk --------------------------------------------------------------------------------------------------------------------

WITH_PLANS = """T AS (SELECT DISTINCT plan_id, node_id, coalesce(pagerank, 0) AS pr, coalesce(blast_radius_files, 0) AS blast, coalesce(git_churn, 0) AS churn, coalesce(complexity, 0) AS cx, coalesce(change_coupling_count, 0) AS cc, coalesce(max_co_changes, 0) AS mc, coalesce(len(missing_tests), 0) AS untested FROM target_factors),
G AS (SELECT plan_id, greatest(max(pr), 0.001) AS mp, greatest(max(cx), 1) AS mx, count(*) AS n FROM T GROUP BY 1),
Z AS (SELECT plan_id, 0.25 * least(ln(1 + pr * 100) / ln(1 + mp * 100), 1) + 0.20 * least(blast / least(greatest(n * 0.3, 5), 20), 1) + 0.15 * least(churn / 15, 1)
 + 0.15 * CASE WHEN blast > 0 THEN untested / blast ELSE 0.5 END + 0.10 * least(cx / mx, 1) + 0.15 * CASE WHEN mc > 0 THEN least(cc / least(mc, 20), 1) ELSE 0 END AS score FROM T JOIN G USING (plan_id))"""


@query(f"""WITH {WITH_PLANS} SELECT plan_id, count(*) AS targets, round(avg(score), 6) AS score, round(max(score), 6) AS top_score, CASE WHEN avg(score) >= 0.7 THEN 'CRITICAL' WHEN avg(score) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM Z GROUP BY 1""")
def plan_risk(spark: SparkSession, folder: str) -> DataFrame:
    found = risk.plan_scores(table(spark, folder, "target_factors"))
    return found.select("plan_id", "targets", F.round("score", 6).alias("score"), F.round("top_score", 6).alias("top_score"), "level")


def _risk_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges, links, ranks = model.nodes(spark, folder), model.edges(spark, folder), model.links(spark, folder), _ranks(spark, folder)
    coupling = relational.change_coupling(nodes, links, min_co_changes=2)
    return risk.node_features(nodes, edges, links, ranks, relational.coupling_strength(coupling)), risk.baselines(nodes, ranks, coupling), ranks


WITH_FEATURES = f"""{WITH_RANKS}, {WITH_N}, {WITH_L}, {WITH_COUPLING},
CL AS (SELECT DISTINCT source_node_id AS caller, target_node_id AS node_id FROM E WHERE kind = 'calls'),
W2 AS (SELECT caller, node_id FROM CL UNION SELECT b.caller, a.node_id FROM CL a JOIN CL b ON b.node_id = a.caller),
TT AS (SELECT DISTINCT target_node_id AS id FROM E WHERE kind = 'test_of'),
AR AS (SELECT W2.node_id, count(DISTINCT c.file_path) AS blast, count(*) FILTER (TT.id IS NULL) AS untested FROM W2 JOIN N c ON c.id = W2.caller LEFT JOIN TT ON TT.id = W2.caller GROUP BY 1),
CH AS (SELECT node_id, count(DISTINCT hash) AS churn FROM L GROUP BY 1),
CS AS (SELECT node_id, sum(c) AS strength FROM (SELECT source_node_id AS node_id, target_node_id AS o, max(co_changes) AS c FROM (SELECT source_node_id, target_node_id, co_changes FROM P UNION ALL SELECT target_node_id, source_node_id, co_changes FROM P) GROUP BY 1, 2) GROUP BY 1),
FL AS (SELECT project_id, file_path, min(id) AS file_id FROM N WHERE kind = 'file' GROUP BY 1, 2),
FT AS (SELECT N.project_id, N.id AS node_id, N.name, coalesce(N.complexity, 1) AS cx, pr, coalesce(blast, 0) AS blast, coalesce(untested, 0) AS untested, coalesce(churn, 0) AS churn, TT.id IS NOT NULL AS self, coalesce(strength, 0) AS cc FROM N JOIN r{PAGERANK_ROUNDS} r ON r.id = N.id LEFT JOIN AR ON AR.node_id = N.id LEFT JOIN CH ON CH.node_id = N.id LEFT JOIN FL ON FL.project_id = N.project_id AND FL.file_path = N.file_path LEFT JOIN CS ON CS.node_id = CASE WHEN N.kind IN ('function', 'method') THEN coalesce(file_id, N.id) ELSE N.id END LEFT JOIN TT ON TT.id = N.id),
BS AS (SELECT project_id, greatest(max(complexity), 1) AS mx, greatest(count(DISTINCT file_path) FILTER (kind = 'file'), 1) AS files FROM N GROUP BY 1),
MP AS (SELECT project_id, greatest(max(pr), 0.001) AS mp FROM r{PAGERANK_ROUNDS} GROUP BY 1), MC AS (SELECT project_id, max(co_changes) AS mc FROM P GROUP BY 1)"""


@query(f"""{WITH_FEATURES} SELECT FT.project_id, node_id, round(0.25 * least(ln(1 + pr * 100) / ln(1 + mp * 100), 1) + 0.20 * least(blast / least(greatest(files * 0.3, 5), 20), 1) + 0.15 * least(churn / 15, 1)
 + 0.15 * CASE WHEN blast > 0 THEN untested / blast WHEN self THEN 0 ELSE 0.5 END + 0.10 * least(cx / mx, 1) + 0.15 * CASE WHEN coalesce(mc, 0) > 0 THEN least(cc / least(mc, 20), 1) ELSE 0 END, 5) AS score
FROM FT JOIN BS USING (project_id) JOIN MP USING (project_id) LEFT JOIN MC USING (project_id)""")
def node_risk(spark: SparkSession, folder: str) -> DataFrame:
    features, base, _ = _risk_parts(spark, folder)
    return risk.node_risk(features, base).select("project_id", "node_id", F.round("score", 5).alias("score"))


WITH_ALTERNATIVES = """AF AS (SELECT DISTINCT id, name FROM N WHERE kind IN ('function', 'method') AND name IS NOT NULL),
AB AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(name, '(_alt)+$', ''), '(_v2)+$', ''), '(_old)+$', '') AS base FROM AF WHERE strlen(name) >= 4),
AW AS (SELECT id, base AS name FROM AB UNION ALL SELECT id, base || '_alt' FROM AB UNION ALL SELECT id, base || '_v2' FROM AB),
AJ AS (SELECT DISTINCT AW.id AS node_id, AF.id AS alternative_id FROM AW JOIN AF ON AF.name = AW.name AND AF.id <> AW.id)"""
WITH_INTERFACES = """IU AS (SELECT source_node_id AS o, target_node_id AS i FROM E WHERE kind IN ('implements', 'extends')),
IR AS (SELECT o AS node_id, i AS interface_id FROM IU UNION SELECT E.target_node_id, i FROM E JOIN IU ON IU.o = E.source_node_id WHERE E.kind = 'contains')"""
WITH_CENTRAL = f"""PC AS (SELECT project_id, greatest(max(CASE WHEN rn = floor(n * 0.8) + 1 THEN pr END), 0.001) AS least FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pr DESC, id) AS rn FROM r{PAGERANK_ROUNDS}) GROUP BY 1),
CC AS (SELECT DISTINCT E.target_node_id AS node_id, E.source_node_id AS caller_id FROM E JOIN r{PAGERANK_ROUNDS} r ON r.id = E.source_node_id JOIN PC ON PC.project_id = r.project_id WHERE E.kind = 'calls' AND r.pr >= least)"""
_JOINT = "CASE WHEN coalesce(mc, 0) > 0 THEN least(cc / least(mc, 20), 1) ELSE 0 END"


@query(f"""{WITH_FEATURES}, {WITH_ALTERNATIVES}, {WITH_INTERFACES}, {WITH_CENTRAL}, S AS (SELECT FT.*, pr / mp AS central, cx / mx AS weight, {_JOINT} AS joint, node_id IN (SELECT node_id FROM IR) AS has_i, node_id IN (SELECT node_id FROM AJ) AS has_a, node_id IN (SELECT node_id FROM CC) AS has_c,
0.25 * least(ln(1 + pr * 100) / ln(1 + mp * 100), 1) + 0.20 * least(blast / least(greatest(files * 0.3, 5), 20), 1) + 0.15 * least(churn / 15, 1) + 0.15 * CASE WHEN blast > 0 THEN untested / blast WHEN self THEN 0 ELSE 0.5 END + 0.10 * least(cx / mx, 1) + 0.15 * {_JOINT} AS score
FROM FT JOIN BS USING (project_id) JOIN MP USING (project_id) LEFT JOIN MC USING (project_id)),
X AS (SELECT project_id, node_id, CASE WHEN has_i THEN 'interface_segregation' ELSE 'extract_interface' END AS strategy, CASE WHEN has_i THEN 0.08 ELSE 0.06 END::DOUBLE AS delta FROM S WHERE (central > 0.3 OR blast > 5) AND name IS NOT NULL
UNION ALL SELECT project_id, node_id, 'add_test_contract', CASE WHEN blast > 0 THEN round(0.2::DOUBLE * untested / blast, 3) ELSE 0 END FROM S WHERE untested > 0
UNION ALL SELECT project_id, node_id, 'add_self_test', 0.1 FROM S WHERE NOT self AND score >= 0.4
UNION ALL SELECT project_id, node_id, CASE WHEN has_a THEN 'refactor_hotspot' ELSE 'partition_changes' END, round(0.15::DOUBLE * least(churn / 15, 1) * 0.4, 3) FROM S WHERE churn > 7
UNION ALL SELECT project_id, node_id, 'divide_and_conquer', round(0.1::DOUBLE * least(weight, 1) / 2, 3) FROM S WHERE weight > 0.5
UNION ALL SELECT project_id, node_id, 'isolate_call_chain', 0.07 FROM S WHERE central > 0.2 AND has_c
UNION ALL SELECT project_id, node_id, 'account_change_coupling', round(0.15::DOUBLE * joint, 3) FROM S WHERE round(0.15::DOUBLE * joint, 3) > 0)
SELECT project_id, node_id, strategy, delta, CASE WHEN delta >= 0.10 THEN 'HIGH' WHEN delta >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM X""")
def risk_strategies(spark: SparkSession, folder: str) -> DataFrame:
    features, base, ranks = _risk_parts(spark, folder)
    nodes, edges = model.nodes(spark, folder), model.edges(spark, folder)
    scored = features.join(risk.node_risk(features, base).select("node_id", "score"), "node_id")
    return risk.strategies(scored, base, risk.interfaces(edges), risk.alternatives(nodes), risk.central_callers(edges, ranks, base))


@query(f"""WITH {WITH_N}, {WITH_C}, t AS (SELECT project_id, max(CAST(kind = 'test' AS INTEGER)) AS tests FROM N GROUP BY 1), h AS (SELECT DISTINCT project_id FROM C)
SELECT t.project_id, round(1.0::DOUBLE - CASE WHEN h.project_id IS NULL THEN 0.3 ELSE 0 END - CASE WHEN tests = 1 THEN 0 ELSE 0.2 END, 6) AS confidence FROM t LEFT JOIN h USING (project_id)""")
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    return risk.confidence(model.nodes(spark, folder), model.commits(spark, folder)).select("project_id", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@query(f"""{WITH_RANKS}, {WITH_N}, {WITH_L}, {WITH_COUPLING}, BS AS (SELECT project_id, greatest(max(complexity), 1) AS max_complexity, greatest(count(DISTINCT file_path) FILTER (kind = 'file'), 1) AS total_files FROM N GROUP BY 1),
MP AS (SELECT project_id, greatest(max(pr), 0.001) AS max_pagerank, greatest(max(CASE WHEN rn = floor(n * 0.8) + 1 THEN pr END), 0.001) AS pagerank_percentile_80 FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pr DESC, id) AS rn FROM r{PAGERANK_ROUNDS}) GROUP BY 1), MC AS (SELECT project_id, max(co_changes) AS mc FROM P GROUP BY 1)
SELECT project_id, max_complexity, total_files, round(max_pagerank, 6) AS max_pagerank, round(pagerank_percentile_80, 6) AS pagerank_percentile_80, coalesce(mc, 0) AS max_co_changes FROM BS JOIN MP USING (project_id) LEFT JOIN MC USING (project_id)""")
def risk_baselines(spark: SparkSession, folder: str) -> DataFrame:
    _, base, _ = _risk_parts(spark, folder)
    return base.select("project_id", F.col("max_complexity").cast("long").alias("max_complexity"), F.col("total_files").cast("long").alias("total_files"), F.round("max_pagerank", 6).alias("max_pagerank"), F.round("pagerank_percentile_80", 6).alias("pagerank_percentile_80"), "max_co_changes")


@query(f"""{WITH_RANKS}, {WITH_N}, ga AS (SELECT N.project_id, file_path, max(pr) AS pagerank FROM N LEFT JOIN r{PAGERANK_ROUNDS} r ON r.id = N.id WHERE file_path IS NOT NULL GROUP BY ALL),
gb AS (SELECT N.project_id, file_path, count(DISTINCT source_node_id) AS sources FROM N JOIN E ON E.target_node_id = N.id WHERE file_path IS NOT NULL GROUP BY ALL)
SELECT project_id, file_path, round(coalesce(pagerank, 0), 6) AS pagerank, coalesce(sources, 0) AS sources, coalesce(pagerank, 0) >= 0.05 OR coalesce(sources, 0) >= 10 AS blocked FROM ga LEFT JOIN gb USING (project_id, file_path)""")
def guarded_files(spark: SparkSession, folder: str) -> DataFrame:
    return risk.guarded_files(model.nodes(spark, folder), model.edges(spark, folder), _ranks(spark, folder)).withColumn("pagerank", F.round("pagerank", 6))


@query(f"""WITH {WITH_N}, {WITH_ALTERNATIVES} SELECT node_id, alternative_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY alternative_id) AS rank FROM AJ) WHERE rank <= 5""")
def alternative_implementations(spark: SparkSession, folder: str) -> DataFrame:
    return risk.alternatives(model.nodes(spark, folder))


@query(f"WITH {WITH_N}, {WITH_E} SELECT DISTINCT source_node_id AS node_id, target_node_id AS candidate_id FROM E WHERE E.kind = 'calls' AND target_node_id IN (SELECT id FROM N WHERE kind IN ('function', 'method'))")
def extraction_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return risk.extraction_candidates(model.nodes(spark, folder), model.edges(spark, folder))


@query(f"{WITH_RANKS}, {WITH_CENTRAL} SELECT node_id, caller_id FROM CC")
def central_callers(spark: SparkSession, folder: str) -> DataFrame:
    _, base, ranks = _risk_parts(spark, folder)
    return risk.central_callers(model.edges(spark, folder), ranks, base)


@query(f"WITH {WITH_E}, {WITH_INTERFACES} SELECT node_id, interface_id FROM IR")
def related_interfaces(spark: SparkSession, folder: str) -> DataFrame:
    return risk.interfaces(model.edges(spark, folder))


# --- extraction ----------------------------------------------------------------------------------------------------------------

def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parsed_files").select("project_id", F.regexp_replace("file_path", r"\\", "/").alias("file_path"), "source").distinct()


@query()
def extracted_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract_nodes(_files(spark, folder)).drop("source")


@query()
def extracted_routes(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract_routes(_files(spark, folder))


_FOLDER, _EXT = r"regexp_extract(file_path, '^(.*)/[^/]*$', 1)", r"lower(regexp_extract(file_path, '\.([A-Za-z0-9+]+)$', 1))"


@query(rf"""WITH M AS (SELECT DISTINCT id, project_id, replace(file_path, '\', '/') AS file_path, kind, name, is_exported, source FROM nodes WHERE kind IN ('function', 'method')),
R AS (SELECT DISTINCT project_id, id, file_path, unnest(regexp_extract_all(source, '((?:\.\s*)?\b[A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS c FROM M WHERE source IS NOT NULL),
K AS (SELECT DISTINCT project_id, id, file_path, {_FOLDER} AS folder, {_EXT} AS ext, regexp_replace(c, '^\.\s*', '') AS called, starts_with(c, '.') AS is_method FROM R),
C AS (SELECT * FROM K WHERE called NOT IN ({', '.join(repr(w) for w in extract.NO_CALLS)})),
V AS (SELECT project_id, id, file_path, {_FOLDER} AS folder, {_EXT} AS ext, name AS called, kind, is_exported FROM M WHERE name IS NOT NULL),
TF AS (SELECT project_id, file_path, called, arg_min(id, (kind <> 'function', id)) AS t_file, min(id) FILTER (kind = 'method') AS t_method FROM V GROUP BY 1, 2, 3),
TD AS (SELECT project_id, folder, ext, called, arg_min(id, (kind <> 'function', id)) AS t_folder FROM V GROUP BY 1, 2, 3, 4),
TP AS (SELECT project_id, called, min(id) FILTER (is_exported) AS t_project FROM V GROUP BY 1, 2 HAVING count(*) = 1),
J AS (SELECT C.project_id, C.id AS source_node_id, CASE WHEN is_method THEN t_method ELSE coalesce(t_file, t_folder, t_project) END AS target_node_id FROM C LEFT JOIN TF USING (project_id, file_path, called) LEFT JOIN TD USING (project_id, folder, ext, called) LEFT JOIN TP USING (project_id, called))
SELECT DISTINCT project_id, source_node_id, target_node_id, 'calls' AS kind FROM J WHERE target_node_id IS NOT NULL AND source_node_id <> target_node_id""")
def resolved_calls(spark: SparkSession, folder: str) -> DataFrame:
    return extract.resolve_calls(model.nodes(spark, folder, "id", "project_id", "file_path", "kind", "name", "is_exported", "source"))


@query(f"""WITH {WITH_N}, t AS (SELECT project_id, id, name FROM N WHERE kind IN ('function', 'method') AND (regexp_matches(file_path, '(^|/)(test_[^/]*\\.py|[^/]*_test\\.(py|go|rs)|[^/]*\\.(test|spec)\\.(ts|tsx|js|jsx|mjs|cjs)|[^/]*Tests?\\.(java|cs|php))$') OR regexp_matches(file_path, '(^|/)(tests?|__tests__|spec)/'))),
s AS (SELECT project_id, id, substr(name, 6) AS name FROM t WHERE starts_with(name, 'test_') UNION SELECT project_id, id, substr(name, 5) FROM t WHERE regexp_matches(name, '^Test[A-Z]'))
SELECT DISTINCT s.project_id, s.id AS source_node_id, N.id AS target_node_id, 'test_of' AS kind FROM s JOIN N ON N.project_id = s.project_id AND N.name = s.name WHERE N.kind NOT IN ('file', 'test_contract') AND N.id <> s.id""")
def resolved_tests(spark: SparkSession, folder: str) -> DataFrame:
    return extract.test_contracts(model.nodes(spark, folder))


@query(r"""WITH l AS (SELECT project_id, snapshot_no, replace(file_path, '\', '/') AS file_path, md5(string_agg(coalesce(qualified_name, '') || ':' || coalesce(lower(content_hash), ''), ',' ORDER BY coalesce(qualified_name, '') || ':' || coalesce(lower(content_hash), ''))) AS h FROM (SELECT DISTINCT project_id, snapshot_no, file_path, qualified_name, content_hash FROM node_snapshots) GROUP BY 1, 2, 3),
d AS (SELECT project_id, snapshot_no, lead(snapshot_no) OVER (PARTITION BY project_id ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT project_id, snapshot_no FROM l)),
a AS (SELECT l.project_id, next_no AS snapshot_no, file_path, h FROM l JOIN d USING (project_id, snapshot_no) WHERE next_no IS NOT NULL), b AS (SELECT l.* FROM l JOIN d ON d.project_id = l.project_id AND d.next_no = l.snapshot_no)
SELECT coalesce(a.project_id, b.project_id) AS project_id, CAST(coalesce(a.snapshot_no, b.snapshot_no) AS INTEGER) AS snapshot_no, coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.project_id = b.project_id AND a.snapshot_no = b.snapshot_no AND a.file_path = b.file_path""")
def file_state_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Each snapshot against the previous one of its project."""
    states, at = _file_states(spark, folder), ["project_id", "snapshot_no"]
    following = states.select(*at).distinct().withColumn("next_no", F.lead("snapshot_no").over(Window.partitionBy("project_id").orderBy("snapshot_no"))).where("next_no is not null")
    stored = states.join(following, at).drop("snapshot_no").withColumnRenamed("next_no", "snapshot_no")
    current = states.join(following.select("project_id", F.col("next_no").alias("snapshot_no")), at, "left_semi")
    return extract.state_diff(stored, current, ("project_id", "snapshot_no", "file_path"))


def _file_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "node_snapshots").select("project_id", "snapshot_no", "file_path", "qualified_name", "content_hash").distinct()
    item = F.concat(F.coalesce("qualified_name", F.lit("")), F.lit(":"), F.coalesce(F.lower("content_hash"), F.lit("")))
    return rows.groupBy("project_id", "snapshot_no", F.regexp_replace("file_path", r"\\", "/").alias("file_path")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(item)), ",")).alias("content_hash"))


@query("SELECT DISTINCT id, CAST(floor(strlen(source) * 0.25) AS BIGINT) AS tokens FROM nodes WHERE source IS NOT NULL")
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nodes").where("source is not null").select("id", estimate_tokens(F.col("source")).alias("tokens")).distinct()


@query(r"""WITH p AS (SELECT DISTINCT replace(file_path, '\', '/') AS file_path FROM nodes WHERE file_path IS NOT NULL),
a AS (SELECT file_path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_path, '/{2,}', '/', 'g'), '\$\{[^}]*\}', '{}', 'g'), '<[^>]*>', '{}', 'g'), ':[A-Za-z0-9_]+', '{}', 'g'), '\{[A-Za-z0-9_]+\}', '{}', 'g') AS r FROM p),
b AS (SELECT file_path, CASE WHEN starts_with(r, '/') THEN r ELSE '/' || r END AS r FROM a)
SELECT file_path, CASE WHEN length(r) > 1 THEN regexp_replace(r, '/$', '') ELSE r END AS route FROM b""")
def canonical_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nodes").where("file_path is not null").select(F.regexp_replace("file_path", r"\\", "/").alias("file_path")).distinct()
    return rows.select("file_path", canonical_route(F.col("file_path")).alias("route"))


@query()
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nodes").where("source is not null").select("id", content_hash(F.col("source")).alias("hash")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
