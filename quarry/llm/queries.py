"""Queries of the training-data operators over the project tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import broken, cooccurrence, docpairs, encoding, handwritten, leakage, neardup, packing, ranking
from quarry.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken.checked_files(table(spark, folder, "parsed_files")).where("broken").select("file_id").distinct()


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return broken.broken_rates(broken.checked_files(table(spark, folder, "parsed_files"), located=True))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.documented_pairs(table(spark, folder, "nodes")).select("node_id").distinct()


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.documented_pairs(table(spark, folder, "nodes"))


def p2_file_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.file_pairs(table(spark, folder, "parsed_files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_targets(ranking.net_flows(table(spark, folder, "target_factors")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.beyond_chance(cooccurrence.together(table(spark, folder, "commit_node_links"), min_together=4))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = handwritten.not_handwritten(table(spark, folder, "nodes"), table(spark, folder, "projects"))
    return found.select(F.col("id").alias("node_id")).distinct()


def p6_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many files each evidence marks, and in how many projects."""
    nodes = table(spark, folder, "nodes")
    found = handwritten.not_handwritten(nodes, table(spark, folder, "projects"))
    own = nodes.where("kind = 'file'").select("id", "project_id").distinct()
    return found.join(own, "id").groupBy("reason").agg(F.countDistinct("id").alias("files"), F.countDistinct("project_id").alias("projects"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.all_pairs(*neardup.near_duplicates(table(spark, folder, "nodes")))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(table(spark, folder, "nodes")))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(packing.measured(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_pairs(leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), window=None)
    return found.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.round(F.max("similarity"), 6).alias("similarity"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled(table(spark, folder, "documents")).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_rates": p1_rates, "p2_found": p2_found, "p2_pairs": p2_pairs, "p2_file_pairs": p2_file_pairs, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_reasons": p6_reasons, "p7_found": p7_found, "p7_groups": p7_groups, "p8_containers": p8_containers, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found}


P5_SQL = """
WITH l AS (SELECT DISTINCT coalesce(project_id, -1) AS p, lower(commit_hash) AS h, node_id AS i FROM commit_node_links
           WHERE commit_hash IS NOT NULL AND node_id IS NOT NULL),
ok AS (SELECT p, h FROM l GROUP BY p, h HAVING count(*) <= 50),
k AS (SELECT l.* FROM l JOIN ok USING (p, h)),
n AS (SELECT p, count(DISTINCT h) AS n FROM k GROUP BY p),
c AS (SELECT p, i, count(*) AS c FROM k GROUP BY p, i),
j AS (SELECT a.p, a.i AS a, b.i AS b, count(*) AS t FROM k a JOIN k b ON a.p = b.p AND a.h = b.h AND a.i < b.i
      GROUP BY a.p, a.i, b.i HAVING count(*) >= 4)
SELECT DISTINCT a AS node_a, b AS node_b FROM j JOIN n USING (p) JOIN c ca ON ca.p = j.p AND ca.i = a JOIN c cb ON cb.p = j.p AND cb.i = b
WHERE t * n >= 3 * ca.c * cb.c
"""


P4_SQL = """
WITH t AS (SELECT DISTINCT plan_id, node_id, pagerank::DOUBLE AS f0, blast_radius_files::DOUBLE AS f1, git_churn::DOUBLE AS f2, complexity::DOUBLE AS f3 FROM target_factors WHERE plan_id IS NOT NULL AND node_id IS NOT NULL),
r AS (SELECT row_number() OVER () AS rid, * FROM t),
u AS (SELECT rid, plan_id, node_id, 0 AS f, coalesce(f0, -1e308) AS v FROM r UNION ALL SELECT rid, plan_id, node_id, 1, coalesce(f1, -1e308) FROM r
      UNION ALL SELECT rid, plan_id, node_id, 2, coalesce(f2, -1e308) FROM r UNION ALL SELECT rid, plan_id, node_id, 3, coalesce(f3, -1e308) FROM r),
p AS (SELECT *, (rank() OVER (PARTITION BY plan_id, f ORDER BY v) - 1 + count(*) OVER (PARTITION BY plan_id, f, v) / 2) / count(*) OVER (PARTITION BY plan_id, f) AS r, count(*) OVER (PARTITION BY plan_id, f) AS n FROM u),
g AS (SELECT a.rid, a.plan_id, a.node_id, a.f, sum(least(greatest((a.r - b.r - 0.02) / 0.48, 0), 1) - least(greatest((b.r - a.r - 0.02) / 0.48, 0), 1)) / greatest(any_value(a.n) - 1, 1) AS flow
      FROM p a JOIN p b ON a.plan_id = b.plan_id AND a.f = b.f GROUP BY a.rid, a.plan_id, a.node_id, a.f),
s AS (SELECT plan_id, node_id, max(flow) AS flow FROM (SELECT rid, plan_id, node_id, sum(flow) / 4 AS flow FROM g GROUP BY rid, plan_id, node_id) GROUP BY plan_id, node_id)
SELECT plan_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY round(flow, 9) DESC, node_id) AS k FROM s) WHERE k <= 5
"""

P7_SQL = """
WITH n AS (SELECT DISTINCT id, regexp_extract_all(source, '[A-Za-z0-9_]+') AS t FROM nodes WHERE kind IN ('function', 'method') AND source IS NOT NULL AND id IS NOT NULL),
s AS (SELECT DISTINCT id, t[k] || ' ' || t[k + 1] || ' ' || t[k + 2] AS g FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS k FROM n WHERE len(t) >= 40)),
c AS (SELECT id, count(*) AS c FROM s GROUP BY id),
j AS (SELECT a.id AS a, b.id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT a AS node_a, b AS node_b FROM j JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE x >= 0.6 * (ca.c + cb.c - x)
"""

P9_SQL = r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items),
i AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 15], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 14)) AS k FROM w WHERE len(w) >= 16)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, array_to_string(w[k:k + 15], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 14)) AS k FROM d WHERE len(w) >= 16))
SELECT DISTINCT doc_id, item_id FROM x JOIN i ON x.g = i.g
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p5_found": P5_SQL, "p7_found": P7_SQL, "p9_found": P9_SQL}
