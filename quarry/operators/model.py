"""The property graph's tables, deduplicated and normalised, and its vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.tables import slashed, table

SYMBOL_KINDS = ("function", "method", "class", "struct")
CALLABLE_KINDS = ("function", "method")
DEPENDENCY_KINDS = ("imports", "calls", "references", "depends_on")

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()
NODE = T.StructType([
    T.StructField("id", _L, False), T.StructField("project_id", _L, False), T.StructField("file_path", _S), T.StructField("kind", _S), T.StructField("name", _S),
    T.StructField("qualified_name", _S), T.StructField("signature", _S), T.StructField("doc_comment", _S), T.StructField("start_line", _L), T.StructField("end_line", _L),
    T.StructField("complexity", _L), T.StructField("is_exported", T.BooleanType()), T.StructField("content_hash", _S), T.StructField("source", _S), T.StructField("metadata", _S),
    T.StructField("created_at", _TS), T.StructField("updated_at", _TS),
])
EDGE = T.StructType([T.StructField("id", _L), T.StructField("project_id", _L), T.StructField("source_node_id", _L), T.StructField("target_node_id", _L), T.StructField("kind", _S), T.StructField("metadata", _S), T.StructField("created_at", _TS)])

#: Extension to language name.
LANGUAGES = {
    "rust": ("rs",), "python": ("py",), "typescript": ("ts", "tsx"), "javascript": ("js", "jsx", "mjs", "cjs"), "go": ("go",), "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp"), "java": ("java",), "csharp": ("cs",), "php": ("php", "phtml"),
}


def nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Nodes, each exact duplicate once, with the columns asked for (all but ``source`` by default) and ``/`` in paths."""
    wanted = columns or tuple(f.name for f in NODE if f.name != "source")
    rows = table(spark, folder, "nodes").select(*wanted).distinct()
    return rows.withColumn("file_path", slashed(F.col("file_path"))) if "file_path" in wanted else rows


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(project_id, source_node_id, target_node_id, kind, metadata): one row an edge, the metadata of its least id."""
    rows = table(spark, folder, "edges")
    return unique_edges(rows)


def unique_edges(rows: DataFrame) -> DataFrame:
    """Edges unique on (source, target, kind); the first delivered wins."""
    first = F.min(F.struct("id", "project_id", "metadata")).alias("e")
    return rows.groupBy("source_node_id", "target_node_id", "kind").agg(first).select(F.col("e.project_id").alias("project_id"), "source_node_id", "target_node_id", "kind", F.col("e.metadata").alias("metadata"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """Commits, each exact duplicate once, hash in lower case."""
    return table(spark, folder, "git_commits").distinct().withColumn("hash", F.lower("hash"))


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (project_id, hash, node_id) of the commit-node links without nulls."""
    rows = table(spark, folder, "commit_node_links").where("commit_hash is not null and node_id is not null")
    return rows.select("project_id", F.lower("commit_hash").alias("hash"), "node_id").distinct()


def extension(path):
    """The extension of a path column, lower case, '' if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9+]+)$", 1))


def language_of(path):
    """The language of a path column by its extension, null if unknown."""
    pairs = [F.lit(x) for language, extensions in LANGUAGES.items() for e in extensions for x in (e, language)]
    return F.try_element_at(F.create_map(*pairs), extension(path))
