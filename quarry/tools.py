"""The named tools: one entry point for every question the engine answers, each giving a DataFrame (or a small dict)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.context import SessionMemory, edit_context, within_budget
from quarry.operators import graph, model, relational, risk, search, similarity
from quarry.plans import pattern
from quarry.sources import extract, files
from quarry.session import cut_lineage
from quarry.store import Store

NOTE = "id long, project_id long, node_id long, kind string, content string, tags string, access_count long, last_accessed timestamp, created_at timestamp"
ADR = "id long, project_id long, title string, status string, context string, decision string, consequences string, created_at timestamp"
ACCESS = "node_id long, project_id long, ts timestamp"
PROJECT_TABLES = ("projects", "nodes", "edges", "git_commits", "commit_node_links", "node_pagerank", "file_clusters", "file_states", "memory_notes", "adrs", "semantic_changes", "access_log", "vectors")


class Graph:
    """The tables of a store, empty where they were never written, and the tools over them."""

    def __init__(self, spark: SparkSession, store: Store, rules: list[dict] | None = None, embedder: Callable[[Column], Column] = search.hashed_embedding, extractor: Callable[[DataFrame], DataFrame] = extract.extract_nodes, intent: Callable[[Column], Column] = risk.intent):
        """``embedder`` turns a text column into a vector column, ``extractor`` files into nodes, ``intent`` a text column into (intent, confidence, multiplier)."""
        self.spark, self.store, self.rules, self.session = spark, store, rules or [], SessionMemory()
        self.embedder, self.extractor, self.intent = embedder, extractor, intent
        self.tools: dict[str, Callable] = {name[5:]: getattr(self, name) for name in dir(self) if name.startswith("tool_")}

    def call(self, tool: str, /, **arguments: object) -> DataFrame | dict | None:
        """The answer of a tool; KeyError for an unknown one."""
        return self.tools[tool](**arguments)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if self.store.exists(name) else self.spark.createDataFrame([], schema)

    @property
    def projects(self) -> DataFrame:
        return self._read("projects", "id long, name string, root_path string, indexed_at timestamp")

    def _project(self, name: str) -> int:
        row = self.projects.where(F.col("name") == name).select("id").first()
        if row is None:
            raise KeyError(f"no project {name}")
        return row[0]

    def nodes(self, project: str | None = None) -> DataFrame:
        rows = self.store.read("nodes") if self.store.exists("nodes") else self.spark.createDataFrame([], model.NODE)
        return rows if project is None else rows.where(F.col("project_id") == self._project(project))

    def edges(self, project: str | None = None) -> DataFrame:
        rows = model.unique_edges(self.store.read("edges") if self.store.exists("edges") else self.spark.createDataFrame([], model.EDGE))
        return rows if project is None else rows.where(F.col("project_id") == self._project(project))

    def links(self) -> DataFrame:
        rows = self._read("commit_node_links", "project_id long, commit_hash string, node_id long")
        return rows.where("commit_hash is not null and node_id is not null").select("project_id", F.lower("commit_hash").alias("hash"), "node_id").distinct()

    def commits(self) -> DataFrame:
        return self._read("git_commits", "id long, project_id long, hash string, message string, author string, committed_at timestamp, intent_kind string").withColumn("hash", F.lower("hash"))

    def ranks(self) -> DataFrame:
        return self._read("node_pagerank", "project_id long, node_id long, pagerank double")

    def clusters(self) -> DataFrame:
        return self._read("file_clusters", "project_id long, file_path string, cluster_id long")

    def notes(self) -> DataFrame:
        return self._read("memory_notes", NOTE)

    def _seed(self, node_id: int) -> DataFrame:
        return self.spark.createDataFrame([(int(node_id),)], "seed long")

    def _named(self, found: DataFrame) -> DataFrame:
        return found.join(self.nodes().select(F.col("id").alias("node_id"), "name", "kind", "file_path", "qualified_name"), "node_id")

    # --- projects and indexing -----------------------------------------------------------------------------

    def tool_list_projects(self) -> DataFrame:
        return self.projects.orderBy("name")

    def tool_delete_project(self, name: str) -> dict:
        number = self._project(name)
        self.store.delete_project(number, PROJECT_TABLES)
        return {"deleted": number}

    def tool_index_repository(self, repo_path: str, name: str | None = None, max_commits: int = 1000) -> dict:
        """Read a repository, refresh changed files only, then rebuild calls, tests, similarity, ranks, clusters and vectors.

        The run is a job group of its own; ``job_id`` in the answer names it for get_job_status.
        """
        job = f"index-{uuid.uuid4().hex[:12]}"
        self.spark.sparkContext.setJobGroup(job, f"index {repo_path}")
        name = name or repo_path.rstrip("/").rsplit("/", 1)[-1]
        known = self.projects.where(F.col("name") == name).select("id").first()
        number = known[0] if known else (self.projects.agg(F.max("id")).first()[0] or 0) + 1
        self.store.upsert("projects", self.spark.createDataFrame([(number, name, repo_path)], "id long, name string, root_path string").withColumn("indexed_at", F.current_timestamp()), ["id"])
        read = files.walk_files(self.spark, repo_path).withColumn("project_id", F.lit(number).cast("long"))
        states = read.select("project_id", "file_path", F.sha2("source", 256).alias("content_hash"))
        old = self._read("file_states", "project_id long, file_path string, content_hash string").where(F.col("project_id") == number)
        moved = extract.state_diff(old, states).where("status <> 'same'")
        touched = moved.where("status in ('new', 'changed')").select("file_path")
        renewed = cut_lineage(read.join(touched, "file_path", "left_semi"))
        declared, declared_edges = extract.declared_graph(renewed)
        fresh = self.extractor(renewed)
        fresh = cut_lineage(fresh.unionByName(declared, allowMissingColumns=True).dropDuplicates(["id"]))
        before = self.nodes().where(F.col("project_id") == number).join(moved.select("file_path"), "file_path", "left_semi")
        counts = {r["status"]: r["count"] for r in moved.groupBy("status").count().collect()}
        changes = extract.semantic_diff(before, fresh).withColumn("changed_at", F.current_timestamp()) if known else None
        if changes is not None:
            self.store.append("semantic_changes", changes)
        if self.store.exists("nodes"):
            self.store.delete_files(number, moved.select("file_path"))
        full = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in model.NODE])
        self.store.append("nodes", full)
        self.store.delete("file_states", f"project_id = {number}")
        self.store.append("file_states", states)
        nodes = self.nodes().where(F.col("project_id") == number)
        built = extract.contains_edges(nodes).unionByName(extract.resolve_calls(nodes)).unionByName(extract.test_contracts(nodes))
        near = similarity.similar_pairs(similarity.signatures(nodes)).select(F.lit(number).cast("long").alias("project_id"), F.col("a").alias("source_node_id"), F.col("b").alias("target_node_id"), F.lit("similar_to").alias("kind"), F.format_string('{"jaccard_score": %.3f}', "similarity").alias("metadata"))
        bare = built.unionByName(declared_edges).distinct()
        rows = bare.withColumn("metadata", F.lit(None).cast("string")).unionByName(near).withColumn("id", F.xxhash64("source_node_id", "target_node_id", "kind")).withColumn("created_at", F.current_timestamp())
        self.store.delete("edges", f"project_id = {number} and kind in ('contains', 'calls', 'test_of', 'similar_to')")
        self.store.insert_new("edges", rows.select(*[f.name for f in model.EDGE]), ["source_node_id", "target_node_id", "kind"])
        self._derive(number)
        self.embed_pending()
        try:
            self.tool_index_git_history(name, repo_path, max_commits)
        except Exception as trouble:  # noqa: BLE001  a tree without history is indexed without it
            counts["history"] = str(trouble).split("\n")[0]
        return {"project_id": number, "job_id": job, **counts}

    def tool_reindex_changed(self, repo_path: str, files: list[str] | None = None) -> dict:
        """As index_repository; files are told apart by content hash, so naming them is not needed."""
        return self.tool_index_repository(repo_path)

    def _derive(self, number: int) -> None:
        members = self.nodes().where(F.col("project_id") == number).select("project_id", F.col("id").alias("node_id"))
        arcs = graph.dependency_edges(self.edges().where(F.col("project_id") == number))
        self.store.upsert("node_pagerank", graph.pagerank(members, arcs, previous=self.ranks()), ["project_id", "node_id"])
        grouped = graph.file_clusters(graph.communities(members, arcs), self.nodes())
        self.store.delete("file_clusters", f"project_id = {number}")
        self.store.append("file_clusters", grouped)

    def tool_get_job_status(self, job_id: str) -> dict:
        """Active jobs of a Spark job group."""
        tracker = self.spark.sparkContext.statusTracker()
        return {"job_id": job_id, "jobs": list(tracker.getJobIdsForGroup(job_id)), "active": [j for j in tracker.getActiveJobsIds() if j in tracker.getJobIdsForGroup(job_id)]}

    def tool_index_git_history(self, project: str, repo_path: str, max_commits: int = 500) -> dict:
        number = self._project(project)
        log = files.git_log(self.spark, repo_path, max_commits).persist()
        heads = log.groupBy("hash", "short_hash", "author", "committed_at", "message").agg(F.count("file_path").alias("files_changed"))
        rows = heads.select(F.xxhash64(F.lit(number), "hash").alias("id"), F.lit(number).cast("long").alias("project_id"), "hash", "short_hash", "message", "author", "committed_at", relational.commit_kind(F.col("message")).alias("intent_kind"), "files_changed")
        self.store.insert_new("git_commits", rows, ["project_id", "hash"])
        linked = files.suffix_links(log, self.nodes(project)).select(F.lit(number).cast("long").alias("project_id"), F.col("hash").alias("commit_hash"), "node_id", "change_type")
        self.store.insert_new("commit_node_links", linked, ["commit_hash", "node_id"])
        log.unpersist()
        return {"project_id": number}

    # --- search --------------------------------------------------------------------------------------------

    def tool_search_symbol(self, project: str, query: str, limit: int = 20) -> DataFrame:
        return relational.search_symbol(self.nodes(project), query, limit)

    def tool_search_code(self, project: str, query: str, limit: int = 20) -> DataFrame:
        texts = self.nodes().select("id", "project_id", F.concat_ws(" ", "name", "qualified_name", "signature", "doc_comment", "source").alias("text"))
        own = self.nodes(project).select(F.col("id").alias("doc"))
        found = search.bm25(texts, "id", "text", self.spark.createDataFrame([(1, query)], "query_id long, query string"), limit, stemmed=True, only=own)
        inside = self.nodes(project).select(F.col("id").alias("doc"), "name", "kind", "file_path", search.snippet(F.col("source")).alias("snippet"))
        return found.join(inside, "doc").orderBy("score", "doc").limit(limit)

    def tool_hybrid_search(self, project: str, query: str, limit: int = 20) -> DataFrame:
        asked = self.spark.createDataFrame([(1, query)], "query_id long, query string")
        nodes = self.nodes(project)
        text = search.bm25(nodes.select("id", F.concat_ws(" ", "name", "qualified_name", "source").alias("text")), "id", "text", asked, limit, stemmed=True).withColumnRenamed("doc", "item")
        lists = [text]
        if self.store.exists("vectors"):
            embedded = asked.select("query_id", self.embedder(F.col("query")).alias("embedding"))
            lists.append(search.vector_search(self.store.read("vectors").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi"), embedded, limit).withColumnRenamed("node_id", "item"))
        return search.fuse(lists, self.ranks(), limit).join(nodes.select(F.col("id").alias("item"), "name", "kind", "file_path"), "item")

    def tool_semantic_search(self, project: str, query: str, limit: int = 10) -> DataFrame:
        return self.tool_hybrid_search(project, query, limit)

    def embed_pending(self) -> None:
        """Vectors for the nodes that have none, by the embedder; a node has one vector."""
        vectors = self._read("vectors", "node_id long, embedding array<double>")
        fresh = relational.pending(self.nodes().where("source is not null"), vectors).select(F.col("id").alias("node_id"), self.embedder(F.col("source")).alias("embedding"))
        self.store.upsert("vectors", fresh, ["node_id"])

    def tool_query_graph(self, project: str, query: str) -> DataFrame:
        return pattern.run(query, self.nodes(), self.edges(), self._project(project))

    def tool_find_symbol_everywhere(self, symbol_name: str) -> DataFrame:
        return relational.symbol_everywhere(self.nodes(), symbol_name)

    def tool_find_similar(self, node_id: int, threshold: float = 0.7) -> DataFrame:
        """Stored neighbours of a node; those of the nodes it is a copy of are its own."""
        return similarity.neighbours(self.edges(), node_id, threshold)

    # --- graph -----------------------------------------------------------------------------------------------

    def tool_get_callers(self, node_id: int, max_depth: int = 3) -> DataFrame:
        return self._named(graph.callers(self.edges(), self._seed(node_id), max_depth))

    def tool_get_callees(self, node_id: int, max_depth: int = 3) -> DataFrame:
        return self._named(graph.callees(self.edges(), self._seed(node_id), max_depth))

    def tool_get_imports(self, node_id: int) -> DataFrame:
        return relational.related(self.edges(), self.nodes(), "imports").where(F.col("node_id") == node_id)

    def tool_get_dependents(self, node_id: int) -> DataFrame:
        return relational.related(self.edges(), self.nodes(), "calls", outgoing=False).where(F.col("node_id") == node_id)

    def tool_impact_analysis(self, node_id: int, max_depth: int = 5) -> DataFrame:
        return graph.impact(self.edges(), self.nodes(), self.ranks(), self._seed(node_id), max_depth)

    def tool_find_path(self, from_node_id: int, to_node_id: int, max_depth: int = 10) -> DataFrame:
        arcs = self.edges().select(F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"))
        return graph.paths(arcs, self.spark.createDataFrame([(int(from_node_id), int(to_node_id))], "seed long, goal long"), max_depth).orderBy("seq")

    def tool_find_dead_code(self, project: str) -> DataFrame:
        return relational.dead_code(self.nodes(project), self.edges()).orderBy("file_path", "start_line")

    def tool_get_file_structure(self, project: str, file_path: str) -> DataFrame:
        return relational.file_structure(self.nodes(project), file_path)

    def tool_project_overview(self, project: str) -> DataFrame:
        return relational.project_stats(self.nodes(project), self.edges(project))

    def tool_get_stats(self, project: str) -> DataFrame:
        return self.tool_project_overview(project)

    def tool_get_status(self) -> DataFrame:
        vectors = self._read("vectors", "node_id long, embedding array<double>")
        parts = [("nodes", self.nodes()), ("edges", self.edges()), ("commits", self.commits()), ("vectors", vectors), ("pending", relational.pending(self.nodes(), vectors))]
        out = None
        for name, rows in parts:
            one = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
            out = one if out is None else out.unionByName(one)
        return out

    def tool_get_route_map(self, project: str) -> DataFrame:
        return relational.routes(self.nodes(project), self.edges())

    def tool_get_architecture(self, project: str) -> DataFrame:
        """(section, item, value): languages, entry points, packages, complex files, dead code and tests of a project."""
        nodes, edges = self.nodes(project), self.edges()
        line = lambda section, item, value: [F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("long").alias("value")]
        c = F.col
        parts = [
            relational.languages(nodes).select(*line("language", c("language"), c("files"))), relational.entry_points(nodes).select(*line("entry point", c("file_path"), F.lit(1))),
            relational.complex_files(nodes).select(*line("complex file", c("file_path"), c("complexity"))), relational.dead_code(nodes, edges).agg(F.count("*").alias("n")).select(*line("dead code", F.lit("symbols"), c("n"))),
            relational.test_split(nodes).select(*line("tests", F.lit("test files"), c("test_files"))), nodes.where("kind = 'manifest'").select(*line("package", F.get_json_object("metadata", "$.package_name"), F.get_json_object("metadata", "$.dependencies_count"))),
            nodes.where("kind = 'route'").select(*line("route", c("name"), F.lit(1))),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def tool_get_pagerank(self, node_id: int, project: str) -> DataFrame:
        top = self.ranks().where(F.col("project_id") == self._project(project))
        own = top.where(F.col("node_id") == node_id).withColumn("place", F.lit("node"))
        return own.unionByName(top.orderBy(F.col("pagerank").desc(), "node_id").limit(10).withColumn("place", F.lit("top"))).withColumn("is_hub", F.col("pagerank") > 0.05)

    def tool_get_clusters(self, project: str) -> DataFrame:
        """The files of each cluster, with how many clusters the project has."""
        rows = self.clusters().where(F.col("project_id") == self._project(project))
        return rows.join(rows.agg(F.countDistinct("cluster_id").alias("clusters"))).orderBy("cluster_id", "file_path")

    def tool_check_boundaries(self, project: str) -> DataFrame:
        located = self.nodes(project).where("kind = 'file'").select(F.col("id").alias("node_id"), "file_path")
        return graph.check_boundaries(graph.dependency_edges(self.edges(project)), located, self.rules)

    def tool_suggest_boundaries(self, project: str) -> DataFrame:
        return graph.suggest_boundaries(self.tool_get_clusters(project))

    def tool_generate_wiki(self, project: str) -> dict:
        """A Markdown page of at most 20 files for each cluster of one project."""
        grouped = self.tool_get_clusters(project).groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_set("file_path")), 1, 20).alias("files"))
        rows = [(r["cluster_id"], f) for r in grouped.collect() for f in r["files"]]
        named = self.clusters().join(self.nodes(project).select("project_id", "file_path", F.col("id").alias("node_id")), ["project_id", "file_path"])
        quality = graph.modularity(named.select("node_id", "cluster_id"), graph.dependency_edges(self.edges(project))).first()
        return {"wiki": graph.render_wiki(rows, quality["modularity"] if quality else 0.0)}

    # --- risk ------------------------------------------------------------------------------------------------

    def _risk(self, project: str) -> tuple[DataFrame, DataFrame]:
        nodes = self.nodes(project)
        coupling = relational.change_coupling(nodes, self.links(), 1)
        features = risk.node_features(nodes, self.edges(), self.links(), self.ranks(), relational.coupling_strength(coupling))
        base = risk.baselines(nodes, self.ranks(), coupling)
        return features.join(risk.node_risk(features, base).select("node_id", "score", "level"), "node_id"), base

    def _resolved(self, project: str, targets: list[dict]) -> DataFrame:
        """(k, node_id, path): the least node each of a plan's few targets names, by path suffix and symbol or as a file; one scan."""
        path = F.replace("file_path", F.lit("\\"), F.lit("/"))
        named = []
        for k, target in enumerate(targets):
            suits = F.lower(path).endswith(target["file_path"].replace("\\", "/").lower())
            suits &= F.col("name") == target["symbol_name"] if target.get("symbol_name") else F.col("kind") == "file"
            named.append(F.when(suits, F.lit(k)))
        hits = self.nodes(project).select("id", "file_path", F.explode(F.array_compact(F.array(*named))).alias("k"))
        return hits.groupBy("k").agg(F.min(F.struct("id", "file_path")).alias("h")).select("k", F.col("h.id").alias("node_id"), F.col("h.file_path").alias("path"))

    def tool_evaluate_plan_risk(self, project: str, targets: list[dict]) -> dict:
        """Score, level, strategies and a safe order for a plan's few targets; a target that is not found scores 0.05.

        A stated intent scales the coupling and prunes strategies it makes false alarms. A denied edge between the targets'
        files adds 0.15, each pair of targets with a path of at most five edges 0.05, up to 0.2.
        """
        if not targets:
            return {"overall": 0.0, "level": "LOW", "targets": [], "strategies": [], "pruned": [], "violations": [], "order": [], "confidence": self._confidence(project)}
        wanted = self.spark.createDataFrame([(k, t.get("change_intent")) for k, t in enumerate(targets)], "k int, text string")
        resolved = cut_lineage(wanted.join(self._resolved(project, targets), "k", "left").withColumn("i", self.intent(F.col("text"))))
        features, base = self._risk(project)
        mine = resolved.where("node_id is not null").select("k", "node_id", "path", "i").join(features.drop("score", "level"), "node_id")
        scale = F.when(F.col("i.intent") == "unknown", F.lit(1.0)).otherwise(F.least(F.greatest(F.col("i.multiplier"), F.lit(0.0)), F.lit(1.0)))
        mine = mine.withColumn("change_coupling_count", F.round(F.col("change_coupling_count") * scale).cast("long"))
        mine = cut_lineage(mine.join(base.select("project_id"), "project_id", "left_semi"))
        scored = cut_lineage(mine.select("k", "project_id", F.col("node_id").alias("real"), "name", "file_path", F.col("k").cast("long").alias("node_id"), *[c for c in mine.columns if c not in ("k", "project_id", "node_id", "name", "file_path", "i", "path")]))
        scores = {r["node_id"]: r["score"] for r in risk.node_risk(scored, base).collect()}
        rows = {r["k"]: r for r in resolved.collect()}
        per_target = [scores.get(k, 0.05) for k in range(len(targets))]
        ids = [rows[k]["node_id"] for k in range(len(targets)) if rows[k]["node_id"] is not None]
        violations = self._violations(project, [rows[k]["path"] for k in rows if rows[k]["path"]])
        overall = sum(per_target) / len(targets)
        overall = min(1.0, overall + 0.15) if violations else overall
        overall = min(1.0, overall + self._interactions(ids))
        given = mine.join(self.spark.createDataFrame([(k, float(s)) for k, s in scores.items()], "k int, score double"), "k") if scores else None
        kept, pruned = self._strategies(given, base, rows) if given is not None else ([], [])
        seeds = self.spark.createDataFrame([(h,) for h in ids], "seed long")
        depends = [(r["seed"], r["node_id"]) for r in graph.callees(self.edges(), seeds, 2).where(F.col("node_id").isin(ids)).collect()] if ids else []
        return {
            "overall": overall, "level": "CRITICAL" if overall >= 0.7 else "MEDIUM" if overall >= 0.4 else "LOW",
            "targets": [{"target": targets[k], "node_id": rows[k]["node_id"], "score": per_target[k], "intent": rows[k]["i"]["intent"]} for k in range(len(targets))],
            "strategies": kept, "pruned": pruned, "violations": violations,
            "order": risk.safe_order([(rows[k]["node_id"], per_target[k]) for k in range(len(targets)) if rows[k]["node_id"] is not None], depends), "confidence": self._confidence(project),
        }

    def _confidence(self, project: str) -> float:
        found = risk.confidence(self.nodes(project), self.commits()).first()
        return found["confidence"] if found else 0.5

    def _violations(self, project: str, paths: list[str]) -> list[str]:
        """Denied edges between the files of the targets."""
        if not self.rules or not paths:
            return []
        located = self.nodes(project).where((F.col("kind") == "file") & F.col("file_path").isin(paths)).select(F.col("id").alias("node_id"), "file_path")
        found = graph.check_boundaries(graph.dependency_edges(self.edges(project)), located, self.rules)
        return sorted({f"{r['from_path']} -> {r['to_path']} violates {r['deny']}" for r in found.collect()})

    def _interactions(self, ids: list[int]) -> float:
        """0.05 for each pair of targets, in their order, with a path of at most five edges; 0.2 at most."""
        pairs = sorted({(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if a != b})
        if not pairs:
            return 0.0
        arcs = self.edges().select(F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"))
        way = graph.paths(arcs, self.spark.createDataFrame(pairs, "seed long, goal long"), 5)
        return min(0.2, 0.05 * way.select("seed", "goal").distinct().count())

    def _strategies(self, given: DataFrame, base: DataFrame, rows: dict) -> tuple[list[dict], list[dict]]:
        """(kept, pruned) advice for the targets, the greatest effect first, each text once."""
        found = risk.strategies(given, base, risk.interfaces(self.edges()), risk.alternatives(self.nodes()), risk.central_callers(self.edges(), self.ranks(), base))
        names = {r["node_id"]: r["name"] or r["file_path"] for r in given.select("node_id", "name", "file_path").collect()}
        intents = {r["node_id"]: r["i"]["intent"] for r in rows.values() if r["node_id"] is not None}
        kept, pruned, seen = [], [], set()
        for r in sorted(found.distinct().collect(), key=lambda r: (-r["delta"], r["node_id"], r["strategy"])):
            advice = {"node_id": r["node_id"], "strategy": r["strategy"], "delta": r["delta"], "priority": r["priority"]}
            if r["strategy"] in risk.PRUNED.get(intents.get(r["node_id"]), ()):
                pruned.append(advice)
            elif (text := (r["strategy"], names[r["node_id"]])) not in seen:
                seen.add(text)
                kept.append(advice)
        return kept, pruned

    def tool_plan_change(self, project: str, description: str, files: list[str]) -> dict:
        plan = self.tool_evaluate_plan_risk(project, [{"file_path": f, "change_intent": description} for f in files])
        paths = self.spark.createDataFrame([(f,) for f in files], "file_path string")
        tests = self.edges().where("kind = 'test_of'").join(self.nodes(project).join(paths, "file_path", "left_semi").select(F.col("id").alias("target_node_id")), "target_node_id").select("source_node_id").distinct()
        return plan | {"tests": [r[0] for r in tests.orderBy("source_node_id").toLocalIterator()]}

    def tool_detect_change_coupling(self, project: str, min_co_changes: int = 3) -> DataFrame:
        return relational.change_coupling(self.nodes(project), self.links(), min_co_changes)

    def tool_suggest_tests(self, project: str, limit: int = 15) -> DataFrame:
        return relational.suggest_tests(self.nodes(project), self.edges(), self.ranks(), limit)

    def tool_get_hotspots(self, project: str, limit: int = 20) -> DataFrame:
        return relational.hotspots(self.nodes(project), self.links(), limit)

    def tool_technical_debt_map(self, project: str) -> DataFrame:
        return relational.technical_debt(self.nodes(project), self.links())

    def tool_get_contracts(self, project: str, node_id: int) -> DataFrame:
        return relational.contracts(self.nodes(project), self.edges()).where(F.col("node_id") == node_id)

    def tool_git_archaeology(self, project: str, node_id: int) -> DataFrame:
        return relational.intent_breakdown(relational.node_history(self.links().where(F.col("node_id") == node_id), self.commits()))

    # --- memory, decisions, accesses -------------------------------------------------------------------------

    def _next(self, table: str, schema: str) -> int:
        return (self._read(table, schema).agg(F.max("id")).first()[0] or 0) + 1

    def tool_memory_store(self, project: str, content: str, kind: str = "note", tags: str | None = None, node_id: int | None = None) -> dict:
        number = self._next("memory_notes", NOTE)
        row = self.spark.createDataFrame([(number, self._project(project), node_id, kind, content, tags, 0, None, None)], NOTE).withColumn("created_at", F.current_timestamp())
        self.store.append("memory_notes", row)
        return {"id": number}

    def tool_memory_search(self, project: str, query: str, limit: int = 20) -> DataFrame:
        return relational.search_notes(self.notes().where(F.col("project_id") == self._project(project)), query, limit)

    def tool_memory_list(self, project: str, kind: str | None = None) -> DataFrame:
        rows = self.notes().where(F.col("project_id") == self._project(project))
        return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy(F.col("created_at").desc(), "id")

    def tool_memory_delete(self, id: int) -> dict:  # noqa: A002
        self.store.delete("memory_notes", f"id = {int(id)}")
        return {"deleted": id}

    def tool_session_remember(self, key: str, value: str, source: str = "agent") -> dict:
        self.session.remember(key, value, source)
        return {"key": key}

    def tool_session_recall(self, key: str) -> dict | None:
        return self.session.recall(key)

    def tool_manage_adr(self, project: str, action: str, adr_id: int | None = None, **fields: str) -> DataFrame | dict:
        number = self._project(project)
        rows = self._read("adrs", ADR).where(F.col("project_id") == number)
        if action == "list":
            return rows.orderBy("id")
        if action == "get":
            return rows.where(F.col("id") == adr_id)
        if action == "delete":
            self.store.delete("adrs", f"id = {int(adr_id)}")
            return {"deleted": adr_id}
        names = ("title", "status", "context", "decision", "consequences")
        if action == "create":
            adr_id = self._next("adrs", ADR)
            fields = {"status": "proposed", **fields}
        elif action != "update":
            raise ValueError(f"unknown action {action}")
        row = self.spark.createDataFrame([(adr_id, number, *[fields.get(n) for n in names], None)], ADR)
        self.store.upsert("adrs", row.withColumn("created_at", F.current_timestamp()), ["id"], keep_old=True)
        return {"id": adr_id}

    def record_access(self, node_id: int, project: str) -> None:
        """Log that a node was looked at; reads never log by themselves."""
        self.store.append("access_log", self.spark.createDataFrame([(node_id, self._project(project))], "node_id long, project_id long").withColumn("ts", F.current_timestamp()))

    def tool_get_working_set(self, project: str, limit: int = 30) -> DataFrame:
        return relational.working_set(self._read("access_log", ACCESS).where(F.col("project_id") == self._project(project)), limit=limit)

    def tool_get_recent_semantic_changes(self, project: str, hours: int = 24) -> DataFrame:
        rows = self._read("semantic_changes", "project_id long, file_path string, name string, change string, delta long, changed_at timestamp")
        return relational.recent(rows.where(F.col("project_id") == self._project(project)), "changed_at", hours)

    # --- context ------------------------------------------------------------------------------------------------

    def _around(self, node_id: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        rename = lambda df: df.select(F.col("node_id").alias("id"), "kind", "qualified_name", "file_path")
        return relational.by_id(self.nodes(), node_id), rename(self.tool_get_callers(node_id, depth)), rename(self.tool_get_callees(node_id, depth))

    def tool_get_context(self, node_id: int, max_depth: int = 2) -> DataFrame:
        return edit_context(*self._around(node_id, max_depth))

    def tool_get_edit_context(self, node_id: int, project: str) -> DataFrame:
        node = self.nodes(project).where(F.col("id") == node_id).select("name").first()
        return edit_context(*self._around(node_id, 1), self.tool_memory_search(project, node["name"] or "", 10) if node else None)

    def tool_explain_code(self, project: str, node_id: int) -> DataFrame:
        """The edit context with tests, history, rank and impact of a node as further sections."""
        c = F.col
        row = lambda df, section, text: df.select(F.lit(section).alias("section"), F.lit(node_id).cast("long").alias("position"), text.cast("string").alias("text"))
        return (
            edit_context(*self._around(node_id, 2)).unionByName(row(self.tool_get_contracts(project, node_id), "5 tests", c("test_ids"))).unionByName(row(self.tool_git_archaeology(project, node_id), "6 history", F.to_json(F.struct("*"))))
            .unionByName(row(self.ranks().where(c("node_id") == node_id), "7 pagerank", c("pagerank"))).unionByName(row(self.tool_impact_analysis(node_id, 2), "8 impact", F.to_json(F.struct("*"))))
            .unionByName(row(self.notes().where(c("node_id") == node_id), "9 notes", c("content"))).unionByName(row(self.tool_manage_adr(project, "list"), "9 decisions", F.concat_ws(": ", "title", "decision")))
        )

    def tool_prepare_task_context(self, project: str, task: str, max_tokens: int = 4000) -> DataFrame:
        """Search hits, the impact and neighbours of the best ones and notes for a task, cut to the token budget."""
        hits = self.tool_hybrid_search(project, task, 15)
        out = hits.select(F.lit("1 hits").alias("section"), F.col("rank").cast("long").alias("position"), F.concat_ws(" ", "kind", "name", "file_path").alias("text"))
        best = [r["item"] for r in hits.orderBy("rank").select("item").limit(3).collect()]
        if best:
            out = out.unionByName(self.tool_impact_analysis(best[0], 3).select(F.lit("2 impact").alias("section"), F.lit(0).cast("long").alias("position"), F.to_json(F.struct("*")).alias("text")))
        notes = self.tool_memory_search(project, task, 10).select(F.lit("3 notes").alias("section"), F.col("id").alias("position"), F.col("content").alias("text"))
        out = out.unionByName(notes)
        for node_id in best:
            out = out.unionByName(self.tool_get_context(node_id, 1).where("section <> '1 node'").withColumn("section", F.concat(F.lit("4 "), "section")))
        return within_budget(out, max_tokens)

    def tool_link_cross_project(self, source_node_id: int, target_node_id: int, project: str) -> dict:
        row = self.spark.createDataFrame([(self._project(project), int(source_node_id), int(target_node_id), "cross_project", None)], "project_id long, source_node_id long, target_node_id long, kind string, metadata string")
        row = row.withColumn("id", F.xxhash64("source_node_id", "target_node_id", "kind")).withColumn("created_at", F.current_timestamp())
        self.store.insert_new("edges", row.select(*[f.name for f in model.EDGE]), ["source_node_id", "target_node_id", "kind"])
        return {"linked": [source_node_id, target_node_id]}
