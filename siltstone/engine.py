"""One object for what a user does: index a repository, look, search, compile evidence, map a graph, evaluate."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import token_estimate
from siltstone.operators import communities, evaluation, fusion, graph, graph_build, history, incremental, lexical, routing, selection, semantic, symbols
from siltstone.plans.ship import ship
from siltstone.plans.stage import stage
from siltstone.sinks import render
from siltstone.sinks.tables import COMMITS, EDGES, FILES, NODES, VECTORS, Store
from siltstone.sources import artifacts, files, python_units, records

PROVIDER = "local-hash-v1"
#: What each retriever returns while compiling, and the weight of the second pass.
FIRST = {"lexical": 40, "symbol": 25, "semantic": 35}
SECOND = {"lexical": 20, "symbol": 12, "semantic": 20}
ANCHORS, COMMITS_SHOWN, HOTSPOTS_SHOWN, SECOND_PASS, LEAST_BUDGET, SLACK = 8, 5, 10, 0.7, 512, 32
#: Parts of the pipeline that can be left out, and the sources that go with them.
PARTS = {"semantic": {"semantic"}, "graph": {"call_graph", "imports", "inheritance"}, "history": {"git_history", "hotspots"}, "test_discovery": {"related_tests"},
         "query_evolution": set(), "routing": set(), "token_optimization": set(), "redundancy_penalty": set()}
#: Evaluated configurations: lists of retrievers, or the parts that the pipeline leaves out.
CONFIGURATIONS = {
    "filename": None, "bm25_symbols": "ls", "semantic": "v", "hybrid": "lsv",
    "hybrid_graph": ("routing", "history", "test_discovery", "query_evolution"), "hybrid_graph_history": ("routing", "test_discovery", "query_evolution"), "full": (),
}


class Engine:
    """A repository, its store and the verbs on it."""

    def __init__(self, spark: SparkSession, repository: str, settings: records.Settings | None = None, store: str | None = None):
        self.spark, self.repository = ship(spark), os.path.realpath(repository)
        self.settings = settings or records.Settings.load(self.repository)
        self.store = Store(spark, store or os.path.join(self.repository, self.settings.folder))

    # -- tables ---------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        schemas = {"files": FILES, "units": python_units.UNIT, "hints": python_units.HINT, "vectors": VECTORS, "nodes": NODES, "edges": EDGES, "commits": COMMITS}
        return self.store.read(name, schemas[name])

    # -- verbs ----------------------------------------------------------------

    def index(self) -> dict:
        """Read new and changed files, drop deleted ones, rebuild the graph, embed pending units, read the history."""
        s, now = self.settings, dt.datetime.now(dt.UTC)
        current = files.discover(self.spark, self.repository, most_bytes=s.max_file_bytes).cache()
        known = self.table("files")
        change = incremental.diff(current, known).cache()
        todo = current.join(change.where(F.col("change").isin("new", "changed")).select("path"), "path", "left_semi")
        units, hints, errors = python_units.read(todo.select("path", "content"))
        units, hints, errors = units.cache(), hints.cache(), errors.cache()
        gone = change.where("change = 'deleted'")
        row = todo.select("path", F.lit(os.path.basename(self.repository)).alias("repository"), "content_hash", "mtime_ns", "size_bytes", F.lit(now).cast("timestamp").alias("indexed_at"))
        fine = row.join(errors, "path", "left_anti").withColumn("parse_error", F.lit(None).cast("string"))
        state = {k: self.table(k) for k in ("files", "units", "hints", "vectors")}
        dropped = state["units"].join(gone.select("path"), "path", "left_semi").select(F.col("unit_id").alias("source_id")).distinct()
        state["hints"] = state["hints"].join(dropped, "source_id", "left_anti")
        for k in ("files", "units"):
            state[k] = incremental.drop_files(state[k], gone)
        state = incremental.apply_parse(state, {"files": fine, "units": units, "hints": hints})
        state["files"] = incremental.record_errors(state["files"], row.join(errors, "path"))  # the units of a file that no longer parses stay
        counts = {r.change: r["count"] for r in change.groupBy("change").count().collect()}
        new_files = self.store.write("files", state["files"].select(*known.columns))
        new_units = self.store.write("units", state["units"])
        new_hints = self.store.write("hints", state["hints"])
        pending = semantic.pending(new_units, state["vectors"], PROVIDER).count()
        self.store.write("vectors", semantic.refresh(incremental.drop_stale_vectors(self.table("vectors"), new_units), new_units, PROVIDER, s.semantic_dimensions))
        nodes, edges = graph_build.build(new_units, new_hints, os.path.basename(self.repository))
        commits = records.git_log(self.spark, self.repository)
        if commits is not None:
            commits = self.store.write("commits", commits)
            touched = commits.select("commit_hash", F.explode("files.path").alias("path")).distinct()
            edges = edges.unionByName(history.history_edges(touched, new_units))
            nodes = nodes.unionByName(commits.select(F.concat(F.lit("commit:"), "commit_hash").alias("node_id"), F.lit("commit").alias("node_type"), F.lit(None).cast("string").alias("path"), F.col("message").alias("label"), F.lit(None).cast("string").alias("unit_id")))
        self.store.write("nodes", nodes)
        self.store.write("edges", edges)
        for x in (current, change, units, hints, errors):
            x.unpersist()
        return {"new": counts.get("new", 0), "changed": counts.get("changed", 0), "unchanged": counts.get("unchanged", 0), "deleted": counts.get("deleted", 0),
                "embedded": pending, "parse_errors": new_files.where("parse_error is not null").count(), "history": commits is not None}

    def status(self) -> DataFrame:
        """Row counts of all tables."""
        return incremental.status(**{k: self.table(k) for k in ("files", "units", "nodes", "edges", "vectors", "commits")})

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Hybrid search: BM25 and vectors, fused and reranked."""
        units = self.table("units")
        rows = self._lexical(units, query, max(2 * limit, 20), 0).unionByName(self._semantic(units, query, max(2 * limit, 20), 1000))
        return fusion.rerank(fusion.merge(rows), units, query).where(F.col("rank") <= limit).orderBy("rank")

    def search_symbols(self, query: str, limit: int = 20) -> DataFrame:
        units = self.table("units")
        return fusion.rerank(fusion.merge(self._symbol(units, query, 2 * limit, 0)), units, query).where(F.col("rank") <= limit).orderBy("rank")

    def neighbors(self, node_id: str, **options) -> DataFrame:
        start = self.spark.createDataFrame([(node_id,)], "start string")
        return graph.neighbors(self.table("edges"), start, nodes=self.table("nodes"), **options)

    def callers(self, node_id: str) -> DataFrame:
        return graph.callers(self.table("edges"), self.table("nodes"), node_id)

    def callees(self, node_id: str) -> DataFrame:
        return graph.callees(self.table("edges"), self.table("nodes"), node_id)

    def history(self, task: str, *, anchors=(), limit: int = 8, as_of=None) -> DataFrame:
        """Commits that bear on a task, as of a time (now)."""
        commits = self.table("commits").select("commit_hash", "message", "authored_at", "author_name", F.col("files.path").alias("changed_files"),
                                               F.concat(F.size("files"), F.lit(" files changed")).alias("summary"))
        return history.search(commits, self.table("files"), task, as_of or dt.datetime.now(dt.UTC), anchors=anchors, limit=limit, stem=True)

    def _lexical(self, units, text, limit, seq):
        hits = lexical.search(units, text, limit=limit)
        why = F.concat(F.lit("BM25 matched "), F.array_join(F.slice("matched_terms", 1, 6), ", "))
        return fusion.signals(hits, "bm25", "score", reason=why, seq=seq)

    def _symbol(self, units, text, limit, seq):
        hits = symbols.search(units, text, limit=limit)
        return fusion.signals(hits, "symbol_search", "score", reason=F.concat(F.when(F.col("exact"), F.lit("symbol ")).otherwise(F.lit("similar symbol ")), "name"), seq=seq, exact=F.col("exact"))

    def _semantic(self, units, text, limit, seq):
        hits = semantic.search(units, self.table("vectors"), text, limit=limit, provider=PROVIDER, dimensions=self.settings.semantic_dimensions)
        return fusion.signals(hits, "semantic", "similarity", reason=F.lit("similar text"), seq=seq)

    def compile(self, task: str, token_budget: int = 8000, *, as_of=None, without=(), history_candidates: bool = False) -> dict:
        """An evidence package whose Markdown never exceeds ``token_budget`` (at least 512).

        Route, retrieve anchors, expand the graph and find tests, search once
        more with derived terms, fuse, rerank, select under what the header
        leaves, and drop the weakest items until the text fits.  A header that
        alone exceeds the budget raises.  Only bounded candidate lists reach the driver.
        ``without`` names parts (:data:`PARTS`) to leave out; without routing all
        sources take part.  ``history_candidates`` adds the files of the commits found to the candidates.
        """
        unknown = set(without) - PARTS.keys()
        if unknown:
            raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
        redundancy, optimise = "redundancy_penalty" not in without, "token_optimization" not in without
        if token_budget < LEAST_BUDGET:
            raise ValueError(f"a budget has at least {LEAST_BUDGET} tokens")
        units, nodes, edges = self.table("units"), self.table("nodes"), self.table("edges")
        routed = routing.route(self.spark.createDataFrame([(task,)], "task string")).first()
        chosen = {"lexical", "symbol", "semantic", *routing.EXTRA} if "routing" in without else set(routed.selected_sources)
        chosen -= set().union(*(PARTS[w] for w in without))
        package = {"task": task, "repository": os.path.basename(self.repository), "token_budget": token_budget, "estimated_tokens": 0, "task_type": routed.task_type,
                   "selected_sources": list(routed.selected_sources), "items": [], "commits": [], "hotspots": [], "concepts": [], "decisions": [], "anchors": []}
        if routed.task_type == "none":
            package["estimated_tokens"] = render.estimated_tokens(render.package_markdown(package))
            return package
        first = []
        if "lexical" in chosen:
            first.append(self._lexical(units, task, FIRST["lexical"], 0))
        if "symbol" in chosen:
            first.append(self._symbol(units, task, FIRST["symbol"], 1000))
        if "semantic" in chosen:
            first.append(self._semantic(units, task, FIRST["semantic"], 2000))
        initial = stage(self._union(first), "signals")
        ranked = stage(fusion.rerank(fusion.merge(initial), units, task, redundancy=redundancy), "ranked")
        anchors = ranked.where(F.col("rank") <= ANCHORS)
        held = anchors.select("unit_id", "path").collect()
        package["anchors"] = [r.unit_id for r in held]
        later = []
        kinds = [k for s, k in (("call_graph", "calls"), ("imports", "imports"), ("inheritance", "inherits")) if s in chosen]
        if kinds:
            strength = anchors.select("unit_id", F.array_max(F.map_values("source_scores")).alias("strength"))
            later.append(routing.expand(strength, edges, nodes, edge_types=("defines", "references", *kinds), max_depth=self.settings.graph_max_depth, max_nodes=self.settings.graph_max_nodes, seq=3000))
        if "related_tests" in chosen:
            later.append(fusion.signals(routing.related_tests(anchors, units, edges, nodes, task), "related_tests", "score", reason=F.lit("likely test"), seq=4000))
        concepts = [] if "query_evolution" in without else routing.evolve(ranked, edges, nodes, task)
        if concepts:
            text = f"{task} {' '.join(concepts)}"
            second = [self._lexical(units, text, SECOND["lexical"], 5000), self._symbol(units, text, SECOND["symbol"], 6000)]
            if "semantic" in chosen:
                second.append(self._semantic(units, text, SECOND["semantic"], 7000))
            second = stage(self._union(second), "signals")
            best = second.groupBy("unit_id").agg((F.max("score") * SECOND_PASS).alias("score"))
            later += [second, fusion.signals(best, "query_evolution", "score", reason=F.lit("found in the second pass"), seq=8000)]
        package["concepts"] = concepts
        if "git_history" in chosen:
            commits = stage(self.history(task, anchors=[r.path for r in held], limit=COMMITS_SHOWN, as_of=as_of), "commits")
            package["commits"] = [r.asDict(True) for r in commits.collect()]
            if history_candidates:
                later.append(history.candidates(commits, units, seq=9000))
        if "hotspots" in chosen:
            touched = self.table("commits").select("commit_hash", F.explode("files.path").alias("path")).distinct()
            package["hotspots"] = [(r.path, r.changes) for r in history.hotspots(touched, self.table("files"), HOTSPOTS_SHOWN).collect()]
        everything = stage(fusion.rerank(fusion.merge(stage(self._union([initial, *later]), "signals")), units, task, redundancy=redundancy).withColumn("task_id", F.lit("task")), "ranked")
        reserve = render.estimated_tokens(render.package_markdown(package)) + SLACK
        if reserve - SLACK > token_budget:
            raise ValueError(f"the package without evidence has {reserve - SLACK} tokens already")
        left = max(0, token_budget - reserve)
        if optimise:
            decided = selection.select(everything, left)
        else:
            priced = everything.select("task_id", "unit_id", "rank", token_estimate(F.col("content")).alias("cost"))
            decided = selection.first_fit(priced, left, group="task_id", order=["rank"], cost="cost").select("task_id", "unit_id", F.lit(True).alias("selected"), F.col("rank").alias("place"), "cost", F.lit(0.0).alias("utility"), F.lit("fits in rank order").alias("reason"))
        decisions = {r.unit_id: r.asDict() for r in decided.collect()}
        picked = [u for u, d in decisions.items() if d["selected"]]
        rows = {r.unit_id: r for r in everything.where(F.col("unit_id").isin(picked)).collect()}
        for u in sorted(picked, key=lambda u: decisions[u]["place"]):
            r, d = rows[u], decisions[u]
            package["items"].append({"unit_id": u, "file": r.path, "symbol": r.qualname, "start_line": r.start_line, "end_line": r.end_line, "estimated_tokens": d["cost"], "score": r.score,
                                     "why_selected": " ".join([d["reason"] + ".", *r.reasons[:3]]), "retrieved_by": list(r.retrieved_by), "content_hash": r.content_hash, "content": r.content or "",
                                     "language": r.language, "is_test": r.is_test})
        while True:
            for _ in range(3):  # the number of tokens is part of the text
                package["estimated_tokens"] = render.estimated_tokens(render.package_markdown(package))
            if package["estimated_tokens"] <= token_budget or not package["items"]:
                break
            worst = min(package["items"], key=lambda i: (i["score"], -i["estimated_tokens"]))
            package["items"].remove(worst)
            decisions[worst["unit_id"]].update(selected=False, place=None, reason="taken out so that the text fits")
        package["decisions"] = list(decisions.values())
        return package

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def map(self, output: str | None = None, name: str | None = None) -> dict:
        """Graph of all supported languages with communities; writes graph.json, report.md and graph.html if asked to."""
        found = files.discover_all(self.spark, self.repository, most_bytes=self.settings.max_file_bytes)
        raw_nodes, raw_edges, meta = artifacts.extract(found)
        nodes, edges = graph_build.resolve_artifacts(raw_nodes.cache(), raw_edges.cache())
        nodes = nodes.withColumnsRenamed({"id": "node_id", "kind": "node_type", "source_file": "path"}).cache()
        edges = edges.withColumnsRenamed({"source": "source_id", "target": "target_id", "relation": "edge_type", "confidence": "confidence_label"}).withColumn("confidence", F.col("weight")).cache()
        member = communities.communities(nodes, edges).cache()
        if output:
            out_nodes = nodes.join(member, "node_id").withColumnsRenamed({"node_id": "id", "node_type": "kind", "path": "source_file"})
            out_edges = edges.drop("confidence").withColumnsRenamed({"source_id": "source", "target_id": "target", "edge_type": "relation", "confidence_label": "confidence"})
            label = name or os.path.basename(self.repository)
            render.write_graph(out_nodes, out_edges, os.path.join(output, "graph.json"), self.repository, repository=label)
            for file, text in (("report.md", render.report(label, nodes, edges, member)), ("graph.html", render.page(label, nodes, edges))):
                with open(os.path.join(output, file), "w", encoding="utf-8") as f:
                    f.write(text)
        return {"nodes": nodes, "edges": edges, "communities": member, "extractions": meta}

    def evaluate(self, tasks: DataFrame, *, top_k: int = 10, token_budget: int = 8000, configurations=tuple(CONFIGURATIONS), ablations=()) -> DataFrame:
        """Mean metrics per configuration, and of ``full`` without each of the parts in ``ablations``.

        ``bm25_symbols`` searches text and symbols; the graph and history
        configurations and ``full`` are :meth:`compile` with parts left out, so an
        ablation differs in its part alone.  Tasks are a benchmark's list; each is one run of the pipeline.
        """
        runs = [(c, "") for c in configurations] + [("full", p) for p in ablations]
        units = self.table("units")
        corpus = units.where("node_type = 'file'").agg(F.sum(token_estimate(F.col("content"))).alias("n")).first().n or 0
        listed = tasks.select(F.col("id").alias("task_id"), "task", "gold_files", "gold_symbols", "gold_line_ranges").cache()
        rows = []
        for t in listed.select("task_id", "task").collect():  # a benchmark's tasks
            for c, p in runs:
                for rank, i in enumerate(self._retrieve(units, t.task, c, p, top_k, token_budget), 1):
                    rows.append((c, p, t.task_id, rank, *i))
        schema = "configuration string, ablation string, task_id string, rank int, file string, symbol string, start_line int, end_line int, estimated_tokens int, sources array<string>"
        items = stage(self.spark.createDataFrame(rows, schema), "items")
        total = listed.select("task_id", F.lit(corpus).cast("long").alias("repository_source_tokens"))
        parts = [evaluation.metrics(listed, items.where((F.col("configuration") == c) & (F.col("ablation") == p)), top_k, total).withColumns({"configuration": F.lit(c), "ablation": F.lit(p)}) for c, p in runs]
        return evaluation.mean_metrics(self._union([stage(x, "metrics") for x in parts]), "configuration", "ablation")

    def _retrieve(self, units, task, configuration, ablation, top_k, budget):
        use = CONFIGURATIONS[configuration]
        if isinstance(use, tuple):
            without = {*use, *([ablation] if ablation else [])}
            package = self.compile(task, budget, without=without, history_candidates="history" not in without)
            return [(i["file"], i["symbol"], i["start_line"], i["end_line"], i["estimated_tokens"], i["retrieved_by"]) for i in package["items"]]
        if configuration == "filename":
            one = self.spark.createDataFrame([("t", task)], "task_id string, task string")
            hit = evaluation.filename_baseline(self.table("files"), one).where(F.col("rank") <= top_k).select(F.col("file").alias("path"), "rank")
            got = units.where("node_type = 'file'").join(hit, "path").withColumn("retrieved_by", F.array(F.lit("path"))).withColumn("estimated_tokens", token_estimate(F.col("content")))
            picked = got.orderBy("rank").collect()
        else:
            parts = [f(units, task, FIRST[n], q) for c, n, f, q in (("l", "lexical", self._lexical, 0), ("s", "symbol", self._symbol, 1000), ("v", "semantic", self._semantic, 2000)) if c in use]
            ranked = fusion.rerank(fusion.merge(self._union(parts)), units, task).withColumn("g", F.lit(1))
            picked = selection.first_fit(ranked.select("g", "rank", "path", "qualname", "start_line", "end_line", "estimated_tokens", "retrieved_by"), budget, group="g", order=["rank"], cost="estimated_tokens").orderBy("rank").collect()
        return [(r.path, r.qualname, r.start_line, r.end_line, r.estimated_tokens, list(r.retrieved_by)) for r in picked]
