import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from siltstone.operators import communities as C
from siltstone.operators import evaluation as E
from siltstone.operators import fusion, history, incremental, routing, selection, semantic
from siltstone.operators import graph as G
from siltstone.operators import graph_build as B
from siltstone.operators import hierarchy as H
from siltstone.plans import retrieval_queries
from siltstone.plans.stage import shared_folder


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    for master in ("spark://host:7077", "yarn"):
        Session.sparkContext = type("Context", (), {"master": master, "getConf": staticmethod(lambda: {})})
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session)


# -- hierarchy ----------------------------------------------------------------


def tree(spark, links):
    return spark.createDataFrame(links, "unit_id string, parent_id string")


def test_hierarchy_paths_roots_cycles_and_dirt(spark):
    links = [("r", None), ("a", "r"), ("a", "r"), ("b", "a"), ("e", ""), ("lost", "nowhere"), ("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("deeper", "below"), ("self", "self"), (None, "r")]
    got = {r.node: r for r in H.hierarchy(tree(spark, links), separator="/").collect()}
    assert len(got) == 11
    assert (got["b"].root, got["b"].depth, got["b"].path) == ("r", 2, "r/a/b")
    assert got["e"].depth == 0 and got["lost"].root == "lost"
    for n in ("x", "y", "z", "below", "deeper"):
        assert (got[n].root, got[n].depth, got[n].cyclic, got[n].path) == ("x", -1, True, None)
    assert (got["self"].root, got["self"].depth) == ("self", -1)


def test_hierarchy_deep_chain_and_hot_parent(spark):
    links = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 6)] + [(f"c{i}", "n0") for i in range(300)]
    got = {r.node: r.depth for r in H.hierarchy(tree(spark, links)).collect()}
    assert got["n5"] == 5 and len(got) == 306 and sum(d == 1 for d in got.values()) == 301


def test_nodes_below_the_joined_levels_come_by_doubling(spark, monkeypatch):
    monkeypatch.setattr(H, "LEVELS", 1)
    links = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 9)] + [("side", "n5"), ("x", "y"), ("y", "z"), ("z", "x"), ("below", "x")]
    got = {r.node: (r.root, r.depth, r.path) for r in H.hierarchy(tree(spark, links), separator="/").collect()}
    for i in range(9):
        assert got[f"n{i}"] == ("n0", i, "/".join(f"n{j}" for j in range(i + 1)))
    assert got["side"] == ("n0", 6, "n0/n1/n2/n3/n4/n5/side") and len(got) == 14
    assert all(got[n] == ("x", -1, None) for n in ("x", "y", "z", "below"))


def test_hierarchy_empty_and_conflicting_parents(spark):
    assert H.hierarchy(tree(spark, [])).count() == 0
    got = {r.node: r.parent for r in H.hierarchy(tree(spark, [("a", None), ("b", None), ("c", "b"), ("c", "a"), ("c", "zz")])).collect()}
    assert got["c"] == "a"


def test_descendants(spark):
    got = rows(H.descendants(tree(spark, [("r", None), ("a", "r"), ("b", "a"), ("x", "x")])), "ancestor", "node", "distance")
    assert got == [("a", "b", 1), ("r", "a", 1), ("r", "b", 2)]


# -- graphs -------------------------------------------------------------------

EDGES = [("f", "g", "calls", 0.9), ("g", "h", "calls", 0.8), ("t", "f", "tests", 0.5), ("h", "f", "references", 0.4), ("k", "k", "calls", 1.0)]


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame(EDGES, "source_id string, target_id string, edge_type string, confidence double")
    nodes = spark.createDataFrame([(n, "test" if n == "t" else "function", n.upper(), n) for n in "fghtk"], "node_id string, node_type string, label string, unit_id string")
    return nodes, edges


def walk(edges, start, max_depth, limit):
    """Plain queue search as the definition of the bounded one."""
    ways = {}
    for a, b, k, c in edges:
        ways.setdefault(a, []).append((-c, b, "outgoing", k))
        ways.setdefault(b, []).append((-c, a, "incoming", k))
    queue, seen, out = [(start, 0, 1.0)], {start}, []
    while queue and len(out) < limit:
        at, d, conf = queue.pop(0)
        if d >= max_depth:
            continue
        for c, to, way, k in sorted(ways.get(at, [])):
            if to in seen:
                continue
            seen.add(to)
            out.append((to, d + 1, k, way, round(conf * -c, 9)))
            if len(out) >= limit:
                break
            queue.append((to, d + 1, conf * -c))
    return out


@pytest.mark.parametrize("depth, limit", [(1, 40), (2, 40), (3, 2), (2, 1)])
def test_neighbors_are_those_of_a_queue_search(spark, graph, depth, limit):
    nodes, edges = graph
    starts = spark.createDataFrame([(s,) for s in "fht"], "start string")
    found = G.neighbors(edges, starts, nodes=nodes, max_depth=depth, limit=limit).collect()
    for s in "fht":
        got = [(r.node_id, r.distance, r.edge_type, r.direction, round(r.confidence, 9)) for r in sorted((r for r in found if r.start == s), key=lambda r: r.place)]
        assert got == walk(EDGES, s, depth, limit)


def test_degrees_links_and_paths(spark, graph):
    nodes, edges = graph
    assert rows(G.degrees(edges), "node_id", "degree") == [("f", 3), ("g", 2), ("h", 2), ("k", 2), ("t", 1)]
    assert [r.node_id for r in G.callers(edges, nodes, "h").collect()] == ["g"]
    assert [r.node_id for r in G.callees(edges, nodes, "f").collect()] == ["g"]
    path = G.shortest_path(edges, "t", "h").collect()
    assert [(r.source_id, r.target_id, r.direction) for r in path] == [("t", "f", "outgoing"), ("f", "h", "incoming")]
    assert G.shortest_path(edges, "t", "k").count() == 0 and G.shortest_path(edges, "t", "t").count() == 0
    long = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", "calls", 1.0) for i in range(9)], "source_id string, target_id string, edge_type string, confidence double")
    assert [r.target_id for r in G.shortest_path(long, "n000", "n008").collect()] == [f"n{i:03d}" for i in range(1, 9)]
    starts = spark.createDataFrame([("n004",)], "start string")
    assert rows(G.within(long, starts, 2), "node_id", "distance") == [("n002", 2), ("n003", 1), ("n005", 1), ("n006", 2)]
    assert G.get_node(nodes, "f").first().label == "F" and G.get_node(nodes, "?").count() == 0
    assert G.dangling(edges, nodes.where("node_id <> 'h'")).count() == 2
    assert rows(G.inside(edges, nodes.where("node_id in ('f', 'g')")), "source_id", "target_id") == [("f", "g")]
    assert G.resolve(nodes, "F") == "f"
    with pytest.raises(ValueError):
        G.resolve(nodes, " ")
    chosen, inner = G.question_graph(edges, nodes, "F function", limit=3, hops=1)
    assert chosen.count() == 3 and inner.count() >= 1


def test_resolution_cascade(spark):
    units = spark.createDataFrame(
        [("file:a.py", "file", "a.py", "a.py", "a.py"), ("module:p/a.py", "module", "p/a.py", "a", "p.a"), ("module:p/q/b.py", "module", "p/q/b.py", "b", "p.q.b"), ("function:f", "function", "p/a.py", "f", "p.a.f"),
         ("function:g1", "function", "p/a.py", "g", "p.a.g"), ("function:g2", "function", "p/q/b.py", "g", "p.q.b.g"), ("function:u", "function", "p/q/b.py", "only", "p.q.b.only")],
        "unit_id string, node_type string, path string, name string, qualname string")
    hints = [("function:f", "calls", "function:u"), ("function:f", "calls", "p.a.g"), ("module:p/a.py", "imports", ".q.b"), ("function:f", "calls", "x.only"), ("function:f", "calls", "g"), ("function:f", "calls", "f"), ("function:f", "calls", "unknown"), ("module:p/a.py", "imports", "p.q")]
    h = spark.createDataFrame([(*x, 1.0, i) for i, x in enumerate(hints)], "source_id string, edge_type string, target string, confidence double, seq long")
    got = {r.target: (r.target_id, r.resolution) for r in B.resolve_hints(h, units).collect()}
    assert got == {"function:u": ("function:u", 1.0), "p.a.g": ("function:g1", 1.0), ".q.b": ("module:p/q/b.py", 0.9), "x.only": ("function:u", 0.85), "g": ("function:g1", 0.8), "p.q": ("module:p/q/b.py", 0.8)}


def test_artifact_references(spark):
    node = "id string, label string, kind string, qualname string, source_file string, language string"
    nodes = spark.createDataFrame([("file:a.py", "a.py", "file", "a.py", "a.py", "python"), ("f1", "run", "function", "run", "a.py", "python"), ("f2", "run", "function", "C.run", "b.py", "python"), ("file:b.py", "b.py", "file", "b.py", "b.py", "python"), ("m", "main", "function", "main", "c.py", "python")], node)
    edges = spark.createDataFrame(
        [("f1", "", "x.main", "calls", "INFERRED", "L1"), ("m", "", "run", "calls", "INFERRED", "L2"), ("m", "", "b", "imports", "EXTRACTED", "L3"), ("m", "", "os.path", "imports", "EXTRACTED", "L4"), ("file:a.py", "f1", None, "defines", "EXTRACTED", "L1"), ("f1", "", "run", "calls", "EXTRACTED", "L9")],
        "source string, target string, target_ref string, relation string, confidence string, source_location string")
    out_nodes, out = B.resolve_artifacts(nodes, edges)
    got = {(r.source, r.target, r.relation): r.confidence for r in out.collect()}
    assert got == {("f1", "m", "calls"): "INFERRED", ("m", "f1", "calls"): "AMBIGUOUS", ("m", "f2", "calls"): "AMBIGUOUS", ("m", "file:b.py", "imports"): "EXTRACTED", ("m", "external:imports:os.path", "imports"): "EXTRACTED",
                   ("file:a.py", "f1", "defines"): "EXTRACTED", ("f1", "f1", "calls"): "INFERRED"}
    assert out_nodes.where("kind = 'external'").count() == 1
    assert B.validate(nodes, edges.withColumn("source", F.lit("?"))).count() == 1
    # a hot name: 3,000 nodes, 3,000 references; five candidates each, the smallest
    hot = nodes.unionByName(spark.range(3000).selectExpr("concat('z', lpad(id, 5, '0')) AS id", "'get' AS label", "'function' AS kind", "concat('Q', id, '.get') AS qualname", "concat('d', id, '.py') AS source_file", "'python' AS language"))
    calls = spark.range(3000).selectExpr("'m' AS source", "'' AS target", "'x.get' AS target_ref", "'calls' AS relation", "'INFERRED' AS confidence", "concat('L', id) AS source_location")
    found = B.resolve_artifacts(hot, calls)[1]
    assert found.count() == 15_000 and {r.target for r in found.select("target").distinct().collect()} == {f"z{i:05d}" for i in range(5)}


def test_communities_of_two_cliques(spark):
    links = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 0.1)]
    edges = spark.createDataFrame(links, "source_id string, target_id string, weight double")
    nodes = spark.createDataFrame([(n, n, "function") for n in "abcdwxyz!"], "node_id string, label string, node_type string")
    member = C.communities(nodes, edges).cache()
    got = {r.node_id: r.community for r in member.collect()}
    assert [got[n] for n in "abcdwxyz!"] == [0] * 4 + [1] * 4 + [2]
    pairs = C.undirected(edges)
    assert C.modularity(pairs, member) > 0.4
    assert {r.component for r in C.components(pairs).collect()} == {"a"}
    full = edges.withColumn("edge_type", F.lit("calls"))
    assert C.summary(nodes, full, member).count() == 3
    assert [(r.source, r.target) for r in C.crossings(nodes, full, member).collect()] == [("d", "w")]


def best_partition(links):
    """Modularity of the best partition of a small graph, by trying all of them."""
    names = sorted({n for a, b, _ in links for n in (a, b)})
    total = sum(w for *_, w in links)
    strength = {n: sum(w for a, b, w in links if n in (a, b)) for n in names}

    def parts(rest, groups):
        if not rest:
            inner = sum(w for a, b, w in links if any(a in g and b in g for g in groups)) / total
            yield inner - sum((sum(strength[n] for n in g) / (2 * total)) ** 2 for g in groups)
            return
        for i in range(len(groups)):
            yield from parts(rest[1:], groups[:i] + [groups[i] | {rest[0]}] + groups[i + 1 :])
        yield from parts(rest[1:], [*groups, {rest[0]}])

    return max(parts(names, []))


def test_communities_reach_the_best_modularity_of_the_whole_graph(spark):
    # two parts; a path of five alone would fall in two, beside a heavy ring it is worth more whole or cut elsewhere
    links = [(f"p{i}", f"p{i + 1}", 1.0) for i in range(4)] + [(f"r{i}", f"r{(i + 1) % 4}", 5.0) for i in range(4)]
    edges = spark.createDataFrame(links, "source_id string, target_id string, weight double")
    nodes = spark.createDataFrame([(n,) for n in sorted({n for a, b, _ in links for n in (a, b)})], "node_id string")
    member = C.communities(nodes, edges).cache()
    assert C.modularity(C.undirected(edges), member) == pytest.approx(best_partition(links), abs=0.05)
    assert not {r.community for r in member.where("node_id like 'p%'").collect()} & {r.community for r in member.where("node_id like 'r%'").collect()}


# -- fusion, selection --------------------------------------------------------


def candidates(spark):
    columns = "task_id string, unit_id string, path string, node_type string, qualname string, language string, start_line int, end_line int, score double, retrieved_by array<string>, reasons array<string>, graph_distance int, content string"
    data = [("t", f"u{i}", f"p{i % 3}.py", "test" if i == 4 else "function", f"q{i}", "python", 10 * i, 10 * i + 15, 0.9 - i / 20, ["bm25"] if i % 2 else ["semantic", "bm25"], ["r"], 1 if i == 2 else None, f"word{i} " * (20 + 30 * (i % 4))) for i in range(12)]
    return spark.createDataFrame(data, columns)


@pytest.mark.parametrize("budget", [0, 60, 200, 500, 10_000])
def test_selection_never_exceeds_the_budget(spark, budget):
    got = selection.select(candidates(spark), budget).collect()
    assert len(got) == 12 and sum(r.cost for r in got if r.selected) <= budget
    places = sorted(r.place for r in got if r.selected)
    assert places == list(range(1, len(places) + 1))


def test_budget_queries_take_all_units_of_a_repository(spark, tmp_path):
    made = [(f"u{i:02d}", f"r/{i:02d}.py", "function", f"f{i}", f"f{i}", 1, 2, "python", f"word{i} " * (1000 if i < 25 else 1)) for i in range(30)]
    spark.createDataFrame(made, "unit_id string, path string, node_type string, name string, qualname string, start_line int, end_line int, language string, content string").write.parquet(str(tmp_path / "units.parquet"))
    got = retrieval_queries.budget_select(spark, str(tmp_path)).collect()
    assert len(got) == 30 and {r.unit_id for r in got if r.selected} == {f"u{i}" for i in range(25, 30)}
    assert {r.unit_id for r in retrieval_queries.first_fit_budget(spark, str(tmp_path)).collect()} == {f"u{i}" for i in range(25, 30)}


def test_first_fit_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", 1, 50), ("g", 2, 60), ("g", 3, 40), ("g", 4, 20)], "g string, n int, cost int")
    assert rows(selection.first_fit(df, 100, group="g", order=["n"], cost="cost"), "n") == [(1,), (3,)]


def test_merge_and_rerank(spark):
    signal = [("u", "bm25", 0.5, "a", None, None, False, 0), ("u", "bm25", 0.9, "b", 3, None, False, 5), ("u", "semantic", 0.4, "", 2, "calls", True, 2), ("v", "symbol_search", 0.6, "c", None, None, False, 1)]
    merged = fusion.merge(spark.createDataFrame(signal, fusion.SIGNAL))
    u = merged.where("unit_id = 'u'").first()
    assert u.source_scores == {"bm25": 0.9, "semantic": 0.4} and u.retrieved_by == ["bm25", "semantic"] and u.reasons == ["a", "b"] and (u.graph_distance, u.edge_type, u.exact) == (2, "calls", True)
    units = spark.createDataFrame([("u", "src/router.py", 1, 10, "function", "x" * 40), ("v", "src/other.py", 1, 10, "test", "y")], "unit_id string, path string, start_line int, end_line int, node_type string, content string")
    got = {r.unit_id: r for r in fusion.rerank(merged, units, "router trouble").collect()}
    parts = [0.9, 0.4 * 0.78]
    want = 0.62 * 0.9 + 0.28 * (1 - (1 - parts[0]) * (1 - parts[1])) + 0.1 + 0.04 - 2 * 0.035 - math.log1p(10) / 100
    assert got["u"].score == pytest.approx(want) and got["u"].rank == 1 and "path" in got["u"].retrieved_by
    assert got["v"].score == pytest.approx(0.62 * 0.57 + 0.28 * 0.57 + 0.01 - math.log1p(1) / 100)


# -- history ------------------------------------------------------------------


def test_log_parsing_and_scope(spark):
    text = "h1\x1f2024-05-01T10:00:00+02:00\x1fann\x1fMove\n\n1\t2\tsrc/{old => new}/a.py\n-\t-\tb.bin\n3\t0\tR.md => docs/R.md\n4\t1\tsrc/{util => }/x.py"
    commits = history.parse_log(spark.createDataFrame([(text,), ("broken",)], "value string"))
    c = commits.first()
    assert commits.count() == 1 and c.authored_at == dt.datetime(2024, 5, 1, 8) or c.authored_at.hour in (8, 10)
    assert [tuple(f) for f in c.files] == [("src/new/a.py", 1, 2, "R", "src/old/a.py"), ("b.bin", 0, 0, "A", None), ("docs/R.md", 3, 0, "R", "R.md"), ("src/x.py", 4, 1, "R", "src/util/x.py")]
    assert [f.path for f in history.scope(commits, "src").first().files] == ["new/a.py", "x.py"]
    assert history.scope(commits, "nowhere").count() == 0
    assert history.renames(commits).count() == 3


def test_co_change_counts_keep_pairs_of_one_commit(spark, tmp_path):
    made = [("c1", ["a", "b", "c"]), ("c2", ["a", "b"])]
    spark.createDataFrame(made, "commit_hash string, changed_files array<string>").write.parquet(str(tmp_path / "commit_evidence.parquet"))
    got = retrieval_queries.QUERIES["co_change_counts"](spark, str(tmp_path))
    assert rows(got, "path_a", "path_b", "n", "confidence") == [("a", "b", 2, 1.0), ("a", "c", 1, 0.5), ("b", "c", 1, 0.5)]


def test_co_changes_and_gate(spark):
    commits = spark.createDataFrame(
        [("1", "fix the router lookup", dt.datetime(2024, 1, 1), ["a.py", "b.py", "a.py", None, ""], ""), ("2", "tidy", dt.datetime(2024, 6, 1), ["a.py", "b.py"], ""), ("3", "big", dt.datetime(2024, 6, 1), [f"f{i}" for i in range(60)], ""), ("4", "docs", dt.datetime(2024, 6, 1), None, "")],
        "commit_hash string, message string, authored_at timestamp, changed_files array<string>, summary string")
    files = history.commit_files(commits)
    assert rows(history.co_changes(files), "path_a", "path_b", "n", "confidence") == [("a.py", "b.py", 2, 1.0)]
    current = spark.createDataFrame([("a.py",)], "path string")
    assert rows(history.hotspots(files, current), "path", "changes") == [("a.py", 2)]
    assert rows(history.related_files(history.co_changes(files), "b.py"), "related", "n") == [("a.py", 2)]
    got = history.search(commits, current, "router lookup broken", "2024-07-01", anchors=["a.py"]).collect()
    assert [r.commit_hash for r in got] == ["1"] and got[0].anchor_overlap == ["a.py"]


# -- routing, evaluation, incremental -----------------------------------------


def test_routes(spark):
    tasks = {"Delete the prefix": "local_bug", "mounted app fails": "cross_file_bug", "rename it": "refactor", "": "none", "Explain": "general", "Close the file": "local_bug"}
    got = {r.task: r for r in routing.route(spark.createDataFrame([(t,) for t in tasks], "task string")).collect()}
    assert {t: r.task_type for t, r in got.items()} == tasks
    assert got["rename it"].selected_sources == ["lexical", "symbol", "semantic", "call_graph", "imports", "inheritance", "related_tests", "git_history", "hotspots"]
    whole = {r.task: r.task_type for r in routing.route(spark.createDataFrame([("Delete the prefix",)], "task string"), whole_words=True).collect()}
    assert whole == {"Delete the prefix": "general"}


def test_metrics_of_a_small_list(spark):
    ranges = "gold_line_ranges array<struct<file:string,start_line:int,end_line:int>>"
    tasks = spark.createDataFrame([("t", ["a", "b", "c"], ["s1"], [("a", 1, 10), ("b", 5, 6)]), ("none", [], [], None)], f"task_id string, gold_files array<string>, gold_symbols array<string>, {ranges}")
    items = spark.createDataFrame([("t", 1, "x", "s0", 1, 5, 100, ["bm25"]), ("t", 2, "a", "s1", 4, 8, 50, ["bm25", "semantic"]), ("t", 3, "a", "s1", 6, 20, 7, ["path"])], "task_id string, rank int, file string, symbol string, start_line int, end_line int, estimated_tokens int, sources array<string>")
    total = spark.createDataFrame([("t", 1570)], "task_id string, repository_source_tokens long")
    got = {r.task_id: r for r in E.metrics(tasks, items, 3, total).collect()}
    m = got["t"]
    assert (m.file_recall_at_k, m.file_precision_at_k, m.mrr, m.symbol_recall_at_k) == pytest.approx((1 / 3, 1 / 3, 0.5, 1.0))
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert m.ndcg_at_k == pytest.approx(1 / math.log2(3) / ideal)
    assert m.gold_line_coverage == pytest.approx(7 / 12) and m.context_tokens == 157 and m.token_reduction_fraction == pytest.approx(0.9)
    assert m.evidence_source_diversity == 3 and m.selected_context_relevance == pytest.approx(2 / 3)
    assert got["none"].mrr == 0 and got["none"].file_recall_at_k == 0


def test_incremental_tables(spark):
    files = "path string, content_hash string, parse_error string"
    old = spark.createDataFrame([("a", "1", None), ("b", "1", None), ("c", "1", "bad"), ("d", "1", None)], files)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "1")], "path string, content_hash string")
    assert dict(rows(incremental.diff(new, old), "path", "change")) == {"a": "unchanged", "b": "changed", "c": "changed", "d": "deleted", "e": "new"}
    assert rows(incremental.replace_files(old, old.where("path = 'a'").withColumn("content_hash", F.lit("9"))), "path", "content_hash")[0] == ("a", "9")
    long = spark.createDataFrame([("b", "2", "x" * 3000)], files)
    assert incremental.record_errors(old, long).where("path = 'b'").select(F.length("parse_error")).first()[0] == 1000
    units = spark.createDataFrame([("u", "h2", "function"), ("w", "h1", "file"), ("m", "h", "module")], "unit_id string, content_hash string, node_type string")
    vectors = spark.createDataFrame([("u", "p", "h1", 2, [1.0, 0.0]), ("w", "p", "h1", 2, [1.0, 1.0]), ("gone", "p", "h", 2, [0.0, 1.0])], "unit_id string, provider string, content_hash string, dimensions int, vector array<float>")
    assert rows(semantic.pending(units, vectors, "p"), "unit_id") == [("u",)]
    assert rows(incremental.drop_stale_vectors(vectors, units), "unit_id") == [("u",), ("w",)]
    assert rows(semantic.top_k(vectors, [1.0, 0.0], 5), "unit_id") == [("u",), ("w",)]
