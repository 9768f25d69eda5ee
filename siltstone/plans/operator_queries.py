"""Queries that show single operators on whole tables, with their SQL: logs, references, rules, upserts, expansion, paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import communities as C
from siltstone.operators import fusion, history, incremental, routing, semantic, symbols
from siltstone.operators import graph as G
from siltstone.operators import graph_build as B
from siltstone.plans.stage import stage
from siltstone.sources import files

from . import graph_queries as GQ
from . import retrieval_queries as RQ
from .tables import table

PLAIN = "^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$"


# -- logs ---------------------------------------------------------------------


def _log(spark, folder):
    """The commits of the table written as log records; of the paths of a commit, every second is renamed as a whole, every third in a part."""
    rows = table(spark, folder, "commit_evidence").where("commit_hash is not null and changed_files is not null")
    paths = F.array_sort(F.array_distinct(F.filter("changed_files", lambda p: p.rlike(PLAIN))))
    rows = incremental.latest(rows.withColumn("paths", paths), ["commit_hash"], ["authored_at", "message", F.array_join("paths", " ")])

    def line(p, i):
        name = F.when(i % 3 == 1, F.concat(F.lit("old/"), p, F.lit(" => "), p)).when(i % 3 == 2, F.concat(F.lit("pre/{x => y}/"), p)).otherwise(p)
        return F.concat_ws("\t", i.cast("string"), (i % 2).cast("string"), name)

    head = F.concat_ws("\x1f", "commit_hash", F.date_format("authored_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.coalesce("author_name", F.lit("")), F.lit("subject"))
    return history.parse_log(rows.select(F.concat(head, F.lit("\n\n"), F.array_join(F.transform("paths", line), "\n")).alias("value")))


def log_files(spark, folder):
    rows = _log(spark, folder).select("commit_hash", F.unix_seconds("authored_at").alias("authored_s"), F.explode("files").alias("f"))
    return rows.select("commit_hash", "authored_s", "f.path", "f.additions", "f.deletions", "f.status", "f.old_path")


def scoped_log(spark, folder):
    rows = history.scope(_log(spark, folder), "harborline")
    return rows.select("commit_hash", F.explode("files").alias("f")).select("commit_hash", "f.path")


def recent_renames(spark, folder):
    return history.renames(_log(spark, folder), 20).select("commit_hash", "old_path", "new_path")


def co_changed_files(spark, folder):
    """Files most often committed with the file that most commits touch."""
    touched = stage(RQ._commit_files(spark, folder), "touched")
    top = touched.groupBy("path").count().orderBy(F.desc("count"), "path").first()
    return history.related_files(history.co_changes(touched), top.path if top else "", 10).select("related", "n")


def history_top(spark, folder):
    rows = history.search(table(spark, folder, "commit_evidence"), table(spark, folder, "files"), RQ.HISTORY_TASK, RQ.AS_OF, limit=8)
    return rows.select("commit_hash", F.round("score", 6).alias("score"))


def history_signals(spark, folder):
    """File units as candidates: those that the best commits of a task changed."""
    units, commits = table(spark, folder, "units"), table(spark, folder, "commit_evidence")
    found = history.search(commits, table(spark, folder, "files"), RQ.HISTORY_TASK, RQ.AS_OF, limit=8)
    rows = fusion.merge(history.candidates(found, units))
    return rows.select("unit_id", F.round(F.col("source_scores")["git_history"], 6).alias("score"), F.size("reasons").alias("commits"))


# -- references, signatures, costs ---------------------------------------------


def reference_forms(spark, folder):
    units = table(spark, folder, "units").where("signature is not null").select("unit_id", "path", "signature", "qualname").distinct()
    return units.select("unit_id", "path", "signature", T.clean_reference(F.col("signature")).alias("cleaned"), T.first_line_signature(F.col("signature")).alias("first_line"),
                        T.normal_reference(F.col("path")).alias("normal"), T.external_id(F.lit("imports"), F.col("qualname")).alias("outside")).distinct()


def render_costs(spark, folder):
    units = table(spark, folder, "units").where("content is not null").dropDuplicates(["unit_id"])
    cost = T.render_cost(F.col("qualname"), F.col("path"), F.col("start_line"), F.col("end_line"), F.lit(0.5), F.array(F.lit("bm25"), F.lit("path")), F.array(F.lit("one"), F.lit("two")), F.col("language"), F.col("content"))
    return units.groupBy("node_type").agg(F.sum(cost.cast("long")).alias("tokens"), F.count(F.lit(1)).alias("n"))


def rerank_symbols(spark, folder):
    units = table(spark, folder, "units")
    found = symbols.search(units, RQ.SYMBOL_QUERY, limit=50, fuzzy=False)
    rows = fusion.rerank(fusion.merge(fusion.signals(found, "symbol_search", "score", exact=F.col("exact"))), units, RQ.SYMBOL_QUERY, redundancy=False)
    return rows.select("unit_id", F.round("score", 6).alias("score"), "rank")


# -- graphs --------------------------------------------------------------------


def unit_and_node_lookup(spark, folder):
    units = table(spark, folder, "units")
    nodes, _ = GQ._graph(spark, folder)
    last = units.agg(F.max("unit_id")).first()[0] or ""
    a = files.get_unit(units, last).select(F.col("unit_id").alias("id"), F.col("qualname").alias("label"))
    return a.unionByName(G.get_node(nodes, "repository:.").select(F.col("node_id").alias("id"), "label"))


def adjacency_heads(spark, folder):
    """Of each node and direction the number of links and the first one."""
    _, edges = GQ._graph(spark, folder)
    rows = files.adjacency(edges).where("part = 0")
    return rows.select("node_id", "direction", F.size("links").alias("n"), F.col("links")[0]["other_id"].alias("first"))


def typed_bfs(spark, folder):
    """What lies two containment steps around every repository directory."""
    nodes, edges = GQ._graph(spark, folder)
    starts = nodes.where("node_type = 'directory' and path not like '%/%'").select(F.col("node_id").alias("start"))
    return G.within(edges, starts, 2, edge_types=("contains",)).select("start", "node_id", F.col("distance").cast("int").alias("distance"))


def dangling_parents(spark, folder):
    """Links to a parent that is no unit."""
    units = table(spark, folder, "units").where("parent_id <> ''").select(F.col("parent_id").alias("source_id"), F.col("unit_id").alias("target_id"), F.lit("defines").alias("edge_type"), F.lit(1.0).alias("confidence"))
    return G.dangling(units, table(spark, folder, "units").select(F.col("unit_id").alias("node_id")).distinct()).select("source_id", "target_id")


def exact_node(spark, folder):
    nodes, _ = GQ._graph(spark, folder)
    asked = ["HARBORLINE", "repository:.", "directory:harborline"]
    return spark.createDataFrame([(q, G.resolve(nodes, q)) for q in asked], "query string, node_id string")


def _repositories(spark, folder):
    """Every node below a repository directory as a member of it, numbered by name."""
    nodes, edges = GQ._graph(spark, folder)
    own = nodes.where("path <> '.'").select("node_id", F.substring_index("path", "/", 1).alias("repository"))
    number = own.select("repository").distinct().withColumn("community", F.row_number().over(Window.orderBy("repository")))  # a row per repository
    return nodes, edges, own.join(number, "repository").select("node_id", "community")


def community_summary(spark, folder):
    nodes, edges, member = _repositories(spark, folder)
    return C.summary(nodes, edges, member).select("community", "size", "label", F.array_join("top_nodes", " | ").alias("top_nodes"))


def community_crossings(spark, folder):
    nodes, edges, member = _repositories(spark, folder)
    return C.crossings(nodes, edges, member, 12)


def structural_signals(spark, folder):
    """Signals one step around the three units of most links."""
    nodes, edges = GQ._graph(spark, folder)
    top = G.central(edges, nodes.where("node_type in ('function', 'method', 'test')"), 3)
    anchors = top.select(F.col("node_id").alias("unit_id"), F.round(1.0 / F.length("node_id"), 9).alias("strength"))
    rows = routing.expand(anchors, edges, nodes, max_depth=1, max_nodes=100_000)
    return rows.select("unit_id", "source", F.round("score", 6).alias("score"), "graph_distance", "edge_type").distinct()


def import_cascade(spark, folder):
    """Relative references to the parent, and imports of the package above, through the resolution cascade."""
    units = table(spark, folder, "units")
    one = incremental.latest(units, ["unit_id"], ["path"]).select("unit_id", "node_type", "qualname", "parent_id")
    above = one.select(F.col("unit_id").alias("parent_id"), F.substring_index("qualname", ".", -1).alias("last"))
    a = one.join(above, "parent_id").select(F.col("unit_id").alias("source_id"), F.lit("references").alias("edge_type"), F.concat(F.lit(".."), "last").alias("target"))
    package = F.regexp_replace("qualname", r"\.[^.]*$", "")
    b = one.where("node_type = 'module' and qualname like '%.%'").select(F.col("unit_id").alias("source_id"), F.lit("imports").alias("edge_type"), package.alias("target"))
    hints = a.unionByName(b).distinct().withColumn("confidence", F.lit(1.0)).withColumn("seq", F.lit(0).cast("long"))
    return B.resolve_hints(hints, units).select("source_id", "edge_type", "target", "target_id", "resolution")


def artifact_problems(spark, folder):
    """Violations in a graph made of the units as they are: empty parents, unknown parents, repeated ids."""
    units = table(spark, folder, "units")
    nodes = units.select(F.col("unit_id").alias("id"), F.col("name").alias("label"), F.col("node_type").alias("kind"))
    edges = units.select(F.col("parent_id").alias("source"), F.col("unit_id").alias("target"), F.lit("").alias("target_ref"), F.lit("defines").alias("relation"), F.when(F.col("is_test"), "SURE").otherwise("EXTRACTED").alias("confidence"))
    return B.validate(nodes, edges)


def artifact_references(spark, folder):
    """Calls by bare name resolved against all units: certain, inferred, ambiguous or outside."""
    units = incremental.latest(table(spark, folder, "units"), ["unit_id"], ["path"])
    nodes = units.select(F.col("unit_id").alias("id"), F.col("name").alias("label"), F.col("node_type").alias("kind"), "qualname", F.col("path").alias("source_file"), "language").where("kind <> 'file'")
    hints = GQ.call_hints(units)
    edges = hints.select(F.col("source_id").alias("source"), F.lit(None).cast("string").alias("target"), F.col("target").alias("target_ref"), F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit("L1").alias("source_location"))
    return B.resolve_artifacts(nodes, edges)[1].select("source", "target", "confidence", "weight")


# -- upserts -------------------------------------------------------------------


def replaced_files(spark, folder):
    """First indexings, with the files whose content changed replaced by their last one."""
    last, first = RQ._indexings(spark, folder)
    changed = incremental.diff(last, first).where("change = 'changed'").select("path")
    return incremental.replace_files(first, last.join(changed, "path", "left_semi")).select("path", "content_hash", "mtime_ns")


def recorded_errors(spark, folder):
    """First indexings, with an error recorded for every path whose last indexing has one."""
    last, first = RQ._indexings(spark, folder)
    return incremental.record_errors(first, last.where("trim(parse_error) <> ''")).select("path", "content_hash", "parse_error")


def dropped_files(spark, folder):
    """Units without those of files that have no text any more."""
    units = table(spark, folder, "units")
    return incremental.drop_files(units, units.where("node_type = 'file' and content is null")).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def kept_vectors(spark, folder):
    """Vectors whose unit is a function or method."""
    units = table(spark, folder, "units").where("node_type in ('function', 'method')")
    return incremental.drop_stale_vectors(table(spark, folder, "unit_vectors"), units).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def vector_search_joined(spark, folder):
    """The nearest fresh units of one unit's own vector."""
    units, vectors = table(spark, folder, "units"), table(spark, folder, "unit_vectors").where("provider = 'local-hash' and dimensions = 128 and size(vector) = 128 and not exists(vector, x -> isnan(x) or x is null)")
    held = stage(semantic.fresh(vectors, units).dropDuplicates(["unit_id"]), "fresh")
    query = held.orderBy("unit_id").first()
    return semantic.top_k(held, query.vector if query else [1.0] * 128, 15)


QUERIES = {f.__name__: f for f in (
    log_files, scoped_log, recent_renames, co_changed_files, history_top, history_signals, reference_forms, render_costs, rerank_symbols, unit_and_node_lookup, adjacency_heads, typed_bfs, dangling_parents,
    exact_node, community_summary, community_crossings, structural_signals, import_cascade, artifact_problems, artifact_references, replaced_files, recorded_errors, dropped_files, kept_vectors, vector_search_joined,
)}

# -- SQL -----------------------------------------------------------------------

_LOG = f"""c AS (SELECT commit_hash, authored_at, message, list_sort(list_distinct(list_filter(changed_files, lambda p: regexp_full_match(coalesce(p, ''), '{PLAIN}')))) AS paths FROM commit_evidence WHERE commit_hash IS NOT NULL AND changed_files IS NOT NULL),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash ORDER BY authored_at, message, array_to_string(paths, ' ')) AS _n FROM c) WHERE _n = 1),
  l AS (SELECT commit_hash, epoch_us(date_trunc('second', authored_at)) // 1000000 AS authored_s, unnest(paths) AS p, generate_subscripts(paths, 1) - 1 AS i FROM k),
  lg AS (SELECT commit_hash, authored_s, CASE WHEN i % 3 = 2 THEN 'pre/y/' || p ELSE p END AS path, CAST(i AS INTEGER) AS additions, CAST(i % 2 AS INTEGER) AS deletions,
    CASE WHEN i % 3 > 0 THEN 'R' WHEN i % 2 = 0 THEN 'A' ELSE 'M' END AS status, CASE i % 3 WHEN 1 THEN 'old/' || p WHEN 2 THEN 'pre/x/' || p END AS old_path FROM l)"""
_G = GQ._GRAPH
_NORM = r"lower(replace(regexp_replace(trim({0}), '^[''\"`./]+|[''\"`./]+$', '', 'g'), '/', '.'))"
_REPO = """own AS (SELECT node_id, split_part(path, '/', 1) AS repository FROM nodes WHERE path <> '.'), num AS (SELECT repository, row_number() OVER (ORDER BY repository) AS community FROM (SELECT DISTINCT repository FROM own)),
  mem AS (SELECT node_id, CAST(community AS INTEGER) AS community FROM own JOIN num USING (repository))"""
_LAST = RQ._FILES_ONE.format("DESC")
_FIRST = RQ._FILES_ONE.format("ASC")

_TOP = (RQ.ORACLES["history_score"].rsplit("SELECT commit_hash", 1)[0].replace("SELECT u.commit_hash, coalesce(bm25", "SELECT u.commit_hash, u.authored_at, coalesce(bm25")
        + "SELECT commit_hash, {0} AS score FROM r WHERE score >= 0.25 AND n_terms > 0 ORDER BY round(score, 9) DESC, authored_at DESC, commit_hash LIMIT 8")

ORACLES = {
    "log_files": f"WITH {_LOG} SELECT * FROM lg",
    "scoped_log": f"WITH {_LOG} SELECT commit_hash, substr(path, 12) AS path FROM lg WHERE starts_with(path, 'harborline/')",
    "recent_renames": f"WITH {_LOG} SELECT commit_hash, old_path, path AS new_path FROM lg WHERE status = 'R' ORDER BY authored_s DESC, commit_hash, path LIMIT 20",
    "co_changed_files": f"""WITH {RQ._CF}, t AS (SELECT path FROM cf GROUP BY path ORDER BY count(*) DESC, path LIMIT 1), g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY commit_hash) AS k FROM cf) WHERE k BETWEEN 2 AND 50)
SELECT b.path AS related, count(*) AS n FROM g a JOIN t ON a.path = t.path JOIN g b ON b.commit_hash = a.commit_hash AND b.path <> a.path GROUP BY b.path ORDER BY n DESC, related LIMIT 10""",
    "history_top": _TOP.replace("{0}", "round(score, 6)"),
    "history_signals": f"""WITH top AS ({_TOP.replace("{0}", "score")}), {RQ._CF}, f AS (SELECT path, min(unit_id) AS unit_id FROM units WHERE node_type = 'file' GROUP BY path)
SELECT unit_id, round(max(score), 6) AS score, CAST(count(DISTINCT substr(commit_hash, 1, 10)) AS INTEGER) AS commits FROM top JOIN cf USING (commit_hash) JOIN f USING (path) GROUP BY unit_id""",
    "reference_forms": r"""WITH u AS (SELECT DISTINCT unit_id, path, signature, qualname FROM units WHERE signature IS NOT NULL),
  b AS (SELECT *, trim(regexp_replace(regexp_replace(trim(signature), '^[''"`<>()\[\]{}]+|[''"`<>()\[\]{}]+$', '', 'g'), '[^A-Za-z0-9_.$:/@#-]+', ' ', 'g')) AS plain FROM u)
SELECT DISTINCT unit_id, path, signature, CASE WHEN plain <> '' AND length(plain) <= 180 AND NOT contains(plain, ' ') THEN plain END AS cleaned,
  substr(rtrim(regexp_replace(split_part(trim(signature), chr(10), 1), '\s*\{\s*$', '')), 1, 500) AS first_line, """ + _NORM.format("path") + " AS normal, 'external:imports:' || replace(" + _NORM.format("qualname") + ", ' ', '-') AS outside FROM b",
    "render_costs": f"""WITH u AS (SELECT *, '### ' || qualname || chr(10) || path || ':' || start_line || '-' || end_line || chr(10) || 'score 0.500; sources bm25, path' || chr(10) || 'one two' || chr(10) || '```' || coalesce(language, '') || chr(10) || chr(10) || '```' || chr(10) AS head FROM {RQ._U} WHERE content IS NOT NULL)
SELECT node_type, CAST(sum(greatest(1, (length(head) + 3) // 4) + greatest(1, (length(content) + 3) // 4)) AS BIGINT) AS tokens, count(*) AS n FROM u GROUP BY node_type""",
    "rerank_symbols": f"""WITH l AS ({RQ.ORACLES['symbol_match_ladder']}), u AS (SELECT l.score AS s, exact, u.*, greatest(1, (length(coalesce(content, '')) + 3) // 4) AS tok,
    len(list_intersect(list_filter(string_split(translate(lower(path), './', '__'), '_'), lambda x: length(x) > 2), {RQ._sql_list(T.query_terms_of(RQ.SYMBOL_QUERY))})) AS hits FROM l JOIN {RQ._U} u USING (unit_id)),
  w AS (SELECT *, 0.95::DOUBLE * s AS v, CASE WHEN hits > 0 THEN least(0.1::DOUBLE, hits * 0.04::DOUBLE) ELSE 0 END AS bonus FROM u),
  r AS (SELECT *, greatest(0, least(1, v * 0.62::DOUBLE + least(0.95::DOUBLE, v) * 0.28::DOUBLE + CASE WHEN exact THEN 0.1::DOUBLE ELSE 0 END + bonus + CASE WHEN node_type = 'test' THEN 0.01::DOUBLE ELSE 0 END - least(0.09::DOUBLE, ln(1 + tok) / 100))) AS score FROM w)
SELECT unit_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, tok, path, start_line, unit_id) AS INTEGER) AS rank FROM r""",
    "unit_and_node_lookup": f"SELECT * FROM (SELECT unit_id AS id, qualname AS label FROM {RQ._U} WHERE unit_id = (SELECT max(unit_id) FROM units)) UNION ALL SELECT 'repository:.', 'corpus'",
    "adjacency_heads": f"""WITH {_G}, b AS (SELECT source_id AS node_id, 'outgoing' AS direction, target_id AS o, confidence, edge_type FROM edges UNION ALL SELECT target_id, 'incoming', source_id, confidence, edge_type FROM edges),
  k AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY confidence DESC, o, edge_type) AS i, count(*) OVER (PARTITION BY node_id, direction) AS n FROM b)
SELECT node_id, direction, CAST(least(n, {files.MOST_LINKS}) AS INTEGER) AS n, o AS first FROM k WHERE i = 1""",
    "typed_bfs": f"""WITH {_G}, s AS (SELECT node_id AS start FROM nodes WHERE node_type = 'directory' AND NOT contains(path, '/')), cw AS (SELECT source_id AS a, target_id AS b FROM edges WHERE edge_type = 'contains' UNION SELECT target_id, source_id FROM edges WHERE edge_type = 'contains'),
  one AS (SELECT DISTINCT start, b AS node_id FROM s JOIN cw ON a = start WHERE b <> start), two AS (SELECT DISTINCT start, b AS node_id FROM one JOIN cw ON a = node_id WHERE b <> start)
SELECT start, node_id, CAST(1 AS INTEGER) AS distance FROM one UNION ALL SELECT start, node_id, CAST(2 AS INTEGER) FROM (SELECT * FROM two EXCEPT SELECT * FROM one)""",
    "shortest_path": f"""WITH RECURSIVE {_G}, t AS (SELECT source_id AS p, target_id AS c FROM edges WHERE edge_type = 'contains'), e AS (SELECT min(node_id) AS a, max(node_id) AS b FROM nodes WHERE node_type = 'file'),
  ua AS (SELECT a AS n, 0 AS d FROM e UNION ALL SELECT p, d + 1 FROM ua JOIN t ON c = n), ub AS (SELECT b AS n, 0 AS d FROM e UNION ALL SELECT p, d + 1 FROM ub JOIN t ON c = n),
  m AS (SELECT ua.d AS da, ub.d AS db FROM ua JOIN ub USING (n) ORDER BY ua.d LIMIT 1)
SELECT CAST(x.d + 1 AS INTEGER) AS step, x.n AS source_id, y.n AS target_id, 'contains' AS edge_type, 'incoming' AS direction, 1.0::DOUBLE AS confidence FROM ua x JOIN ua y ON y.d = x.d + 1, m WHERE x.d < da
UNION ALL SELECT CAST(da + db - x.d AS INTEGER), y.n, x.n, 'contains', 'outgoing', 1.0::DOUBLE FROM ub x JOIN ub y ON y.d = x.d + 1, m WHERE x.d < db""",
    "dangling_parents": "SELECT DISTINCT parent_id AS source_id, unit_id AS target_id FROM units WHERE parent_id <> '' AND parent_id NOT IN (SELECT unit_id FROM units WHERE unit_id IS NOT NULL)",
    "exact_node": f"WITH {_G}, q AS (SELECT unnest(['HARBORLINE', 'repository:.', 'directory:harborline']) AS query) SELECT query, min(node_id) AS node_id FROM q LEFT JOIN nodes ON lower(node_id) = lower(query) OR lower(label) = lower(query) GROUP BY query",
    "community_summary": f"""WITH {_G}, {_REPO}, r AS (SELECT nodes.*, community, coalesce(degree, 0) AS degree FROM nodes JOIN mem USING (node_id) LEFT JOIN deg USING (node_id)),
  a AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node_id) AS i FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node_id) AS i FROM r WHERE label <> '')
SELECT community, count(*) AS size, (SELECT string_agg(label, ' / ' ORDER BY i) FROM b WHERE b.community = a.community AND i <= 3) AS label, string_agg(label, ' | ' ORDER BY i) FILTER (i <= 5) AS top_nodes FROM a GROUP BY community""",
    "community_crossings": f"""WITH {_G}, {_REPO}, d AS (SELECT node_id, label, community, degree FROM nodes JOIN mem USING (node_id) JOIN deg USING (node_id))
SELECT a.label AS source, b.label AS target, edge_type, a.degree + b.degree AS score FROM edges JOIN d a ON a.node_id = source_id JOIN d b ON b.node_id = target_id WHERE a.community <> b.community ORDER BY score DESC, source, target, edge_type LIMIT 12""",
    "structural_signals": f"""WITH {_G}, t AS (SELECT node_id, round(1.0::DOUBLE / length(node_id), 9) AS strength FROM nodes LEFT JOIN deg USING (node_id) WHERE node_type IN ('function', 'method', 'test') ORDER BY coalesce(degree, 0) DESC, node_id LIMIT 3),
  b AS (SELECT source_id AS a, target_id AS o, edge_type, confidence, 'outgoing' AS dir FROM edges UNION ALL SELECT target_id, source_id, edge_type, confidence, 'incoming' FROM edges),
  f AS (SELECT *, row_number() OVER (PARTITION BY a, o ORDER BY confidence DESC, dir, edge_type) AS i FROM b JOIN t ON t.node_id = a WHERE o <> a AND edge_type IN ('calls', 'imports', 'inherits', 'defines', 'references', 'tests'))
SELECT DISTINCT o AS unit_id, CASE edge_type WHEN 'calls' THEN 'call_graph' WHEN 'tests' THEN 'related_tests' ELSE 'graph_expansion' END AS source,
  round(strength * 0.72::DOUBLE * confidence * CASE edge_type WHEN 'calls' THEN 1 WHEN 'tests' THEN 1 WHEN 'defines' THEN 0.76::DOUBLE END, 6) AS score, CAST(1 AS INTEGER) AS graph_distance, edge_type FROM f JOIN u ON u.unit_id = o WHERE i = 1""",
    "import_cascade": f"""WITH {GQ._ONE}, pa AS (SELECT unit_id AS parent_id, string_split(qualname, '.')[-1] AS last FROM u),
  h AS (SELECT unit_id AS source_id, 'references' AS edge_type, '..' || last AS target, last AS clean, qualname AS q, path FROM u JOIN pa USING (parent_id)
    UNION ALL SELECT unit_id, 'imports', regexp_replace(qualname, '\\.[^.]*$', ''), regexp_replace(qualname, '\\.[^.]*$', ''), qualname, path FROM u WHERE node_type = 'module' AND contains(qualname, '.')),
  qn AS (SELECT qualname, min(unit_id) AS t FROM u GROUP BY qualname HAVING count(*) = 1), nm AS (SELECT name, min(unit_id) AS t FROM u GROUP BY name HAVING count(*) = 1), pn AS (SELECT path, name, min(unit_id) AS t FROM u GROUP BY path, name HAVING count(*) = 1),
  pr AS (SELECT unit_id, array_to_string(s[1:i], '.') AS pre FROM (SELECT unit_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT unit_id, string_split(qualname, '.') AS s FROM u WHERE node_type = 'module'))), m AS (SELECT pre, min(unit_id) AS t FROM pr GROUP BY pre HAVING count(*) = 1),
  x AS (SELECT h.*, CASE WHEN edge_type = 'references' THEN array_to_string(list_append(string_split(q, '.')[1 : greatest(0, len(string_split(q, '.')) - 2)], clean), '.') END AS rel, string_split(clean, '.')[-1] AS lst FROM h),
  y AS (SELECT DISTINCT source_id, edge_type, target, q2.t AS t2, q3.t AS t3, nm.t AS t4, pn.t AS t5, CASE WHEN edge_type = 'imports' THEN m.t END AS t6 FROM x LEFT JOIN qn q2 ON q2.qualname = clean LEFT JOIN qn q3 ON q3.qualname = rel LEFT JOIN nm ON nm.name = lst LEFT JOIN pn ON pn.path = x.path AND pn.name = lst LEFT JOIN m ON m.pre = clean)
SELECT source_id, edge_type, target, coalesce(t2, t3, t4, t5, t6) AS target_id, CASE WHEN t2 IS NOT NULL THEN 1.0::DOUBLE WHEN t3 IS NOT NULL THEN 0.9::DOUBLE WHEN t4 IS NOT NULL THEN 0.85::DOUBLE ELSE 0.8::DOUBLE END AS resolution FROM y WHERE coalesce(t2, t3, t4, t5, t6) <> source_id""",
    "artifact_problems": """WITH p AS (SELECT 'node without id, label or kind' AS problem, count(*) AS n FROM units WHERE coalesce(unit_id, '') = '' OR coalesce(name, '') = '' OR coalesce(node_type, '') = ''
  UNION ALL SELECT 'repeated node id', count(*) FROM (SELECT unit_id FROM units GROUP BY unit_id HAVING count(*) > 1) UNION ALL SELECT 'edge without source or relation', count(*) FROM units WHERE coalesce(parent_id, '') = ''
  UNION ALL SELECT 'edge without target or reference', count(*) FROM units WHERE coalesce(unit_id, '') = '' UNION ALL SELECT 'unknown confidence label', count(*) FROM units WHERE is_test
  UNION ALL SELECT 'edge from an unknown node', count(*) FROM units u WHERE NOT EXISTS (SELECT 1 FROM units v WHERE v.unit_id = u.parent_id)) SELECT problem, n FROM p WHERE n > 0""",
    "artifact_references": f"""WITH {GQ._ONE}, n AS (SELECT unit_id, path, {_NORM.format('name')} AS lb, {_NORM.format('qualname')} AS qn FROM u WHERE node_type <> 'file'),
  h AS (SELECT DISTINCT unit_id AS source, path, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS ref FROM u WHERE node_type IN ('function', 'method', 'test') AND content IS NOT NULL),
  k AS (SELECT *, {_NORM.format('ref')} AS key FROM h), c AS (SELECT DISTINCT source, k.path, ref, unit_id AS cand, n.path AS file FROM k JOIN n ON n.lb = key AND lb <> '' UNION SELECT source, k.path, ref, unit_id, n.path FROM k JOIN n ON n.qn = key AND qn <> ''),
  s AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (file = path) OVER w AS own, row_number() OVER (PARTITION BY source, ref ORDER BY cand) AS i FROM c WINDOW w AS (PARTITION BY source, ref)),
  f AS (SELECT source, cand AS target, CASE WHEN n = 1 OR own = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM s WHERE (own = 1 AND file = path) OR (own <> 1 AND i <= 5)
    UNION ALL SELECT source, 'external:calls:' || replace(key, ' ', '-'), 'EXTRACTED' FROM k WHERE (source, ref) NOT IN (SELECT (source, ref) FROM c)),
  o AS (SELECT source, target, min(confidence) AS confidence, count(DISTINCT confidence) AS k FROM f GROUP BY source, target)
SELECT source, target, confidence, CASE confidence WHEN 'INFERRED' THEN 0.72::DOUBLE WHEN 'AMBIGUOUS' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM o""",
    "first_fit_budget": f"""WITH RECURSIVE c AS (SELECT split_part(path, '/', 1) AS task_id, unit_id, greatest(1, (length(content) + 3) // 4) AS cost, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY length(path) DESC, unit_id) AS n
    FROM {RQ._U} WHERE content IS NOT NULL AND node_type IN ('function', 'method', 'test')),
  r AS (SELECT DISTINCT task_id, 0::BIGINT AS n, 0::BIGINT AS used, false AS fit FROM c UNION ALL SELECT c.task_id, c.n, CASE WHEN used + cost <= 800 THEN used + cost ELSE used END, used + cost <= 800 FROM r JOIN c ON c.task_id = r.task_id AND c.n = r.n + 1)
SELECT c.task_id, c.unit_id, CAST(c.n AS INTEGER) AS n, CAST(c.cost AS INTEGER) AS cost FROM r JOIN c ON c.task_id = r.task_id AND c.n = r.n WHERE fit""",
    "replaced_files": f"""WITH l AS ({_LAST}), f AS ({_FIRST}), c AS (SELECT l.path FROM l JOIN f USING (path) WHERE l.content_hash <> f.content_hash OR f.parse_error IS NOT NULL)
SELECT path, content_hash, mtime_ns FROM f WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, content_hash, mtime_ns FROM l WHERE path IN (SELECT path FROM c)""",
    "recorded_errors": f"""WITH l AS (SELECT * FROM ({_LAST}) WHERE trim(parse_error) <> ''), f AS ({_FIRST})
SELECT path, content_hash, parse_error FROM f WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT path, content_hash, substr(parse_error, 1, 1000) FROM l""",
    "dropped_files": "SELECT node_type, count(*) AS n FROM units WHERE path NOT IN (SELECT path FROM units WHERE node_type = 'file' AND content IS NULL) GROUP BY node_type",
    "kept_vectors": "SELECT provider, count(*) AS n FROM unit_vectors WHERE unit_id IN (SELECT unit_id FROM units WHERE node_type IN ('function', 'method')) GROUP BY provider",
    "vector_search_joined": """WITH v AS (SELECT DISTINCT v.unit_id, v.vector::DOUBLE[] AS x FROM unit_vectors v JOIN units u ON u.unit_id = v.unit_id AND u.content_hash = v.content_hash WHERE provider = 'local-hash' AND dimensions = 128 AND len(vector) = 128 AND len(list_filter(vector, lambda e: isnan(e) OR e IS NULL)) = 0),
  q AS (SELECT x AS y FROM v ORDER BY unit_id LIMIT 1), s AS (SELECT unit_id, round(coalesce(list_cosine_similarity(x, y), 0), 9) AS similarity FROM v, q WHERE len(list_filter(x, lambda e: e <> 0)) > 0)
SELECT * FROM (SELECT unit_id, similarity FROM s ORDER BY similarity DESC, unit_id LIMIT 15) WHERE similarity > 0""",
}
