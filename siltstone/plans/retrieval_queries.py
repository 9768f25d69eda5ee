"""Queries of text search, vectors, history, fusion, routing and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evaluation, fusion, history, incremental, lexical, routing, selection, semantic, symbols
from siltstone.functions.hashing import HashEmbedder, hash_embedding_udf

from .stage import spread
from .tables import table

BM25_QUERY = "sort the remaining ranker candidates before the journal entry is pruned"
SYMBOL_QUERY = "ranker_limit merge snapshot"
HISTORY_TASK = "align the encoder and fix the session limit"
AS_OF = "2025-06-01 00:00:00"
TASKS = [
    "Fix the crash in the parser", "Remove the prefix from names", "Close the file after use", "Rename the loader module", "Add support for YAML", "Update the README",
    "Upgrade the HTTP dependency", "Write a test for the router", "Requests are lost across workers", "The cache fails on restart", "Show recent changes to the API", "Explain the design",
    "do not search the repository, just answer", "", "Improve coverage of the cli", "Extract a helper", "Move the config", "Introduce streaming", "regression between releases", "What did the code do previously",
]
EMBED_QUERY = "the oldest entry leaves when a new one arrives"


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- text ---------------------------------------------------------------------


def lexical_bm25_topk(spark, folder):
    rows = lexical.search(table(spark, folder, "units"), BM25_QUERY, limit=20, stem=False)
    return rows.select("unit_id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"), F.size("matched_terms").alias("n_matched"))


def lexical_bm25_stemmed(spark, folder):
    rows = lexical.search(table(spark, folder, "units"), BM25_QUERY, limit=20, stem=True)
    return rows.select("unit_id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


def postings_bm25(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    hits = lexical.bm25_postings(lexical.build_postings(docs, "doc", {"text": 1.0}), {"text": 1.0}, BM25_QUERY, docs=docs)
    return hits.select(F.col("doc").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


def query_terms(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.query_terms(F.col("text"))).alias("pos", "term"))


def token_estimate(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.groupBy("lang").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("n"))


def content_hash_dups(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def path_features(spark, folder):
    rows = table(spark, folder, "files").select("path").distinct()
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return rows.select("path", T.module_name(F.col("path")).alias("module"), T.is_test(F.col("path"), name).alias("is_test"), T.parent_directory(F.col("path")).alias("directory"),
                       F.array_join(T.path_terms(F.col("path")), " ").alias("terms"), F.size(T.directories(F.col("path"))).alias("depth"))


# -- symbols and vectors ------------------------------------------------------


def symbol_match_ladder(spark, folder):
    return symbols.search(table(spark, folder, "units"), SYMBOL_QUERY, limit=50, fuzzy=False).select("unit_id", "score", "exact")


def symbol_fuzzy(spark, folder):
    return symbols.search(table(spark, folder, "units"), SYMBOL_QUERY, limit=50).select("unit_id", F.round("score", 6).alias("score"), "exact")


def vector_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    query = rows.where("vec_id = 0").first().embedding
    return semantic.top_k(rows, query, 20, key="vec_id", vector="embedding").select("vec_id", F.round("similarity", 6).alias("similarity"))


def hash_embedding_topk(spark, folder):
    docs = spread(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"), "doc_id").select("doc_id", hash_embedding_udf(128)(F.col("text")).alias("vector"))
    return semantic.top_k(docs, HashEmbedder(128).embed(EMBED_QUERY).tolist(), 20, key="doc_id")


def fresh_embedding_join(spark, folder):
    rows = semantic.fresh(table(spark, folder, "unit_vectors"), table(spark, folder, "units"))
    return rows.select("provider", "unit_id", "content_hash").distinct().groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def pending_embeddings(spark, folder):
    held = table(spark, folder, "unit_vectors").dropDuplicates(["provider", "unit_id", "content_hash"])
    units = table(spark, folder, "units").dropDuplicates(["unit_id"])
    return semantic.pending(units, held, "local-hash").groupBy("node_type").agg(F.count_distinct("unit_id").alias("n"))


# -- incremental --------------------------------------------------------------


def _indexings(spark, folder):
    files = table(spark, folder, "files").distinct()
    ends = [F.col("mtime_ns"), F.col("size_bytes"), F.col("content_hash"), F.coalesce("parse_error", F.lit(""))]
    return incremental.latest(files, ["path"], [c.desc() for c in ends]), incremental.latest(files, ["path"], [c.asc() for c in ends])


def incremental_diff(spark, folder):
    """The files as the units last read them against their first indexing."""
    read = table(spark, folder, "units").where("node_type = 'file'").groupBy("path").agg(F.min("content_hash").alias("content_hash"))
    return incremental.diff(read, _indexings(spark, folder)[1])


def keep_last_indexing(spark, folder):
    return _indexings(spark, folder)[0].select("path", "content_hash", "mtime_ns", "size_bytes")


def parse_failures(spark, folder):
    return incremental.failures(table(spark, folder, "files").where("trim(parse_error) <> ''")).distinct()


def index_status(spark, folder):
    return incremental.status(**{t: table(spark, folder, t) for t in ("files", "units", "commit_evidence", "unit_vectors", "extractions", "documents")})


# -- history ------------------------------------------------------------------


def _commit_files(spark, folder):
    return history.commit_files(table(spark, folder, "commit_evidence"))


def hotspots(spark, folder):
    return history.hotspots(_commit_files(spark, folder), table(spark, folder, "files"), 50)


def co_change_pairs(spark, folder):
    rows = history.co_changes(_commit_files(spark, folder), 50).where("n >= 2")
    return rows.select("path_a", "path_b", "n", F.round("confidence", 6).alias("confidence"))


def co_change_counts(spark, folder):
    """All pairs, also those of one commit, which the SQL of co_change_pairs leaves out."""
    rows = history.co_changes(_commit_files(spark, folder), 50)
    return rows.select("path_a", "path_b", "n", F.round("confidence", 6).alias("confidence"))


def commit_recency(spark, folder):
    rows = table(spark, folder, "commit_evidence").select("commit_hash", "authored_at").distinct()
    return rows.select("commit_hash", F.round(T.recency(F.col("authored_at"), F.lit(AS_OF).cast("timestamp")), 6).alias("recency"))


def history_score(spark, folder):
    files = table(spark, folder, "files")
    rows = history.search(table(spark, folder, "commit_evidence"), files, HISTORY_TASK, AS_OF, limit=None)
    return rows.select("commit_hash", F.round("lexical", 6).alias("lexical"), F.round("existing", 6).alias("existing"), F.round("score", 6).alias("score"), F.size("message_overlap").alias("n_terms"))


def anchor_jaccard(spark, folder):
    anchors = F.array(F.lit("harborline/CHANGELOG.md"), F.lit("harborline/deps.lock"))
    rows = table(spark, folder, "commit_evidence").where("changed_files is not null").select("commit_hash", F.array_sort(F.array_distinct("changed_files")).alias("f")).distinct()
    return rows.select("commit_hash", F.round(T.jaccard(F.filter("f", lambda x: x.isNotNull()), anchors), 6).alias("jaccard")).where("jaccard > 0")


# -- fusion and selection -----------------------------------------------------


def _commit_signals(spark, folder):
    rows = table(spark, folder, "commit_evidence").select(F.col("commit_hash").alias("unit_id"), "lexical_score", "semantic_score", "score").distinct()
    parts = [fusion.signals(rows, s, c, reason=F.lit(c), seq=i) for i, (s, c) in enumerate((("bm25", "lexical_score"), ("semantic", "semantic_score"), ("git_history", "score")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def candidate_merge(spark, folder):
    rows = fusion.merge(_commit_signals(spark, folder))
    at = lambda k: F.round(F.coalesce(F.col("source_scores")[k], F.lit(0.0)), 6).alias(k)
    return rows.select(F.col("unit_id").alias("commit_hash"), at("bm25"), at("semantic"), at("git_history"), F.array_join("retrieved_by", ",").alias("retrieved_by"), F.array_join("reasons", ",").alias("reasons"))


def noisy_or_fusion(spark, folder):
    rows = fusion.merge(_commit_signals(spark, folder))
    w = F.map_values(fusion.weighted(F.col("source_scores")))
    return rows.select(F.col("unit_id").alias("commit_hash"), F.round(F.array_max(w), 6).alias("strongest"), F.round(fusion.noisy_or(w), 6).alias("agreement"))


def redundancy_penalty(spark, folder):
    units = table(spark, folder, "units").where("content is not null")
    rows = units.select("unit_id", "path", "start_line", "end_line", F.round(1.0 / (1.0 + F.length("name")), 6).alias("score"), T.token_estimate(F.col("content")).alias("estimated_tokens"))
    return fusion.redundancy_penalty(rows.dropDuplicates(["unit_id"])).select("unit_id", F.round("overlap", 6).alias("overlap"), F.round("score", 6).alias("score"))


def rerank_hybrid(spark, folder):
    units = table(spark, folder, "units")
    a = fusion.signals(lexical.search(units, BM25_QUERY, limit=40, stem=False), "bm25", "score", seq=0)
    b = symbols.search(units, SYMBOL_QUERY, limit=25)
    b = fusion.signals(b, "symbol_search", "score", seq=1000, exact=F.col("exact"))
    return fusion.rerank(fusion.merge(a.unionByName(b)), units, BM25_QUERY).select("rank", "unit_id", F.round("score", 6).alias("score"), F.array_join("retrieved_by", ",").alias("retrieved_by"))


def _budget_candidates(spark, folder):
    """Per repository all units with content in order of path length, as candidates of one task each."""
    units = table(spark, folder, "units").where("content is not null and node_type in ('function', 'method', 'test')").dropDuplicates(["unit_id"])
    repo = F.substring_index("path", "/", 1)
    w = Window.partitionBy("task_id").orderBy(F.length("path").desc(), "unit_id")
    rows = units.withColumn("task_id", repo).withColumn("n", F.row_number().over(w))
    return rows.withColumn("score", 1.0 / F.col("n")).withColumn("retrieved_by", F.array(F.when(F.col("n") % 2 == 0, "bm25").otherwise("semantic"))).withColumn("reasons", F.array(F.lit("long path"))).withColumn("graph_distance", F.lit(None).cast("int"))


def budget_select(spark, folder):
    return selection.select(_budget_candidates(spark, folder), 1500).select("task_id", "unit_id", "selected", "place", "cost")


def first_fit_budget(spark, folder):
    rows = _budget_candidates(spark, folder).select("task_id", "unit_id", "n", T.token_estimate(F.col("content")).alias("cost"))
    return selection.first_fit(rows, 800, group="task_id", order=["n"], cost="cost")


# -- routing ------------------------------------------------------------------


def route_classify(spark, folder):
    inline = spark.createDataFrame([(f"inline-{i:02d}", t) for i, t in enumerate(TASKS)], "id string, task string")
    rows = inline.unionByName(table(spark, folder, "eval_tasks").select("id", "task"))
    return routing.route(rows).select("id", "task_type", F.array_join("selected_sources", ",").alias("sources"))


# -- evaluation ---------------------------------------------------------------


def _ranked_items(spark, folder):
    """For every task, the gold ranges of all tasks that share a file with it, shifted by a line, in order of the other task."""
    tasks = table(spark, folder, "eval_tasks").select(F.col("id").alias("task_id"), "gold_files", "gold_symbols", "gold_line_ranges", "task")
    ranges = tasks.select(F.col("task_id").alias("other"), F.explode("gold_line_ranges").alias("r"), F.try_element_at("gold_symbols", F.lit(1)).alias("symbol"))
    ranges = ranges.select("other", F.col("r.file").alias("file"), "symbol", (F.col("r.start_line") + 1).alias("start_line"), (F.col("r.end_line") + 1).alias("end_line"))
    wanted = tasks.select("task_id", F.explode(F.array_distinct("gold_files")).alias("file"))
    rows = wanted.join(ranges, "file").withColumn("estimated_tokens", (F.col("end_line") - F.col("start_line") + 1) * 10).withColumn("sources", F.array(F.when(F.col("start_line") % 2 == 0, "bm25").otherwise("semantic")))
    order = Window.partitionBy("task_id").orderBy(F.sha2("other", 256), "file", "start_line", "end_line")
    return tasks, rows.withColumn("rank", F.row_number().over(order))


def ir_metrics(spark, folder):
    tasks, items = _ranked_items(spark, folder)
    rows = evaluation.metrics(tasks, items, 5)
    keep = ("file_recall_at_k", "file_precision_at_k", "complete_file_recall_at_k", "package_file_recall", "symbol_recall_at_k", "mrr", "ndcg_at_k", "selected_context_relevance")
    return rows.select("task_id", *(F.round(c, 6).alias(c) for c in keep), F.col("context_tokens").cast("long").alias("context_tokens"), F.col("selected_file_count").cast("long").alias("selected_file_count"))


def mean_ir_metrics(spark, folder):
    tasks, items = _ranked_items(spark, folder)
    rows = evaluation.mean_metrics(evaluation.metrics(tasks, items, 5).withColumn("configuration", F.lit("shared files")), "configuration")
    return rows.select("configuration", "tasks", *(F.round(c, 6).alias(c) for c in ("file_recall_at_k", "mrr", "ndcg_at_k")), "context_tokens")


def interval_coverage(spark, folder):
    tasks, items = _ranked_items(spark, folder)
    return evaluation.line_coverage(tasks, items).select("task_id", F.round("gold_line_coverage", 6).alias("coverage"))


def filename_baseline(spark, folder):
    tasks = table(spark, folder, "eval_tasks").select(F.col("id").alias("task_id"), "task")
    return evaluation.filename_baseline(table(spark, folder, "files").select("path").distinct(), tasks).where("rank <= 10")


QUERIES = {f.__name__: f for f in (
    lexical_bm25_topk, lexical_bm25_stemmed, postings_bm25, query_terms, token_estimate, content_hash_dups, path_features, symbol_match_ladder, symbol_fuzzy, vector_topk, hash_embedding_topk,
    fresh_embedding_join, pending_embeddings, incremental_diff, keep_last_indexing, parse_failures, index_status, hotspots, co_change_pairs, co_change_counts, commit_recency, history_score, anchor_jaccard, candidate_merge,
    noisy_or_fusion, redundancy_penalty, rerank_hybrid, budget_select, first_fit_budget, route_classify, ir_metrics, mean_ir_metrics, interval_coverage, filename_baseline,
)}

# -- SQL ----------------------------------------------------------------------

_TERM = "[A-Za-z_][A-Za-z0-9_]{1,}|[0-9]{2,}"
_STOPS = _sql_list(T.STOP_WORDS)
_U = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY path) AS _n FROM units) WHERE _n = 1)"


def _tokens(column):
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(source, key, fields, query):
    """CTEs hit and bm of field-weighted BM25 for a query of single-token terms."""
    terms = T.query_terms_of(query)
    parts = ", ".join(f"{_tokens(f)} AS t_{f}" for f in fields)
    size = " + ".join(f"len(t_{f})" for f in fields)
    counts = ", ".join("(" + " + ".join(f"{w} * len(list_filter(t_{f}, lambda x: x = '{t}'))" for f, w in fields.items()) + f") AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    score = " + ".join(
        f"greatest(ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avgdl))" for i in range(len(terms)))
    anyhit = " + ".join(f"f{i}" for i in range(len(terms)))
    return (f"tk AS (SELECT {key}, {parts} FROM {source}), hit AS (SELECT {key}, {size} AS d, {counts} FROM tk), "
            f"st AS (SELECT count(*) AS n_docs, avg(d) AS avgdl, {df} FROM hit), bm AS (SELECT {key}, {score} AS bm25 FROM hit, st WHERE {anyhit} > 0)")


_matched = " + ".join(f"CAST(contains(lower(concat_ws(' ', path, qualname, signature, docstring, content)), '{t}') AS INTEGER)" for t in T.query_terms_of(BM25_QUERY))


def _ladder_sql():
    terms, whole = T.query_terms_of(SYMBOL_QUERY), SYMBOL_QUERY.lower()
    rungs = ", ".join(f"CASE WHEN n = '{t}' THEN 0.98::DOUBLE WHEN q LIKE '%.' || replace('{t}', '_', '\\_') ESCAPE '\\' THEN 0.94::DOUBLE WHEN contains(n, '{t}') THEN 0.82::DOUBLE WHEN contains(q, '{t}') THEN 0.68::DOUBLE ELSE 0.0::DOUBLE END" for t in terms)
    exact = " OR ".join(f"n = '{t}' OR ends_with(q, '.{t}')" for t in terms)
    return f"""WITH u AS (SELECT unit_id, path, start_line, lower(name) AS n, lower(qualname) AS q FROM {_U} WHERE node_type IN ('class', 'function', 'method', 'test')),
  s AS (SELECT *, CASE WHEN q = '{whole}' OR n = '{whole}' OR ends_with(q, '.{whole}') THEN 1.0::DOUBLE ELSE greatest({rungs}) END AS score, ({exact}) AS exact FROM u)
SELECT unit_id, score, exact FROM s WHERE score >= 0.35 ORDER BY score DESC, path, start_line, unit_id LIMIT 50"""


_CF = "cf AS (SELECT DISTINCT commit_hash, path FROM (SELECT commit_hash, unnest(changed_files) AS path FROM commit_evidence) WHERE commit_hash IS NOT NULL AND coalesce(path, '') <> '')"
_ITEMS = """t AS (SELECT id AS task_id, gold_files, gold_symbols, gold_line_ranges FROM eval_tasks),
  rg AS (SELECT other, r.file AS file, symbol, r.start_line + 1 AS start_line, r.end_line + 1 AS end_line FROM (SELECT task_id AS other, unnest(gold_line_ranges) AS r, gold_symbols[1] AS symbol FROM t)),
  w AS (SELECT task_id, unnest(list_distinct(gold_files)) AS file FROM t),
  it AS (SELECT w.task_id, w.file, rg.symbol, rg.start_line, rg.end_line, (rg.end_line - rg.start_line + 1) * 10 AS tok,
    row_number() OVER (PARTITION BY w.task_id ORDER BY sha256(rg.other), w.file, rg.start_line, rg.end_line) AS rank FROM w JOIN rg ON rg.file = w.file)"""
_METRICS = _ITEMS + """,
  ff AS (SELECT task_id, file, min(rank) AS r FROM it WHERE rank <= 5 GROUP BY ALL),
  fp AS (SELECT task_id, file, row_number() OVER (PARTITION BY task_id ORDER BY r) AS pos FROM ff),
  fs AS (SELECT DISTINCT task_id, symbol FROM it WHERE rank <= 5),
  pk AS (SELECT DISTINCT task_id, file FROM it),
  m AS (SELECT t.task_id, len(list_distinct(gold_files)) AS ngf, len(list_distinct(gold_symbols)) AS ngs,
    (SELECT count(*) FROM fp WHERE fp.task_id = t.task_id AND list_contains(t.gold_files, fp.file)) AS rel,
    (SELECT count(*) FROM pk WHERE pk.task_id = t.task_id AND list_contains(t.gold_files, pk.file)) AS prel,
    (SELECT count(*) FROM fs WHERE fs.task_id = t.task_id AND list_contains(t.gold_symbols, fs.symbol)) AS srel,
    (SELECT min(pos) FROM fp WHERE fp.task_id = t.task_id AND list_contains(t.gold_files, fp.file)) AS first,
    (SELECT coalesce(sum(1 / log2(pos + 1)), 0) FROM fp WHERE fp.task_id = t.task_id AND list_contains(t.gold_files, fp.file)) AS dcg,
    (SELECT count(*) FROM it WHERE it.task_id = t.task_id AND rank <= 5) AS ntop,
    (SELECT count(*) FROM it WHERE it.task_id = t.task_id AND rank <= 5 AND list_contains(t.gold_files, it.file)) AS nrel,
    (SELECT coalesce(sum(tok), 0) FROM it WHERE it.task_id = t.task_id) AS tok,
    (SELECT count(*) FROM pk WHERE pk.task_id = t.task_id) AS nfiles FROM t),
  res AS (SELECT task_id, rel / greatest(1, ngf) AS file_recall_at_k, rel / 5 AS file_precision_at_k, CASE WHEN ngf > 0 AND rel = ngf THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS complete_file_recall_at_k,
    prel / greatest(1, ngf) AS package_file_recall, srel / greatest(1, ngs) AS symbol_recall_at_k, coalesce(1 / first, 0) AS mrr,
    coalesce(dcg / nullif((SELECT sum(1 / log2(i + 1)) FROM range(1, least(5, ngf) + 1) g(i)), 0), 0) AS ndcg_at_k, nrel / greatest(1, ntop) AS selected_context_relevance, tok, nfiles FROM m)"""


def _route_sql():
    def anyof(phrases):
        return "(" + " OR ".join("contains(x, '" + p.replace("'", "''") + "')" for p in phrases) + ")"

    branches = []
    for name, phrases in routing.CLASSES.items():
        value = f"CASE WHEN {anyof(routing.CROSS_FILE)} THEN 'cross_file_bug' ELSE 'local_bug' END" if name == "bug" else f"'{name}'"
        branches.append(f"WHEN {anyof(phrases)} THEN {value}")
    inline = ", ".join("('inline-%02d', '%s')" % (i, t.replace("'", "''")) for i, t in enumerate(TASKS))
    kinds = lambda s: "k IN (" + ", ".join(f"'{x}'" for x in routing.EXTRA[s]) + ")"
    extra = ", ".join(f"CASE WHEN {kinds(s)}{' OR ' + anyof(routing.PAST) if s in ('git_history', 'hotspots') else ''} THEN '{s}' END" for s in routing.EXTRA)
    return f"""WITH a AS (SELECT id, task FROM eval_tasks UNION ALL SELECT * FROM (VALUES {inline}) v(id, task)), b AS (SELECT id, lower(trim(coalesce(task, ''))) AS x FROM a),
  c AS (SELECT id, x, CASE WHEN x = '' OR {anyof(routing.NOTHING)} THEN 'none' {' '.join(branches)} ELSE 'general' END AS k FROM b)
SELECT id, k AS task_type, CASE WHEN k = 'none' THEN '' ELSE concat_ws(',', 'lexical', 'symbol', CASE WHEN k <> 'documentation' THEN 'semantic' END, {extra}) END AS sources FROM c"""


_FILES_ONE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime_ns {0}, size_bytes {0}, content_hash {0}, coalesce(parse_error, '') {0}) AS _n FROM files) WHERE _n = 1"

ORACLES = {
    "lexical_bm25_topk": f"""WITH u AS (SELECT * FROM {_U}), {_bm25_sql("u", "unit_id", lexical.UNIT_FIELDS, BM25_QUERY)},
  top AS (SELECT unit_id, bm25, {_matched} AS n_matched FROM bm JOIN u USING (unit_id) WHERE node_type <> 'module' ORDER BY round(bm25, 9) DESC, path, start_line, unit_id LIMIT 20)
SELECT unit_id, round(bm25, 6) AS bm25, round(bm25 / max(bm25) OVER (), 6) AS score, CAST(n_matched AS INTEGER) AS n_matched FROM top""",
    "postings_bm25": f"""WITH u AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {_bm25_sql("u", "doc_id", {"text": 1.0}, BM25_QUERY)}
SELECT doc_id, round(bm25, 6) AS bm25 FROM bm""",
    "query_terms": f"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TERM}')) AS t, generate_subscripts(regexp_extract_all(text, '{_TERM}'), 1) AS i FROM documents WHERE text IS NOT NULL),
  b AS (SELECT doc_id, lower(t) AS term, min(i) AS i FROM a WHERE NOT list_contains({_STOPS}, lower(t)) GROUP BY ALL),
  c AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM b)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM c WHERE pos < 24""",
    "token_estimate": "SELECT lang, CAST(sum(greatest(1, (length(text) + 3) // 4)) AS BIGINT) AS tokens, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang",
    "content_hash_dups": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "path_features": r"""WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM files),
  q AS (SELECT path, s, regexp_replace(replace(regexp_replace(path, '\.pyi?$', ''), '/', '.'), '\.__init__$', '') AS module FROM p)
SELECT path, CASE WHEN module = '' THEN '__init__' ELSE module END AS module,
  list_contains(s, 'test') OR list_contains(s, 'tests') OR starts_with(s[-1], 'test_') AS is_test,
  CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory,
  (SELECT string_agg(t, ' ' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT string_split(translate(lower(path), './', '__'), '_') AS x)) WHERE length(t) > 2 GROUP BY t)) AS terms,
  CAST(len(s) - 1 AS INTEGER) AS depth FROM q""",
    "symbol_match_ladder": _ladder_sql(),
    "vector_topk": """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM embeddings, q)
SELECT vec_id, round(c, 6) AS similarity FROM s WHERE c > 0 ORDER BY round(c, 9) DESC, vec_id LIMIT 20""",
    "fresh_embedding_join": "SELECT provider, count(*) AS n FROM (SELECT DISTINCT v.provider, v.unit_id, v.content_hash FROM unit_vectors v JOIN units u ON u.unit_id = v.unit_id AND u.content_hash = v.content_hash) GROUP BY provider",
    "pending_embeddings": f"""WITH v AS (SELECT DISTINCT unit_id, content_hash FROM unit_vectors WHERE provider = 'local-hash')
SELECT node_type, count(DISTINCT u.unit_id) AS n FROM {_U} u LEFT JOIN v ON v.unit_id = u.unit_id WHERE node_type IN ('file', 'class', 'function', 'method', 'test') AND v.content_hash IS DISTINCT FROM u.content_hash GROUP BY node_type""",
    "incremental_diff": f"""WITH a AS (SELECT path, min(content_hash) AS content_hash FROM units WHERE node_type = 'file' GROUP BY path), b AS ({_FILES_ONE.format('ASC')})
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'new' WHEN a.content_hash = b.content_hash AND b.parse_error IS NULL THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path""",
    "keep_last_indexing": f"SELECT path, content_hash, mtime_ns, size_bytes FROM ({_FILES_ONE.format('DESC')})",
    "parse_failures": "SELECT DISTINCT path, parse_error FROM files WHERE trim(parse_error) <> ''",
    "index_status": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("files", "units", "commit_evidence", "unit_vectors", "extractions", "documents")),
    "hotspots": f"WITH {_CF} SELECT path, count(*) AS changes FROM cf WHERE path IN (SELECT path FROM files) GROUP BY path ORDER BY changes DESC, path LIMIT 50",
    "co_change_pairs": f"""WITH {_CF}, k AS (SELECT *, count(*) OVER (PARTITION BY commit_hash) AS k FROM cf), g AS (SELECT * FROM k WHERE k BETWEEN 2 AND 50),
  p AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS n FROM g a JOIN g b ON a.commit_hash = b.commit_hash AND a.path < b.path GROUP BY ALL)
SELECT path_a, path_b, n, round(least(1.0::DOUBLE, n / (SELECT max(n) FROM p)), 6) AS confidence FROM p WHERE n >= 2""",
    "co_change_counts": f"""WITH {_CF}, k AS (SELECT *, count(*) OVER (PARTITION BY commit_hash) AS k FROM cf), g AS (SELECT * FROM k WHERE k BETWEEN 2 AND 50),
  p AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS n FROM g a JOIN g b ON a.commit_hash = b.commit_hash AND a.path < b.path GROUP BY ALL)
SELECT path_a, path_b, n, round(least(1.0::DOUBLE, n / (SELECT max(n) FROM p)), 6) AS confidence FROM p""",
    "commit_recency": f"SELECT DISTINCT commit_hash, round(1 / (1 + greatest(0, (epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(authored_at)) / 86400000000) / 365), 6) AS recency FROM commit_evidence",
    "history_score": f"""WITH {_CF}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash ORDER BY authored_at, message) AS _n FROM commit_evidence WHERE commit_hash IS NOT NULL) WHERE _n = 1),
  fl AS (SELECT commit_hash, string_agg(path, ' ' ORDER BY path) AS paths, sum(CASE WHEN path IN (SELECT path FROM files) THEN 1 ELSE 0 END) / count(*) AS existing FROM cf GROUP BY commit_hash),
  u AS (SELECT one.commit_hash, message, summary, authored_at, paths, coalesce(existing, 0) AS existing FROM one LEFT JOIN fl USING (commit_hash)),
  {_bm25_sql("u", "commit_hash", lexical.COMMIT_FIELDS, HISTORY_TASK)},
  s AS (SELECT u.commit_hash, coalesce(bm25 / (SELECT max(bm25) FROM bm), 0) AS lexical, existing,
    1 / (1 + greatest(0, (epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(authored_at)) / 86400000000) / 365) AS rec,
    len(list_intersect(list_distinct(list_transform(regexp_extract_all(message, '{_TERM}'), lambda x: lower(x))), {_sql_list(T.query_terms_of(HISTORY_TASK))})) AS n_terms
    FROM u LEFT JOIN bm USING (commit_hash)),
  r AS (SELECT *, least(1.0::DOUBLE, lexical * 0.45 + rec * 0.05 + existing * 0.05) AS score FROM s)
SELECT commit_hash, round(lexical, 6) AS lexical, round(existing, 6) AS existing, round(score, 6) AS score, CAST(n_terms AS INTEGER) AS n_terms FROM r WHERE score >= 0.25 AND n_terms > 0""",
    "anchor_jaccard": """WITH a AS (SELECT DISTINCT commit_hash, list_sort(list_distinct(changed_files)) AS f FROM commit_evidence WHERE changed_files IS NOT NULL),
  b AS (SELECT DISTINCT commit_hash, len(list_filter(f, lambda x: x IN ('harborline/CHANGELOG.md', 'harborline/deps.lock'))) AS i, len(f) AS n, f FROM a)
SELECT DISTINCT commit_hash, jaccard FROM (SELECT commit_hash, f, round(i / (n + 2 - i), 6) AS jaccard FROM b) WHERE jaccard > 0""",
    "candidate_merge": """WITH c AS (SELECT commit_hash, max(least(1, greatest(0, lexical_score))) AS b, max(least(1, greatest(0, semantic_score))) AS s, max(least(1, greatest(0, score))) AS g FROM commit_evidence GROUP BY commit_hash)
SELECT commit_hash, round(b, 6) AS bm25, round(s, 6) AS semantic, round(g, 6) AS git_history, 'bm25,semantic,git_history' AS retrieved_by, 'lexical_score,semantic_score,score' AS reasons FROM c""",
    "noisy_or_fusion": """WITH c AS (SELECT commit_hash, max(least(1, greatest(0, lexical_score))) * 1.0::DOUBLE AS b, max(least(1, greatest(0, semantic_score))) * 0.78::DOUBLE AS s, max(least(1, greatest(0, score))) * 0.6::DOUBLE AS g FROM commit_evidence GROUP BY commit_hash)
SELECT commit_hash, round(greatest(b, s, g), 6) AS strongest, round(1 - (1 - least(0.95::DOUBLE, b)) * (1 - least(0.95::DOUBLE, s)) * (1 - least(0.95::DOUBLE, g)), 6) AS agreement FROM c""",
    "redundancy_penalty": f"""WITH u AS (SELECT unit_id, path, start_line, end_line, round(1.0::DOUBLE / (1 + length(name)), 6) AS score, greatest(1, (length(content) + 3) // 4) AS tok FROM {_U} WHERE content IS NOT NULL),
  o AS (SELECT a.unit_id, max(greatest(0, least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) + 1) / greatest(1, a.end_line - a.start_line + 1)) AS overlap
    FROM u a JOIN u b ON a.path = b.path AND (-b.score, b.tok, b.start_line, b.unit_id) < (-a.score, a.tok, a.start_line, a.unit_id) GROUP BY a.unit_id),
  r AS (SELECT u.unit_id, coalesce(overlap, 0) AS overlap, score FROM u LEFT JOIN o USING (unit_id))
SELECT unit_id, round(overlap, 6) AS overlap, round(greatest(0, score - CASE WHEN overlap >= 0.8 THEN least(0.18::DOUBLE, overlap * 0.14::DOUBLE) ELSE 0 END), 6) AS score FROM r""",
    "route_classify": _route_sql(),
    "ir_metrics": f"WITH {_METRICS} SELECT task_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("file_recall_at_k", "file_precision_at_k", "complete_file_recall_at_k", "package_file_recall", "symbol_recall_at_k", "mrr", "ndcg_at_k", "selected_context_relevance")) + ", CAST(tok AS BIGINT) AS context_tokens, nfiles AS selected_file_count FROM res",
    "mean_ir_metrics": f"WITH {_METRICS} SELECT 'shared files' AS configuration, count(*) AS tasks, round(avg(file_recall_at_k), 6) AS file_recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k, CAST(round_even(avg(tok), 0) AS BIGINT) AS context_tokens FROM res",
    "interval_coverage": f"""WITH {_ITEMS}, g AS (SELECT task_id, generate_subscripts(gold_line_ranges, 1) AS g, unnest(gold_line_ranges) AS r FROM t WHERE gold_line_ranges IS NOT NULL),
  c AS (SELECT DISTINCT g.task_id, g.g, l FROM g JOIN it ON it.task_id = g.task_id AND it.file = g.r.file, LATERAL (SELECT unnest(range(greatest(g.r.start_line, it.start_line), least(g.r.end_line, it.end_line) + 1)) AS l)),
  n AS (SELECT task_id, sum(r.end_line - r.start_line + 1) AS total FROM g GROUP BY task_id)
SELECT n.task_id, round((SELECT count(*) FROM c WHERE c.task_id = n.task_id) / total, 6) AS coverage FROM n""",
    "filename_baseline": f"""WITH p AS (SELECT DISTINCT path FROM files), w AS (SELECT DISTINCT path AS file, term FROM (SELECT path, unnest(string_split(translate(lower(path), './', '__'), '_')) AS term FROM p) WHERE length(term) > 2),
  a AS (SELECT id AS task_id, unnest(regexp_extract_all(task, '{_TERM}')) AS t, generate_subscripts(regexp_extract_all(task, '{_TERM}'), 1) AS i FROM eval_tasks),
  b AS (SELECT task_id, lower(t) AS term, min(i) AS i FROM a WHERE NOT list_contains({_STOPS}, lower(t)) GROUP BY ALL),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY i) AS pos FROM b) WHERE pos <= 24),
  s AS (SELECT task_id, file, count(*) AS score FROM c JOIN w USING (term) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, file) AS rank FROM s)
SELECT task_id, file, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
}
