"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import cooccur, docpairs, leak, mixture, neighbors, parse, quality, split


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark, folder):
    units = _table(spark, folder, "units")
    # Java with bracketed list literals too: most Java files of these tables use them, and the tables' own parse reports call those sound
    return parse.parse_files(units.where("node_type = 'file'"), dialects=parse.JAVA_LISTS).where("parse_error").select("path").distinct()


def p1_rates(spark, folder):
    return parse.parse_rates(*(_table(spark, folder, t) for t in ("units", "files", "extractions")), dialects=parse.JAVA_LISTS)


def p2_pairs(spark, folder):
    return cooccur.pair_lift(_table(spark, folder, "commit_evidence"), min_support=4, min_lift=3.0)


def p2_found(spark, folder):
    return p2_pairs(spark, folder).select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p3_found(spark, folder):
    return docpairs.documented_units(_table(spark, folder, "units")).select("unit_id").distinct()


def p3_functions(spark, folder):
    return docpairs.documented_functions(_table(spark, folder, "units").where("node_type = 'file'")).distinct()


def p4_found(spark, folder):
    return neighbors.similar_pairs(_table(spark, folder, "unit_vectors"), 5, 0.8).select("provider", "unit_id_a", "unit_id_b")


def p4_neighbors(spark, folder):
    return neighbors.most_similar(_table(spark, folder, "unit_vectors"), 5, shortlist=32)


def p6_found(spark, folder):
    return split.split_oversized(_table(spark, folder, "units"), 4000, 200).select("unit_id").distinct()


def p6_pieces(spark, folder):
    return split.split_oversized(_table(spark, folder, "units"), 4000, 200)


def p7_found(spark, folder):
    found = leak.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_tasks"))
    return found.select("doc_id", "task_id")


def p7_tests(spark, folder):
    return leak.leaked_tests(leak.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_tasks")))


def p8_mixture(spark, folder):
    return mixture.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p8_shares(spark, folder):
    return mixture.shares(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p9_found(spark, folder):
    return quality.not_prose(_table(spark, folder, "documents")).select("doc_id")


def p9_statistics(spark, folder):
    return quality.statistics(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_pairs, p3_found, p3_functions, p4_found, p4_neighbors, p6_found, p6_pieces, p7_found, p7_tests, p8_mixture, p8_shares, p9_found, p9_statistics)}

_PAIRS = """
WITH e AS (SELECT commit_hash AS c, unnest(changed_files) AS f FROM commit_evidence WHERE commit_hash IS NOT NULL),
  n AS (SELECT DISTINCT c, array_to_string(list_filter(string_split(replace(regexp_replace(f, '^\\s+|\\s+$', '', 'g'), chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS p FROM e),
  m AS (SELECT c, p, split_part(p, '/', 1) AS r, count(*) OVER (PARTITION BY c) AS k FROM n WHERE p <> ''),
  b AS (SELECT * FROM m WHERE k <= 50),
  i AS (SELECT p, count(*) AS n_item FROM b GROUP BY p),
  s AS (SELECT r, count(DISTINCT c) AS n FROM b GROUP BY r),
  q AS (SELECT x.r AS scope, x.p AS item_a, y.p AS item_b, count(*) AS n_ab FROM b x JOIN b y ON x.c = y.c AND x.r = y.r AND x.p < y.p GROUP BY ALL HAVING count(*) >= 4)
SELECT {0} FROM q JOIN i a ON a.p = item_a JOIN i z ON z.p = item_b JOIN s ON s.r = scope WHERE n_ab * n >= 3 * a.n_item * z.n_item"""

ORACLES = {
    "p2_found": _PAIRS.format("item_a AS path_a, item_b AS path_b"),
    "p2_pairs": _PAIRS.format("scope, item_a, item_b, n_ab, a.n_item AS n_a, z.n_item AS n_b, n, round(n_ab * n / (a.n_item * z.n_item), 6) AS lift"),
    "p6_found": "SELECT DISTINCT unit_id FROM units WHERE length(content) > 4000",
    "p7_found": """
WITH t AS (SELECT id, list_transform(regexp_extract_all(task, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_tasks),
  g AS (SELECT DISTINCT id, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
  d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
  dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d))
SELECT DISTINCT dg.doc_id, g.id AS task_id FROM dg JOIN g ON g.gram = dg.gram""",
    "p7_tests": """
WITH t AS (SELECT id, list_transform(regexp_extract_all(task, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_tasks),
  g AS (SELECT DISTINCT id, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
  d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
  dg AS (SELECT doc_id, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d))
SELECT g.id AS task_id, count(DISTINCT dg.doc_id) AS documents, count(*) AS passages FROM dg JOIN g ON g.gram = dg.gram GROUP BY g.id""",
    "p9_statistics": f"""
WITH a AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w, trim(text, chr(10) || chr(13) || chr(9) || ' ') AS body FROM documents WHERE text IS NOT NULL),
  b AS (SELECT doc_id, len(w) AS words, length(array_to_string(w, '')) AS letters, len(list_distinct(w)) AS kinds, len(list_filter(w, lambda x: list_contains([{", ".join("'" + w.replace("'", "''") + "'" for w in quality._COMMON)}], x))) AS common,
    length(translate(text, ' ' || chr(10) || chr(9) || chr(13) || chr(160) || chr(12288), '')) AS chars, length(text) - length(translate(text, '0123456789', '')) AS digits, length(text) - length(translate(text, '.,;:!?''"()-', '')) AS punct,
    length(body) - length(replace(body, chr(10), '')) + 1 AS n_lines, len(regexp_extract_all(regexp_replace(body, '\\r\\n?', chr(10), 'g'), '(?m)[.!?…]["''»”)*`]*[ \\t]*$')) AS stops FROM a)
SELECT doc_id, CAST(words AS INTEGER) AS words, round(letters / greatest(1, words), 6) AS mean_word_length, round((chars - letters - digits - punct) / greatest(1, chars), 6) AS symbol_ratio, round(digits / greatest(1, chars), 6) AS digit_ratio,
  round(stops / greatest(1, n_lines), 6) AS stop_line_share, round(common / greatest(1, words), 6) AS common_word_share, round(kinds / greatest(1, words), 6) AS distinct_word_share, CAST(n_lines AS INTEGER) AS lines FROM b""",
}
