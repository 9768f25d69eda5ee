"""Queries of problem 5: full hierarchies from parent-child links."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import hierarchy as H

from .tables import table


def p5_found(spark, folder):
    rows = H.hierarchy(table(spark, folder, "units"))
    return rows.select(F.col("node").alias("unit_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p5_paths(spark, folder):
    rows = H.hierarchy(table(spark, folder, "units"), separator=" > ")
    return rows.select(F.col("node").alias("unit_id"), "path", "cyclic")


def p5_descendants(spark, folder):
    rows = H.descendants(table(spark, folder, "units"))
    return rows.select(F.col("ancestor").alias("ancestor_id"), F.col("node").alias("unit_id"), "distance")


QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_LINKS = """
  nodes AS (SELECT DISTINCT unit_id FROM units WHERE unit_id IS NOT NULL),
  link AS (SELECT n.unit_id, min(p.unit_id) AS parent FROM nodes n
    LEFT JOIN units u ON u.unit_id = n.unit_id LEFT JOIN nodes p ON p.unit_id = u.parent_id GROUP BY n.unit_id)"""
_TREE = f"""WITH RECURSIVE {_LINKS},
  tree AS (SELECT unit_id, unit_id AS root_id, 0 AS depth, unit_id AS path FROM link WHERE parent IS NULL
    UNION ALL SELECT l.unit_id, t.root_id, t.depth + 1, t.path || ' > ' || l.unit_id FROM link l JOIN tree t ON l.parent = t.unit_id)"""

ORACLES = {
    "p5_found": _TREE
    + """,
  rest AS (SELECT * FROM link WHERE unit_id NOT IN (SELECT unit_id FROM tree)),
  walk AS (SELECT unit_id AS start, parent AS hit FROM rest
    UNION SELECT w.start, r.parent FROM walk w JOIN rest r ON w.hit = r.unit_id),
  oncycle AS (SELECT start AS unit_id FROM walk WHERE start = hit)
SELECT unit_id, root_id, CAST(depth AS INTEGER) AS depth FROM tree
UNION ALL SELECT w.start, min(w.hit), CAST(-1 AS INTEGER) FROM walk w JOIN oncycle c ON c.unit_id = w.hit GROUP BY w.start""",
    "p5_paths": _TREE
    + """
SELECT l.unit_id, t.path, t.unit_id IS NULL AS cyclic FROM link l LEFT JOIN tree t ON t.unit_id = l.unit_id""",
    "p5_descendants": f"""WITH RECURSIVE {_LINKS},
  good AS (SELECT unit_id FROM (WITH RECURSIVE t AS (SELECT unit_id FROM link WHERE parent IS NULL UNION ALL SELECT l.unit_id FROM link l JOIN t ON l.parent = t.unit_id) SELECT unit_id FROM t)),
  up AS (SELECT l.parent AS ancestor_id, l.unit_id, 1 AS distance FROM link l JOIN good g ON g.unit_id = l.unit_id WHERE l.parent IS NOT NULL
    UNION ALL SELECT l.parent, u.unit_id, u.distance + 1 FROM up u JOIN link l ON l.unit_id = u.ancestor_id WHERE l.parent IS NOT NULL)
SELECT ancestor_id, unit_id, CAST(distance AS INTEGER) AS distance FROM up""",
}
