"""Change history: log parsing, co-change, hotspots, renames, gated search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import query_terms, query_terms_of, recency
from siltstone.operators.fusion import signals
from siltstone.operators.lexical import COMMIT_FIELDS, bm25_scan

#: Parts of the score, and the gate.
LEXICAL, SEMANTIC, ANCHOR, RECENCY, EXISTING = 0.45, 0.25, 0.2, 0.05, 0.05
LEAST_SCORE, STRONG_SEMANTIC = 0.25, 0.45
RECORD, FIELD = "\x1e", "\x1f"


def new_path(path: Column) -> Column:
    """Path after a rename written ``old => new`` or ``pre{old => new}post``; itself otherwise."""
    braced, plain = r"^(.*)\{(.*?)\s*=>\s*(.*?)\}(.*)$", r"^(.*?)\s*=>\s*(.*)$"
    inner = F.concat(F.regexp_extract(path, braced, 1), F.trim(F.regexp_extract(path, braced, 3)), F.regexp_extract(path, braced, 4))
    out = F.when(path.rlike(braced), inner).when(path.rlike(plain), F.trim(F.regexp_extract(path, plain, 2))).otherwise(path)
    return F.regexp_replace(out, "//+", "/")


def old_path(path: Column) -> Column:
    """Path before a rename; null if it is none."""
    braced, plain = r"^(.*)\{(.*?)\s*=>\s*(.*?)\}(.*)$", r"^(.*?)\s*=>\s*(.*)$"
    inner = F.concat(F.regexp_extract(path, braced, 1), F.trim(F.regexp_extract(path, braced, 2)), F.regexp_extract(path, braced, 4))
    out = F.when(path.rlike(braced), inner).when(path.rlike(plain), F.trim(F.regexp_extract(path, plain, 1)))
    return F.regexp_replace(out, "//+", "/")


def parse_log(records: DataFrame, column: str = "value") -> DataFrame:
    """Rows of log records (hash, ISO time, author, subject; then numstat lines) as commits with their files.

    ``(commit_hash, authored_at, author_name, message, files)``; a file is
    ``(path, additions, deletions, status, old_path)``, ``-`` counts as 0, status
    R for a rename, else A if nothing was deleted, else M.  Records with
    another header, and lines that aren't numstat, are left out.
    """
    lines = F.split(F.trim(F.col(column)), r"\r?\n")
    head = F.split(lines[0], FIELD, 4)
    rows = records.select(head.alias("head"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("lines")).where("size(head) = 4")
    number = lambda x: F.when(x.rlike(r"^[0-9]+$"), x.cast("int")).otherwise(0)

    def change(line):
        p = F.split(line, "\t", 3)
        old = old_path(p[2])
        status = F.when(old.isNotNull(), "R").when(number(p[1]) == 0, "A").otherwise("M")
        return F.struct(new_path(p[2]).alias("path"), number(p[0]).alias("additions"), number(p[1]).alias("deletions"), status.alias("status"), old.alias("old_path"))

    files = F.transform(F.filter("lines", lambda x: F.size(F.split(x, "\t", 3)) == 3), change)
    return rows.select(F.col("head")[0].alias("commit_hash"), F.try_to_timestamp(F.col("head")[1]).alias("authored_at"), F.col("head")[2].alias("author_name"), F.col("head")[3].alias("message"), files.alias("files"))


def scope(commits: DataFrame, folder: str) -> DataFrame:
    """Commits restricted to a folder, its prefix taken off; without files they go."""
    if folder in (".", ""):
        return commits
    prefix = folder.rstrip("/") + "/"
    cut = lambda p: F.when(p.startswith(prefix), F.substring(p, F.lit(len(prefix) + 1), F.length(p))).otherwise(p)
    kept = F.transform(F.filter("files", lambda f: f["path"].startswith(prefix)), lambda f: f.withField("path", cut(f["path"])).withField("old_path", cut(f["old_path"])))
    return commits.withColumn("files", kept).where(F.size("files") > 0)


def commit_files(commits: DataFrame, paths: str = "changed_files") -> DataFrame:
    """``(commit_hash, path)``, each once, without null or empty entries."""
    rows = commits.select("commit_hash", F.explode(paths).alias("path"))
    return rows.where("commit_hash is not null and coalesce(path, '') <> ''").distinct()


def co_changes(files: DataFrame, most_files: int = 50) -> DataFrame:
    """``(path_a, path_b, n, confidence)``, a < b: commits of 2 to ``most_files`` files that hold both; confidence relative to the largest count.

    The bound on a commit's files is the operator's definition and keeps a
    commit's pairs at ``most_files`` squared.
    """
    w = Window.partitionBy("commit_hash")
    rows = files.select("commit_hash", "path").distinct().withColumn("k", F.count(F.lit(1)).over(w)).where(F.col("k").between(2, most_files)).drop("k")
    a, b = rows.withColumnRenamed("path", "path_a"), rows.withColumnRenamed("path", "path_b")
    pairs = a.join(b, "commit_hash").where("path_a < path_b").groupBy("path_a", "path_b").agg(F.count(F.lit(1)).alias("n"))
    most = pairs.agg(F.max("n").alias("most"))
    return pairs.crossJoin(F.broadcast(most)).select("path_a", "path_b", "n", F.least(F.lit(1.0), F.col("n") / F.col("most")).alias("confidence"))  # one row


def related_files(pairs: DataFrame, path: str, limit: int = 10) -> DataFrame:
    """Files most often committed with a path."""
    hit = pairs.where((F.col("path_a") == path) | (F.col("path_b") == path))
    other = F.when(F.col("path_a") == path, F.col("path_b")).otherwise(F.col("path_a"))
    return hit.select(other.alias("related"), "n").orderBy(F.desc("n"), "related").limit(limit)


def hotspots(files: DataFrame, current: DataFrame, limit: int = 20) -> DataFrame:
    """``(path, changes)`` of present files by the number of commits."""
    counts = files.groupBy("path").agg(F.count(F.lit(1)).alias("changes"))
    return counts.join(current.select("path"), "path", "left_semi").orderBy(F.desc("changes"), "path").limit(limit)


def renames(commits: DataFrame, limit: int = 20) -> DataFrame:
    """Latest renames ``(commit_hash, old_path, new_path, message, authored_at)`` of parsed commits, by time."""
    rows = commits.select("commit_hash", "message", "authored_at", F.explode("files").alias("f")).where("f.status = 'R' and f.old_path is not null")
    return rows.select("commit_hash", F.col("f.old_path").alias("old_path"), F.col("f.path").alias("new_path"), "message", "authored_at").orderBy(F.desc("authored_at"), "commit_hash", "new_path").limit(limit)


def history_edges(files: DataFrame, units: DataFrame, most_files: int = 50) -> DataFrame:
    """Graph edges: file unit ``changed_in`` commit, and ``co_changed_with`` between file units."""
    of_path = units.where("node_type = 'file'").select("path", "unit_id").dropDuplicates(["path"])
    changed = files.join(of_path, "path").select(F.col("unit_id").alias("source_id"), F.concat(F.lit("commit:"), "commit_hash").alias("target_id"), F.lit("changed_in").alias("edge_type"), F.lit(1.0).alias("confidence"))
    pairs = co_changes(files, most_files)
    a = of_path.select(F.col("path").alias("path_a"), F.col("unit_id").alias("source_id"))
    b = of_path.select(F.col("path").alias("path_b"), F.col("unit_id").alias("target_id"))
    both = pairs.join(a, "path_a").join(b, "path_b").select("source_id", "target_id", F.lit("co_changed_with").alias("edge_type"), "confidence")
    return changed.unionByName(both)


def search(commits: DataFrame, current: DataFrame, task: str, as_of, *, anchors=(), semantic: DataFrame | None = None, limit: int | None = 8,
           least: float = LEAST_SCORE, stem: bool = False) -> DataFrame:
    """Commits that bear on a task: ``(commit_hash, message, authored_at, lexical, semantic, anchor, score, message_overlap, anchor_overlap, existing)``.

    Weighted sum of BM25 relative to the best, semantic similarity
    (``semantic``: commit_hash, similarity), share of the anchor paths changed,
    recency as of a given time and share of the files that still exist, at most 1.
    A commit passes with ``least`` and either a task term in its message or a
    strong similarity on an anchor file: touching the same file is no evidence.
    Order: score, then the newer one, then hash.
    """
    w = Window.partitionBy("commit_hash").orderBy("authored_at", "message")
    one = commits.where("commit_hash is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    files = commit_files(commits)
    present = current.select("path").distinct().withColumn("here", F.lit(1))
    by_commit = files.join(present, "path", "left").groupBy("commit_hash").agg(
        F.sort_array(F.collect_set("path")).alias("files"), (F.sum(F.coalesce("here", F.lit(0))) / F.count(F.lit(1))).alias("existing"))
    docs = one.join(by_commit, "commit_hash", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>"))).withColumn("paths", F.array_join("files", " "))
    strength = bm25_scan(docs, "commit_hash", COMMIT_FIELDS, task, stem=stem)
    best = strength.agg(F.max("bm25").alias("best"))
    relative = strength.crossJoin(F.broadcast(best)).select("commit_hash", F.when(F.col("best") > 0, F.col("bm25") / F.col("best")).otherwise(0.0).alias("lexical"))  # one row
    rows = docs.join(relative, "commit_hash", "left").na.fill(0.0, ["lexical", "existing"])
    if semantic is not None:
        rows = rows.join(semantic.select("commit_hash", F.greatest(F.lit(0.0), F.col("similarity")).alias("semantic_s")), "commit_hash", "left").na.fill(0.0, ["semantic_s"])
    else:
        rows = rows.withColumn("semantic_s", F.lit(0.0))
    wanted = sorted(set(anchors))
    anchored = F.array_intersect("files", F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"))
    terms = query_terms_of(task)
    said = F.array_intersect(query_terms(F.col("message")), F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"))
    rows = rows.withColumn("anchor_overlap", anchored).withColumn("message_overlap", said)
    rows = rows.withColumn("anchor", F.least(F.lit(1.0), F.size("anchor_overlap") / F.lit(float(max(1, len(wanted))))))
    score = F.col("lexical") * LEXICAL + F.col("semantic_s") * SEMANTIC + F.col("anchor") * ANCHOR + recency(F.col("authored_at"), F.lit(as_of).cast("timestamp")) * RECENCY + F.col("existing") * EXISTING
    rows = rows.withColumn("score", F.least(F.lit(1.0), score))
    strong = (F.size("message_overlap") > 0) | ((F.col("semantic_s") >= STRONG_SEMANTIC) & (F.size("anchor_overlap") > 0))
    out = rows.where((F.col("score") >= least) & strong).select("commit_hash", "message", "authored_at", "lexical", F.col("semantic_s").alias("semantic"), "anchor", "score", "message_overlap", "anchor_overlap", "existing", F.col("files").alias("changed_files"))
    return out if limit is None else out.orderBy(F.desc(F.round("score", 9)), F.desc("authored_at"), "commit_hash").limit(limit)


def candidates(commits: DataFrame, units: DataFrame, seq: int = 0) -> DataFrame:
    """Signals of the file units that found commits (``commit_hash, score, changed_files``) changed: the commit's score is the file's.

    ``commits`` is the bounded result of a search; the newest of equal ones isn't told apart.
    """
    touched = commits.select("commit_hash", "score", F.explode("changed_files").alias("path"))
    files = units.where("node_type = 'file'").select("path", "unit_id").dropDuplicates(["path"])
    hit = files.join(touched, "path")
    return signals(hit, "git_history", "score", reason=F.concat(F.lit("changed in commit "), F.substring("commit_hash", 1, 10)), seq=seq)
