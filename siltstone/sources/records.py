"""Task files, manifests, graph files, Git logs and configuration."""

from __future__ import annotations

import dataclasses
import os
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.history import FIELD, RECORD, parse_log, scope

TASK = "id string, repository string, task string, gold_files array<string>, gold_symbols array<string>, gold_line_ranges array<struct<file:string,start_line:int,end_line:int>>, metadata map<string,string>"
PATCH = "id string, repository_url string, base_commit string, fix_commit string, task string, gold_files array<string>, pull_request int"
NODE_TYPES = ("repository", "directory", "file", "module", "class", "function", "method", "test", "commit")


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a broken line raises with its number."""
    text = spark.read.text(path).where(F.trim("value") != "")
    rows = text.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNull().alias("broken"))
    first = rows.where("broken").select("value").first()
    if first is not None:
        with_number = spark.read.text(path, wholetext=True).first()[0].splitlines()
        raise ValueError(f"line {with_number.index(first[0]) + 1 if first[0] in with_number else '?'} is no JSON: {first[0][:80]}")
    out = rows.select("r.*")
    if out.isEmpty():
        raise ValueError(f"no records in {path}")
    return out


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation tasks, one JSON object a line."""
    return _json_lines(spark, path, TASK)


def patch_problems(rows: DataFrame) -> DataFrame:
    """``(id, problem)`` of manifest rows: repeated ids, other URLs than https ``.git``, hashes that aren't 40 hex digits, files that aren't relative Python paths."""
    checks = {
        "repository_url": ~F.col("repository_url").rlike(r"^https://[^/]+/[^/]+/[^/]+\.git$"),
        "base_commit": ~F.col("base_commit").rlike("^[0-9a-f]{40}$"),
        "fix_commit": ~F.col("fix_commit").rlike("^[0-9a-f]{40}$"),
        "gold_files": (F.size("gold_files") < 1) | F.exists("gold_files", lambda p: ~p.rlike(r"^(?!/)(?!.*(?:^|/)\.\.(?:/|$)).+\.py$")),
    }
    flags = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()))
    broken = rows.select("id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("problem"))
    twice = rows.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    return broken.unionByName(twice)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of historical patches; any problem raises."""
    rows = _json_lines(spark, path, PATCH)
    bad = patch_problems(rows).orderBy("id", "problem").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.id}: {r.problem}" for r in bad))
    return rows


def read_graph(spark: SparkSession, path: str, most_bytes: int = 100_000_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file of schema version 1; unknown ends of edges raise."""
    if not path.endswith(".json"):
        raise ValueError("a graph file ends in .json")
    if os.path.getsize(path) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes")
    node = "struct<id:string,label:string,kind:string,source_file:string,source_location:string,language:string,qualname:string,signature:string,start_line:int,end_line:int,community:int>"
    edge = "struct<source:string,target:string,key:string,relation:string,confidence:string,source_location:string,target_ref:string,weight:double>"
    doc = spark.read.schema(f"schema_version int, nodes array<{node}>, edges array<{edge}>").option("multiLine", "true").json(path)
    head = doc.select("schema_version", F.col("nodes").isNull().alias("n"), F.col("edges").isNull().alias("e")).first()
    if head is None or head.schema_version != 1 or head.n or head.e:
        raise ValueError("not a graph file of schema version 1 with nodes and edges")
    nodes, edges = doc.select(F.explode("nodes").alias("r")).select("r.*"), doc.select(F.explode("edges").alias("r")).select("r.*")
    ids = nodes.select("id")
    for end in ("source", "target"):
        if not edges.join(ids.withColumnRenamed("id", end), end, "left_anti").isEmpty():
            raise ValueError("an edge has an unknown node")
    return nodes, edges


def git_log(spark: SparkSession, repository: str, *, max_commits: int = 500, timeout: int = 30) -> DataFrame | None:
    """Commits of a work tree (:func:`siltstone.operators.history.parse_log`), restricted to its folder; None if it is none."""
    def git(*args, at=repository):
        return subprocess.run(["git", "-C", at, *args], check=True, capture_output=True, text=True, encoding="utf-8", errors="replace", timeout=timeout).stdout

    try:
        root = git("rev-parse", "--show-toplevel").strip()
        folder = Path(repository).resolve().relative_to(Path(root).resolve()).as_posix()
        out = git("log", "--no-merges", f"--max-count={max_commits}", f"--format={RECORD}%H{FIELD}%aI{FIELD}%an{FIELD}%s", "--numstat", "--", folder, at=root)
    except (OSError, ValueError, subprocess.SubprocessError):
        return None
    records = [(r,) for r in out.split(RECORD) if r.strip()]
    return scope(parse_log(spark.createDataFrame(records, "value string")), folder)


@dataclasses.dataclass(frozen=True)
class Settings:
    """Engine settings; the environment overrides the file."""

    folder: str = ".siltstone"
    max_file_bytes: int = 2_000_000
    graph_max_depth: int = 2
    graph_max_nodes: int = 40
    semantic_dimensions: int = 384
    embedding_provider: str = "local"

    #: Allowed ranges.
    RANGES = {"max_file_bytes": (1, None), "graph_max_depth": (0, 5), "graph_max_nodes": (1, 500), "semantic_dimensions": (32, 4096)}

    def __post_init__(self):
        for name, (low, high) in self.RANGES.items():
            v = getattr(self, name)
            if not isinstance(v, int) or v < low or high is not None and v > high:
                raise ValueError(f"{name} must be an integer from {low}" + (f" to {high}" if high else ""))

    @classmethod
    def load(cls, root: str, environ=os.environ) -> Settings:
        """Settings of ``siltstone.toml`` (or its [siltstone] table), then SILTSTONE_* variables; unknown keys raise."""
        values, path = {}, Path(root, "siltstone.toml")
        if path.is_file():
            doc = tomllib.loads(path.read_text("utf-8"))
            values = dict(doc.get("siltstone", doc))
        fields = {f.name: f.type for f in dataclasses.fields(cls)}
        unknown = values.keys() - fields.keys()
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        for name in fields:
            v = environ.get("SILTSTONE_" + name.upper())
            if v:
                try:
                    values[name] = int(v) if name in cls.RANGES else v
                except ValueError:
                    raise ValueError(f"SILTSTONE_{name.upper()} must be an integer") from None
        return cls(**values)
