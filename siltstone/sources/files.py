"""Discovery of source files with ignore rules, and scans of them."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directories never read, and the size limit.
DEFAULT_EXCLUDES = (".git/", ".siltstone/", ".venv/", "venv/", "node_modules/", "dist/", "build/", "__pycache__/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/")
MOST_BYTES = 2_000_000
PYTHON = (".py", ".pyi")
#: Extensions of multi-language discovery and their languages.
LANGUAGES = {
    ".bash": "bash", ".c": "c", ".cc": "cpp", ".cjs": "javascript", ".cpp": "cpp", ".cs": "csharp", ".cxx": "cpp", ".ex": "elixir", ".exs": "elixir",
    ".f": "fortran", ".f03": "fortran", ".f08": "fortran", ".f90": "fortran", ".f95": "fortran", ".go": "go", ".groovy": "groovy", ".h": "c", ".hpp": "cpp",
    ".java": "java", ".jl": "julia", ".js": "javascript", ".json": "json", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".lua": "lua",
    ".m": "objective-c", ".mjs": "javascript", ".mm": "objective-c", ".php": "php", ".ps1": "powershell", ".psm1": "powershell", ".py": "python", ".pyi": "python",
    ".rb": "ruby", ".rs": "rust", ".scala": "scala", ".sh": "bash", ".swift": "swift", ".ts": "typescript", ".tsx": "tsx", ".v": "verilog", ".verilog": "verilog", ".zig": "zig",
}


class IgnoreRules:
    """Ordered ignore patterns of the usual kind; the last one that matches decides."""

    def __init__(self, patterns):
        self.rules = []
        for raw in patterns:
            line = raw.rstrip("\n")
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            self.rules.append((re.compile(self._regex(line.replace("\\#", "#").replace("\\!", "!"))), not keep))

    @staticmethod
    def _regex(pattern: str) -> str:
        directory = pattern.endswith("/")
        body = pattern.strip("/")
        anchored = pattern.startswith("/") or "/" in body
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
                out, i = out + "(?:[^/]+/)*", i + 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                out, i = out + "/.+", i + 3
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            elif body[i] == "[" and "]" in body[i + 2 :]:
                end = body.index("]", i + 2)
                inner = body[i + 1 : end]
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
            elif body[i] == "\\" and i + 1 < len(body):
                out, i = out + re.escape(body[i + 1]), i + 2
            else:
                out, i = out + re.escape(body[i]), i + 1
        return ("^" if anchored else "^(?:.*/)?") + out + ("/" if directory else "(?:/|$)")

    def ignored(self, path: str) -> bool:
        """Whether a file's path, relative to the root, is ignored."""
        out = False
        for rule, ignore in self.rules:
            if rule.match(path):
                out = ignore
        return out


def ignore_rules(lines=(), excludes=DEFAULT_EXCLUDES) -> IgnoreRules:
    """Default directories, then the lines of the ignore files."""
    return IgnoreRules([*excludes, *lines])


def discover(spark: SparkSession, root: str, *, extensions=PYTHON, excludes=DEFAULT_EXCLUDES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(path, content, size_bytes, mtime_ns, content_hash)`` of the source files below a folder.

    A distributed binary scan of any Hadoop file system: extension and size are
    filtered before contents are read; ignore rules run once per path in an
    Arrow UDF.  Links are left out where the file system is local.  The hash is
    that of the bytes; the text is UTF-8 with replacement characters.  The scan
    gives no rows for empty files; those are what its listing has beyond them.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(conf)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise NotADirectoryError(root)
    local = fs.getScheme() == "file"
    base = os.path.realpath(root) if local else fs.makeQualified(where).toString().rstrip("/")
    rules = ignore_rules(_ignore_lines(spark, fs, base), excludes)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))

    def relative(path):
        plain = F.regexp_replace(path, r"^file:/+", "/") if local else path
        return F.regexp_replace(F.url_decode(F.regexp_replace(plain, r"\+", "%2B")), "^" + re.escape(base) + "/", "")

    @F.pandas_udf("boolean")
    def wanted(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not rules.ignored(p) and not (local and os.path.islink(os.path.join(base, p))))

    rows = raw.where(suffix.isin(*extensions) & (F.col("length") <= most_bytes)).withColumn("relative", relative(F.col("path"))).where(wanted("relative"))
    full = rows.select(F.col("relative").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size_bytes"),
                       (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("content_hash"))
    listed = [p for p in raw.inputFiles() if os.path.splitext(p)[1].lower() in extensions]  # the scan's own listing
    if not listed:
        return full
    rest = spark.createDataFrame([(p,) for p in listed], "at string").withColumn("path", relative(F.col("at"))).where(wanted("path"))
    rest = rest.join(raw.select(relative(F.col("path")).alias("path")), "path", "left_anti").select("path")
    empty = rest.select("path", F.lit("").alias("content"), F.lit(0).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_ns"), F.sha2(F.lit(""), 256).alias("content_hash"))
    return full.unionByName(empty)


def _ignore_lines(spark: SparkSession, fs, base: str, names=(".gitignore", ".siltstoneignore")) -> list[str]:
    """Lines of the ignore files at the root: the common one, then the tool's own."""
    jvm, out = spark.sparkContext._jvm, []
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if fs.exists(at):  # Spark's own readers pass over names with a leading dot
            stream = fs.open(at)
            out += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
    return out


def discover_all(spark: SparkSession, root: str, **options) -> DataFrame:
    """:func:`discover` over all supported languages, with ``language``."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    rows = discover(spark, root, extensions=tuple(LANGUAGES), **options)
    return rows.withColumn("language", table[F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))])


def scan_units(units: DataFrame, node_types=None) -> DataFrame:
    """Units of the given types (pushed to the scan) by path, line, id."""
    rows = units.where(F.col("node_type").isin(*node_types)) if node_types else units
    return rows.orderBy("path", "start_line", "unit_id")


def get_unit(units: DataFrame, unit_id: str) -> DataFrame:
    return units.where(F.col("unit_id") == unit_id).limit(1)


def find_unit(units: DataFrame, identifier: str) -> DataFrame:
    """The unit that an identifier names: its id, else the first of that qualified name, else one of a unique name."""
    one = units.dropDuplicates(["unit_id"])
    a = one.where(F.col("unit_id") == identifier).withColumn("tier", F.lit(1))
    b = one.where(F.col("qualname") == identifier).withColumn("tier", F.lit(2))
    named = one.where(F.col("name") == identifier)
    c = named.join(F.broadcast(named.agg(F.count(F.lit(1)).alias("n"))), F.col("n") == 1).drop("n").withColumn("tier", F.lit(3))  # one row
    return a.unionByName(b).unionByName(c).orderBy("tier", "path", "start_line", "unit_id").limit(1).drop("tier")


#: Links of a node in one row of the adjacency table.
MOST_LINKS = 10_000


def adjacency(edges: DataFrame) -> DataFrame:
    """``(node_id, direction, part, links)``: each node's edges as arrays, most confident first.

    A row has at most :data:`MOST_LINKS` links; a hub has several parts, in order.
    """
    from siltstone.operators.graph import both_ways

    place = F.row_number().over(Window.partitionBy("at", "direction").orderBy(F.desc("confidence"), "to", "edge_type")) - 1
    rows = both_ways(edges).withColumn("place", place).groupBy(F.col("at").alias("node_id"), "direction", F.floor(F.col("place") / MOST_LINKS).cast("int").alias("part"))
    links = F.sort_array(F.collect_list(F.struct("place", "to", "edge_type", "confidence")))
    return rows.agg(F.transform(links, lambda x: F.struct(x["to"].alias("other_id"), x["edge_type"].alias("edge_type"), x["confidence"].alias("confidence"))).alias("links"))
