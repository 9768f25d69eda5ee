"""Source files that do not parse: flags per file, rates per repository and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import languages

_SCHEMA = "path string, language string, error_line int, accepted array<string>"


def _language_of(path):
    """Language of a path's extension (lower-cased); null if no grammar has it."""
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in languages.EXTENSIONS.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def _recogniser(dialects: dict):
    def recognise(batches):
        import pyarrow as pa

        for batch in batches:
            paths, names, texts = (batch.column(i) for i in range(3))
            got = [languages.accepting(t.as_py(), dialects.get(n.as_py(), n.as_py())) for n, t in zip(names, texts)]
            lines, accepted = pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([paths, names, lines, accepted], ["path", "language", "error_line", "accepted"])

    return recognise


#: Language -> its name with dialects that aren't standard, for whom they are wanted.
JAVA_LISTS = {"java": "java+lists"}


def parse_files(files: DataFrame, path: str = "path", content: str = "content", *, dialects: dict | None = None) -> DataFrame:
    """``(path, language, parse_error, error_line, accepted)``, one row per path with a supported extension.

    Every content is recognised by the generalised LL machine of its extension's
    language, all dialect grammars in one pass; ``parse_error`` is true if each
    of them rejects it, ``error_line`` the line of the first token no dialect
    accepts.  Null paths and null contents take no part; an empty Python,
    TypeScript or JavaScript text is valid, an empty JSON or Go one is not.
    Repeated rows count once; a path with several contents is in error if any
    of them is.  ``accepted`` names the dialects that derive it (Python 3.8 and 3.13, scripts and
    modules of JavaScript and TypeScript, and those that ``dialects`` adds).  Only recognised rows (no text) are shuffled.
    """
    rows = files.select(F.col(path).alias("path"), _language_of(F.col(path)).alias("language"), F.col(content).alias("content"))
    rows = rows.where("path is not null and language is not null and content is not null")
    seen = rows.select("path", "language", "content").mapInArrow(_recogniser(dialects or {}), _SCHEMA)
    return seen.groupBy("path", "language").agg(
        (F.count("error_line") > 0).alias("parse_error"), F.min("error_line").alias("error_line"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("accepted")))).alias("accepted"),  # at most a set of each dialect
    )


#: Words by which an earlier reading's message shows that it is about syntax.
SYNTAX_WORDS = r"(?i)syntax|unexpected|unterminated|never closed|error node|expected declaration|invalid"


def parse_rates(units: DataFrame, files: DataFrame, extractions: DataFrame, *, dialects: dict | None = None) -> DataFrame:
    """Per repository and language: files, files in error, their rate, and how many were reported before.

    ``reported`` counts files in error of which files.parse_error or
    extractions.parse_errors holds a message about syntax.  The repository is
    the first segment of the path.
    """
    found = parse_files(units.where("node_type = 'file'"), dialects=dialects)
    told = files.select("path", F.col("parse_error").alias("message")).where(F.col("message").rlike(SYNTAX_WORDS))
    told = told.unionByName(
        extractions.select("path", F.explode("parse_errors").alias("message")).where(F.col("message").rlike(SYNTAX_WORDS))
    )
    told = told.select("path").distinct().withColumn("told", F.lit(1))
    rows = found.join(told, "path", "left").withColumn("repository", F.substring_index("path", "/", 1))
    out = rows.groupBy("repository", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("parse_error").cast("long")).alias("errors"),
        F.sum(F.when(F.col("parse_error"), F.coalesce("told", F.lit(0))).otherwise(0)).alias("reported"),
    )
    return out.withColumn("rate", F.round(F.col("errors") / F.col("files"), 6))
