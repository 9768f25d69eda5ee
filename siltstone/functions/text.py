"""Text kernel: query terms, token estimates, paths, names - all native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no query terms.
STOP_WORDS = (
    "about after also and are because before but can could does file fix for from has have into issue not should that the "
    "their then this through when where which with"
).split()
#: Fixed value: what a query term looks like.
TERM = r"[A-Za-z_][A-Za-z0-9_]{1,}|[0-9]{2,}"


def query_terms(text: Column, limit: int = 24) -> Column:
    """The first ``limit`` distinct lower-cased terms of a text, without stop words, in order; empty for null."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~t.isin(STOP_WORDS))), 1, limit)


def query_terms_of(text: str, limit: int = 24) -> list[str]:
    """:func:`query_terms` of one driver-side string."""
    found = (t.lower() for t in re.findall(TERM, text or ""))
    return list(dict.fromkeys(t for t in found if t not in STOP_WORDS))[:limit]


def token_estimate(text: Column) -> Column:
    """A token per four characters, rounded up, at least one (code points)."""
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the union of two arrays' sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def line_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Number of lines that two inclusive ranges share."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1)


def path_terms(path: Column) -> Column:
    """Lower-cased parts of a path, split at dots and underscores, longer than two characters."""
    parts = F.split(F.translate(F.lower(path), "./", "__"), "_")
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) > 2))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path; a package's ``__init__`` names the package."""
    dotted = F.translate(F.regexp_replace(path, r"\.pyi?$", ""), "/", ".")
    name = F.regexp_replace(dotted, r"\.__init__$", "")
    return F.when(name == "", F.lit("__init__")).otherwise(name)


def is_test(path: Column, name: Column) -> Column:
    """Whether a path part is ``test`` or ``tests``, or the file or the name starts with ``test_``."""
    parts = F.split(path, "/")
    return (
        F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests")))
        | F.substring_index(path, "/", -1).startswith("test_")
        | name.startswith("test_")
    )


def directories(path: Column) -> Column:
    """All ancestor directories of a path, outermost first."""
    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def parent_directory(path: Column) -> Column:
    """The directory of a path, ``.`` at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def clean_reference(text: Column) -> Column:
    """A reference as one word of at most 180 characters without quotes and brackets around it, else null."""
    bare = F.regexp_replace(F.trim(text), r"^['\"`<>()\[\]{}]+|['\"`<>()\[\]{}]+$", "")
    plain = F.trim(F.regexp_replace(bare, r"[^A-Za-z0-9_.$:/@#-]+", " "))
    return F.when((plain != "") & (F.length(plain) <= 180) & ~plain.contains(" "), plain)


def first_line_signature(text: Column) -> Column:
    """The first line without a trailing brace, at most 500 characters."""
    return F.substring(F.rtrim(F.regexp_replace(F.substring_index(F.trim(text), "\n", 1), r"\s*\{\s*$", "")), 1, 500)


def normal_reference(text: Column) -> Column:
    """Comparable form of a reference: quotes, dots and slashes off the ends, dotted, lower case."""
    return F.lower(F.translate(F.regexp_replace(F.trim(text), r"^['\"`./]+|['\"`./]+$", ""), "/", "."))


def external_id(relation: Column, reference: Column) -> Column:
    return F.concat(F.lit("external:"), relation, F.lit(":"), F.translate(normal_reference(reference), " ", "-"))


def recency(authored_at: Column, as_of: Column) -> Column:
    """1 / (1 + age in years), the age not below 0, as of a given time."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(authored_at)) / F.lit(86_400_000_000.0))
    return 1.0 / (1.0 + days / 365.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0; null where lengths differ."""
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = add(F.zip_with(double(a), double(b), lambda x, y: x * y))
    norm = F.sqrt(add(F.transform(double(a), lambda v: v * v))) * F.sqrt(add(F.transform(double(b), lambda v: v * v)))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot / norm).otherwise(F.lit(0.0)))


def render_cost(qualname: Column, path: Column, start: Column, end: Column, score: Column, sources: Column, reasons: Column,
                language: Column, content: Column) -> Column:
    """Estimated tokens of an evidence block: a header of fixed shape plus the content."""
    header = F.concat(
        F.lit("### "), qualname, F.lit("\n"), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\nscore "),
        F.format_string("%.3f", score), F.lit("; sources "), F.array_join(sources, ", "), F.lit("\n"),
        F.array_join(F.slice(reasons, 1, 3), " "), F.lit("\n```"), F.coalesce(language, F.lit("")), F.lit("\n\n```\n"),
    )
    return token_estimate(header) + token_estimate(content)
