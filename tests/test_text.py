import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import fuzzy as Z
from siltstone.functions import text as T
from siltstone.functions.hashing import HashEmbedder
from siltstone.operators import lexical as X
from siltstone.operators import symbols


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_query_terms_keep_first_occurrences_and_drop_stop_words(spark):
    text = "Fix the Router: router_table and HTTP 404, a b 7 not found; Router again"
    got = one(spark, T.query_terms(F.col("t")), t=text)
    assert got == ["router", "router_table", "http", "404", "found", "again"]
    assert T.query_terms_of(text) == got
    assert one(spark, T.query_terms(F.col("t"), 2), t=text) == got[:2]
    assert one(spark, T.query_terms(F.col("t")), t=None) == []


def test_small_column_functions(spark):
    assert one(spark, T.token_estimate(F.col("t")), t="") == 1
    assert one(spark, T.token_estimate(F.col("t")), t="abcde") == 2
    assert one(spark, T.token_estimate(F.col("t")), t="\U0001f600" * 8) == 2
    assert one(spark, T.module_name(F.col("p")), p="a/b/__init__.py") == "a.b"
    assert one(spark, T.module_name(F.col("p")), p="a/c.pyi") == "a.c"
    assert one(spark, T.module_name(F.col("p")), p="__init__.py") == "__init__"
    assert one(spark, T.is_test(F.col("p"), F.col("n")), p="a/tests/x.py", n="x") is True
    assert one(spark, T.is_test(F.col("p"), F.col("n")), p="a/latest/x.py", n="x") is False
    assert one(spark, T.directories(F.col("p")), p="a/b/c.py") == ["a", "a/b"]
    assert one(spark, T.directories(F.col("p")), p="c.py") == []
    assert one(spark, T.parent_directory(F.col("p")), p="c.py") == "."
    assert one(spark, T.path_terms(F.col("p")), p="src/my_loader.py") == ["src", "loader"]
    assert one(spark, T.clean_reference(F.col("t")), t=" 'pkg.mod' ") == "pkg.mod"
    assert one(spark, T.clean_reference(F.col("t")), t="two words") is None
    assert one(spark, T.first_line_signature(F.col("t")), t="fn f(x) {\n  y\n}") == "fn f(x)"
    assert one(spark, T.external_id(F.lit("imports"), F.col("t")), t="./Pkg/Mod") == "external:imports:pkg.mod"


def test_porter_stems():
    for word, stem in dict(caresses="caress", ponies="poni", agreed="agre", hopping="hop", relational="relat", triplicate="triplic", mounted="mount", mounting="mount", oscillators="oscil").items():
        assert Z.porter_stem(word) == stem


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=9), st.text("ab c", max_size=14))
def test_partial_similarity_is_the_best_window(a, b):
    short, long = sorted((a, b), key=len)
    want = 0.0 if not short else 100.0 if short in long else max(Z._indel(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))
    assert Z._partial(a, b) == pytest.approx(want)
    assert 0 <= Z.weighted_ratio(a, b) <= 100


def test_hash_embeddings_are_unit_vectors_and_keep_overlap():
    e = HashEmbedder(64)
    a, b, c = (e.embed(t) for t in ("load the router table", "load the router index", "zebra quartz"))
    assert (a @ a) == pytest.approx(1) and (a @ b) > (a @ c)
    assert not e.embed("").any()
    with pytest.raises(ValueError):
        HashEmbedder(8)


DOCS = [
    ("a", "src/join_path.py", "join_path", "app.join_path", "def join_path(x)", "Join parts", "return join_path(x) mounted mounted"),
    ("b", "src/router.py", "Mount", "app.Mount", "class Mount", None, "a path that is not a join but mounting a path"),
    ("c", "docs/join.md", "join", "join", "", "", "join the path path join"),
    ("d", "x.py", "x", "x", "", "", ""),
    ("e", "y.py", "y", "y", "", "", "nothing here at all"),
]
COLUMNS = ["unit_id", "path", "name", "qualname", "signature", "docstring", "content"]


@pytest.mark.parametrize("query", ["join_path", "mounted path", "path", "missing_word"])
@pytest.mark.parametrize("stem", [True, False])
def test_bm25_agrees_with_a_full_text_index(spark, query, stem):
    """The same scores as an FTS5 table with the same fields, weights and tokenizer."""
    db = sqlite3.connect(":memory:")
    fields = COLUMNS[1:]
    db.execute(f"create virtual table t using fts5(unit_id unindexed, {', '.join(fields)}, tokenize='{'porter ' if stem else ''}unicode61')")
    db.executemany(f"insert into t values ({','.join('?' * 7)})", DOCS)
    match = " OR ".join(f'"{t}"' for t in T.query_terms_of(query))
    weights = ", ".join(str(X.UNIT_FIELDS[f]) for f in fields)
    want = dict(db.execute(f"select unit_id, -bm25(t, 0.0, {weights}) from t where t match ?", (match,)).fetchall())
    docs = spark.createDataFrame(DOCS, ", ".join(f"{c} string" for c in COLUMNS))
    got = {r.unit_id: r.bm25 for r in X.bm25_scan(docs, "unit_id", X.UNIT_FIELDS, query, stem=stem).collect()}
    assert got == pytest.approx(want)
    posted = X.bm25_postings(X.build_postings(docs, "unit_id", X.UNIT_FIELDS, stem=stem), X.UNIT_FIELDS, query, stem=stem, docs=docs.withColumnRenamed("unit_id", "doc"))
    assert {r.doc: r.bm25 for r in posted.collect()} == pytest.approx(want)


def test_search_leaves_out_modules_and_finds_nothing_without_terms(spark):
    units = spark.createDataFrame([(*d, 1, "module" if d[0] == "a" else "function") for d in DOCS], ", ".join(f"{c} string" for c in COLUMNS) + ", start_line int, node_type string")
    rows = X.search(units, "join path", limit=5).collect()
    assert {r.unit_id for r in rows} == {"b", "c"} and rows[0].score == 1.0 and rows[0].matched_terms == ["join", "path"]
    assert X.search(units, "join_path", limit=5).count() == 0  # a phrase, which only the module has
    assert X.search(units, "the a", limit=5).count() == 0


def test_symbol_ladder(spark):
    rows = [("1", "function", "p", "resolve", "app.Mount.resolve", 1), ("2", "method", "p", "resolver", "app.resolver", 2), ("3", "class", "p", "Thing", "resolve.Thing", 3), ("4", "test", "p", "zzz", "q.zzz", 4), ("5", "file", "p", "resolve", "resolve", 5)]
    units = spark.createDataFrame(rows, "unit_id string, node_type string, path string, name string, qualname string, start_line int")
    got = {r.unit_id: r.score for r in symbols.search(units, "resolve table", fuzzy=False).collect()}
    assert got == {"1": 0.98, "2": 0.82, "3": 0.68}
    assert symbols.search(units, "Mount.resolve", fuzzy=False).first().score == 1.0
    fuzzy = {r.unit_id: r.score for r in symbols.search(units, "resolwe").collect()}
    assert fuzzy["1"] == pytest.approx(0.72 * Z.sequence_ratio("resolwe", "resolve")) and "4" not in fuzzy
    assert symbols.search(units, "", fuzzy=True).count() == 0
