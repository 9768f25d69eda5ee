from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import docpairs as D
from siltstone.llm import leak, mixture, quality, rules, split

# -- splitting ----------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n\t{}", min_size=0, max_size=900), st.integers(30, 120), st.integers(0, 12))
def test_pieces_cover_overlap_and_keep_the_limit(text, limit, overlap):
    spans = split.bisect(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in spans) or not text
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, e), (a, b) in zip(spans, spans[1:]):
        assert e - a == overlap and b > e
    assert (len(spans) == 1) == (len(text) <= limit)
    joined = text[spans[0][0] : spans[0][1]] + "".join(text[e:b] for (_, e), (_, b) in zip(spans, spans[1:]))
    assert joined == text


def test_cuts_between_lines_outside_the_middle_half():
    text = "a a\n" * 10 + "b " * 180 + "\n" + "c c\n" * 10  # the long line covers the middle half
    spans = split.bisect(text, 400, 0)
    assert len(spans) > 1 and all(text[b - 1] == "\n" for _, b in spans)


def test_cuts_at_strong_boundaries():
    text = "def a():\n" + "    x = 1\n" * 8 + "\n" + "def b():\n" + "    y = 2\n" * 8
    (_, cut), _ = split.bisect(text, len(text) - 5, 0)
    assert text[cut:].startswith("def b")
    with pytest.raises(ValueError):
        split.bisect("x", 10, 5)


def test_split_operator(spark):
    long = "\n".join(f"line {i} " + "é" * 20 for i in range(300))
    crlf = "\r\n".join("word" for _ in range(1500))
    solid = "x" * 9001
    rows = [("a", 11, long), ("a", 11, long), ("b", None, crlf), ("c", 1, solid), ("edge", 1, "y" * 4000), ("over", 1, "z" * 4001), ("none", 1, None), (None, 1, solid)]
    df = spark.createDataFrame(rows, "unit_id string, start_line int, content string").withColumn("begin", F.lit(7)).withColumn("text", F.lit("clash"))
    got = split.split_oversized(df, 4000, 200).collect()
    by = {}
    for r in got:
        by.setdefault(r.unit_id, []).append(r)
    assert set(by) == {"a", "b", "c", "over"}
    for unit, text, first in (("a", long, 11), ("b", crlf, 1), ("c", solid, 1)):
        parts = sorted(by[unit], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(1, parts[0].pieces + 1))
        for p in parts:
            assert p.text == text[p.begin : p.end] and len(p.text) <= 4000
            assert p.start_line == first + text.count("\n", 0, p.begin) and p.end_line == first + text.count("\n", 0, p.end - 1)
    assert all(a.end - b.begin == 200 for a, b in zip(by["a"], by["a"][1:]) if b.piece == a.piece + 1)
    assert split.split_oversized(df.where("false")).count() == 0


# -- leaks --------------------------------------------------------------------


def grams(text, k=13):
    w = [x for x in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)]
    tasks = [(f"t{i}", " ".join(rng.choice(vocabulary, rng.integers(5, 40)))) for i in range(30)] + [("dup", None), (None, "x")]
    docs = []
    for i in range(120):
        words = list(rng.choice(vocabulary + ["the", "é"], rng.integers(0, 60)))
        if i % 3 == 0:
            t = tasks[i % 30][1].split()
            cut = t[int(rng.integers(0, 5)) :][: int(rng.integers(8, 30))]
            words += [x.upper() if j % 2 else f"`{x}`" for j, x in enumerate(cut)] + words[:3]
        docs.append((i, ("\n" if i % 2 else " — ").join(words) if i % 17 else None))
    docs.append((5, docs[5][1]))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("task_id", F.lit("clash"))
    t = spark.createDataFrame(tasks, "id string, task string")
    want = {(i, n) for i, x in docs if x for n, y in tasks if y and n and grams(x) & grams(y)}
    found = leak.find_leaks(d, t).collect()
    assert {(r.doc_id, r.task_id) for r in found} == want and want
    text = dict(docs)
    for r in found:
        assert len(leak.words(text[r.doc_id][r.begin : r.end])) >= 13 and text[r.doc_id][r.begin].isalnum()
    assert leak.find_leaks(d.where("false"), t).count() == 0 and leak.find_leaks(d, t.where("false")).count() == 0
    assert leak.leaked_tests(leak.find_leaks(d, t)).count() == len({n for _, n in want})
    with pytest.raises(ValueError):
        leak.find_leaks(d, t, max_tests=3)


# -- documentation ------------------------------------------------------------


@pytest.mark.parametrize("doc, name, says", [
    ("Turn a raw line into a tuple.", "parse_line", True), ("TODO", "f", False), ("todo: write this", "f", False), ("Parse line.", "parse_line", False), ("Parses the lines", "parseLine", False), ("This is the parse line function.", "parse_line", False),
    ("See base class.", "f", False), ("{@inheritDoc}", "f", False), ("noqa: D102", "f", False), ("nolint:gocyclo", "f", False), ("eslint-disable-next-line", "f", False), ("-----", "f", False), ("...", "f", False), ("N/A", "f", False), ("", "f", False), (None, "f", False),
    ("Add description.", "f", False), ("Not documented yet.", "f", False), ("Auto-generated method stub.", "f", False), ("Docstring goes here.", "f", False), ("Drop what appears twice. TODO: open ends", "f", True),
    ("Args:\n    limit:\n    owner:", "f", False), ("Parameters\n----------\nlimit : int", "f", False), (":param limit:\n:returns:", "f", False), ("@param limit\n@return", "f", False), ("@param limit most entries that are kept", "f", True), ("Liest die Datei zeilenweise ein.", "read_file", True), ("xxx", "f", False),
    ("<p>Sorts <b>candidates</b>.</p>", "rank", True),
])
def test_what_describes(doc, name, says):
    assert D.describes(doc, name, frozenset({"limit", "owner"})) is says


def test_pairs_from_units(spark):
    long = "// Keep the newest entries.\nfunc Keep(n int) int {\n" + "    x = n\n" * 50_000 + "}\n"
    rows = [
        ("py", "function", "f", "r/a.py", None, '@d\nasync def f(a: dict[str, int] = {"x": 1}) -> int:\n    # note\n    """Count the entries."""\n    return 1\n'),
        ("stub", "method", "g", "r/a.py", "", 'def g(self):\n    """TODO"""\n'),
        ("column", "test", "h", "r/a.py", "Check that both sides agree.", "def h():\n    pass\n"),
        ("nested", "function", "outer", "r/a.py", "", 'def outer():\n    def inner():\n        """Not of outer, though it says much."""\n'),
        ("fstring", "function", "k", "r/a.py", "", 'def k():\n    f"""Not a docstring."""\n'),
        ("go", "function", "Keep", "r/a.go", "", long),
        ("far", "function", "Far", "r/a.go", "", "// Far away from it.\n\nfunc Far() {}\n"),
        ("ts", "method", "load", "r/a.ts", None, "/**\n * Load what the cache lacks.\n * @param x\n */\n@log({a: 1})\nload(x: number): void {}"),
        ("rs", "function", "run", "r/a.rs", None, "/// run\n#[inline]\npub fn run() {}"),
        ("java", "method", "m", "r/A.java", None, "// noqa\n@Override\npublic int m() { return 1; }"),
        ("class", "class", "C", "r/a.py", None, 'class C:\n    """Holds everything that is known."""\n'), ("null", "function", "n", "r/a.py", "Says something useful.", None), (None, "function", "n", "r/a.py", None, "def n(): pass"),
        ("noname", "function", None, "r/a.py", None, 'def z():\n    """Close the oldest file."""\n'),
    ]
    df = spark.createDataFrame(rows, "unit_id string, node_type string, name string, path string, docstring string, content string").withColumn("documentation", F.lit("clash"))
    got = {r.unit_id: r for r in D.documented_units(df.unionByName(df.where("unit_id = 'py'"))).collect()}
    assert set(got) == {"py", "column", "go", "ts", "noname"}
    assert got["py"].documentation == "Count the entries." and got["py"].signature.startswith("async def f(") and got["go"].signature == "func Keep(n int) int"
    assert D.documented_units(df.where("false")).count() == 0


def test_islands_of_files():
    ts = "/** Loads it all. */\nexport async function load(x: number): Promise<void> { if (x) { y() } }\nclass A {\n  // Saves it.\n  save() { const s = '}'; }\n}\n"
    got = [(n, d.strip(), ts[a:b]) for n, d, _, a, b in D.islands(ts, "typescript")]
    assert [(n, d) for n, d, _ in got] == [("load", "Loads it all."), ("save", "Saves it.")] and got[1][2].endswith("'}'; }")
    py = 'x = "def no():"\nclass A:\n    def m(self):\n        """Inner text."""\n        return (1,\n2)\n\n    async def n(self): pass\n'
    assert [(n, d) for n, d, *_ in D.islands(py, "python")] == [("m", "Inner text."), ("n", "")]
    go = "package a\n\n// Does it.\nfunc (r *T) Do(f func() int) (int, error) {\n\treturn 1, nil\n}\n"
    assert [(n, d) for n, d, *_ in D.islands(go, "go")] == [("Do", "Does it.")]
    rust = "impl A {\n    /// Runs it.\n    #[inline]\n    pub fn run<T>(&self) -> u8 { match x { _ => { 1 } } }\n}\n"
    assert [(n, d) for n, d, *_ in D.islands(rust, "rust")] == [("run", "Runs it.")]
    java = "class A {\n    /** Adds. */\n    @Override\n    public int add(int a) throws E { for (;;) { } }\n}\n"
    assert [(n, d.strip()) for n, d, *_ in D.islands(java, "java")] == [("add", "Adds.")]


def test_islands_without_bodies_and_bound_expressions():
    names = lambda text, language: [(n, d) for n, d, *_ in D.islands(text, language)]
    assert names("interface A {\n    /** Counts. */\n    int size();\n    // Adds.\n    void add(int a);\n}\n", "java") == [("size", "Counts."), ("add", "Adds.")]
    assert names("class A { void m() { /* no */ call(1); } }", "java") == [("m", "")]
    assert names("trait A {\n    /// Runs.\n    fn run(&self);\n}\n", "rust") == [("run", "Runs.")]
    assert names("type A interface {\n\t// Reads.\n\tRead(p []byte) (int, error)\n}\n", "go") == [("Read", "Reads.")]
    assert names("/** One. */\nfunction f(a: string): void;\nfunction f(a: any) { }\nabstract class B { abstract g(): void; }\n", "typescript") == [("f", "One."), ("f", ""), ("g", "")]
    assert names("// Doubles.\nconst twice = (x) => {\n  return 2 * x;\n};\n// Halves.\nexport const half = async x => x / 2;\nvar g = function (y) { };\nfoo(1);\n", "javascript") == [("twice", "Doubles."), ("half", "Halves."), ("g", "")]
    assert names("// Cut off.\nfunc Cut(a int) {\n\tx := 1\n", "go") == [("Cut", "Cut off.")]


# -- mixtures -----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=7), st.integers(5, 300))
def test_pfair_keeps_every_source_within_a_block(parts, slots):
    whole = sum(parts)
    weights = {f"s{i}": Fraction(p, whole) for i, p in enumerate(parts)}
    blocks = {s: -(-(w * slots).numerator // (w * slots).denominator) for s, w in weights.items()}
    order = mixture.pfair(weights, blocks)
    assert sorted(order) == sorted((s, j) for s, n in blocks.items() for j in range(n))
    done = dict.fromkeys(weights, 0)
    for t, (s, j) in enumerate(order[:slots], 1):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - w * t) < 1 for x, w in weights.items())


def test_mixture_shares_caps_and_dirt(spark):
    rng = np.random.default_rng(0)
    docs = [(i, "word " * int(rng.integers(1, 60)), ["Big", " BIG ", "big"][i % 3]) for i in range(900)] + [(1000 + i, "a small text here " * 5, "sm-all") for i in range(60)] + [(2000, None, "big"), (2001, "", "big"), (2002, "lost text", None), (2003, "other", "unknown")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string, source string").withColumn("position", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("sm_all", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    counted = mixture.document_tokens(df).cache()
    per = {r.doc_id: r.n_tokens for r in counted.collect()}
    rows = mixture.mix(df, targets, tokens=counted).collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and all(per[r.doc_id] == r.n_tokens for r in rows)
    assert max(r.copy for r in rows if r.source == "big") == 0 and max(r.copy for r in rows if r.source == "sm_all") <= 2
    total = sum(r.n_tokens for r in rows)
    for s, share in (("big", 5 / 9), ("sm_all", 4 / 9)):
        assert abs(sum(r.n_tokens for r in rows if r.source == s) - share * total) <= 2 * max(per.values())
    table = {r.source: r for r in mixture.shares(df, targets).collect()}
    assert table["absent"].tokens == 0 and table["big"].actual_share == pytest.approx(5 / 9, abs=0.02)
    limited = mixture.mix(df, targets, total=1000, tokens=counted)
    assert limited.agg(F.sum("n_tokens")).first()[0] == pytest.approx(1000, abs=200)
    assert mixture.mix(df.where("false"), targets).count() == 0 and mixture.mix(df, targets.where("false"), tokens=counted).count() == 0


# -- quality ------------------------------------------------------------------


def test_rules_are_found_and_hold_out(spark):
    rng = np.random.default_rng(8)
    table = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    label = ((table["a"] > 0.6) & (table["b"] < 0.5)) | (table["a"] < 0.1)
    noisy = label ^ (rng.random(3000) < 0.03)
    part = lambda x, i: {k: v[i] for k, v in x.items()}
    got = rules.induce(part(table, slice(0, 2000)), noisy[:2000])
    assert (rules.classify(got, part(table, slice(2000, None))) == label[2000:]).mean() > 0.95
    sql = rules.to_case(got)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(table["a"][2000:2200], table["b"][2000:2200])], "a double, b double").withColumn("noise", F.lit(0.5))
    if "noise" not in sql:
        assert [r[0] for r in df.select(F.expr(sql)).collect()] == [int(x) for x in rules.classify(got, part(table, slice(2000, 2200)))]
    assert rules.to_case([]) == "0" and rules.induce({"a": np.zeros(4)}, np.zeros(4, bool)) == []


PROSE = ["The cache keeps what was read before, and it lets the oldest entry go when a new one arrives.", "We looked at this again and found that most of the time was spent on the lock, which is why it is gone now.", "Wenn die Datei leer ist, bricht die Suche sofort ab und meldet einen Fehler, der nicht mehr verschwindet."]
OTHER = ["def f(x):\n    return x + 1\n\nclass A:\n    pass", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "2024-01-01T00:00:00Z INFO a[1] b=2\n2024-01-01T00:00:01Z INFO a[2] b=3", "path,lines\na.py,3\nb.py,4", "- merge old queue\n- fold new index", "qX9a7d+/Zz81kLmP0q" * 9]


def test_prose_and_the_rest(spark):
    rng = np.random.default_rng(3)
    docs, want = [], set()
    for i in range(240):
        n = int(rng.integers(1, 5))
        prose = [PROSE[int(k)] for k in rng.integers(0, 3, n)]
        if i % 2:
            docs.append((i, "\n\n".join(["# Title", *prose])))
        else:
            docs.append((i, "\n\n".join([OTHER[int(k)] for k in rng.integers(0, 6, 12)] + prose[: i % 4 // 2])))
            want.add(i)
    docs += [(900, None), (901, ""), (902, " \n\t"), (903, "word " * 30_000), (5, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("chars", F.lit("clash")).withColumn("block", F.lit(1))
    got = {r.doc_id for r in quality.not_prose(df).collect()}
    assert len(got ^ want - {903}) <= 6 and not got & {900, 901, 902}
    assert quality.not_prose(df.where("false")).count() == 0
    s = {r.doc_id: r for r in quality.statistics(df).collect()}
    assert s[901].words == 0 and 900 not in s and s[903].words == 30_000 and s[903].mean_word_length == 4.0
    assert s[1].common_word_share > 0.3


def test_rules_on_paragraphs_held_out(spark):
    rows = quality.labelled(spark).cache()
    learned = quality.learn(rows.where("doc_id % 4 <> 0"))
    held = quality.features(rows.where("doc_id % 4 = 0")).select("sentences", *quality.FEATURES).toPandas()
    assert len(held) > 100 and (rules.classify(learned, {k: held[k].to_numpy(float) for k in quality.FEATURES}) == held["sentences"]).mean() >= 0.95
    assert quality.learn(rows.where("false")) == []
