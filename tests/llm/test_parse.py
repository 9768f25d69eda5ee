import ast
import json
import random
import warnings

import pytest
from pyspark.sql import functions as F

from siltstone.llm import languages as L
from siltstone.llm import parse

VALID = {
    "python": [
        "", "x = 1\n", "def f(a, /, b=1, *, c, **k) -> int:\n    return a if b else c\n", "async def f():\n    async with a as b, c: pass\n    return [x async for x in y if x]\n",
        "match p:\n    case {'a': [1, *_], **rest} if rest: pass\n    case A.B(x=1) | None: pass\n", "match = case = type = 1\nmatch(x)\ntype X[T] = list[T]\n", "f'{a!r:>{w}} {b[\"c\"]} {{x}} {d=}'\n", "f'{f'{x}'}'\n",
        "x = (1,\n  # note\n  2)\nif x:\n\tpass\n", "try:\n  pass\nexcept* E as e:\n  pass\nelse: pass\nfinally: pass\n", "a: int = yield_ = 3\n" if False else "a: int = 3\n", "@d.e(1)\nclass A(B, m=C): x = y[1:2, ::3, ...]\n", "lambda *a, k=1: (yield)\n", "with (open(a) as b, c as d):\n    pass\n",
        "x = 0x_ff + 1_0.5e-3j\n", "'''a\n'''\r\nx = 1\\\n + 2\r\n", "def f[T: int, *U](x): ...\n", "print(*a, **b, c=1, d=(x for x in y))\n", "if x:\n    pass\n# last comment", "é = 'naïve'\n",
    ],
    "javascript": [
        "", "import a, {b as c} from './x.js';\nexport default class extends A { #p = 1; static async *m() { yield* this.#p } get x() { return 1 } }\n", "let a = b\nlet c = d\n(function () { return })()\n", "const {a, b: [c = 1], ...d} = e ?? f?.g?.[0]?.(1);\n",
        "x = a / b / c; y = /re[/]x/g.test(s) ? `t ${`in ${n}`} end` : 1n;\n", "for (const x of y) if (x) continue; else break\n", "label: for (;;) { switch (a) { case 1: b(); default: c } }\n", "async () => { await x; for await (const a of b) {} }\n", "a => ({b: 1, [c]: 2, d() {}, get e() { return 1 }})\n", "do x++; while (x < 5)\ny = x\n", "[1, 2]\n",
    ],
    "typescript": [
        "", "interface A<T extends B = C> extends D { readonly x?: number; m<U>(a: U): asserts a is string; [k: string]: unknown; new (x: number): A }\n", "type X = { [K in keyof T as `a${K}`]?: T[K] extends infer U ? U : never } | (typeof x)[number];\n",
        "abstract class A<T> implements B<T>, C { constructor(private readonly x: Map<string, Array<number>>, public y?: string) { super() } abstract m(): void; declare z: number }\n", "enum E { A = 1, B }\ndeclare module 'x' { export function f(a: string): void }\n", "const f = <T,>(x: T): x is T => x as unknown as T;\nlet y = z!.a satisfies B;\n",
        "export type { A } from './a';\nimport type { B } from 'b';\nfunction f(this: Window, ...r: [a: string, b?: number]): void {}\n", "namespace A.B { export const x = 1 }\nlet g: (a: number, b?: string) => void = () => {};\n",
    ],
    "go": [
        "package a\n", 'package a\n\nimport (\n\t"fmt"\n\t. "x"\n)\n\ntype S[T any] struct {\n\tA, B int `json:"a"`\n\t*E\n}\n\nfunc (s *S[T]) M(a, b int, c ...string) (n int, err error) {\n\tfor i, x := range c {\n\t\tif v, ok := m[x]; ok && v > 1 {\n\t\t\tcontinue\n\t\t} else if !ok {\n\t\t\tgoto end\n\t\t}\n\t}\nend:\n\tswitch x := y.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tdefer func() { recover() }()\n\treturn map[string][]int{"a": {1, 2}}["a"][0], nil\n}\n',
        "package a\nvar x = []struct{ a int }{{1}, {2}}\nconst (\n\tA = iota\n\tB\n)\nfunc f[K comparable, V int | ~string](m map[K]V) func(K) V { return func(k K) V { return m[k] } }\n",
    ],
    "java": [
        "", "package a.b;\nimport static x.Y.*;\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<T> implements G, H { static { x = 1; } private int[] a[] = {1, 2}, b; @Override public <U> List<? super U> m(final int x, String... r) throws E { for (int i = 0, j = 1; i < j; i++) { } return (T) r -> { return 1; }; } C() { this(1); } }\n",
        'enum E { A(1) { void m() {} }, B; E(int... x) {} }\nrecord R(int a, String b) implements I { R { assert a > 0 : "x"; } }\nsealed interface I permits R {}\n@interface An { int value() default 1; }\n', 'class A { String s = """\n  text "x"\n  """; Object m(Object o) { return switch (o) { case Integer i when i > 1 -> i; case R(int a, var b) -> { yield a; } default -> throw new E(); }; } }\n',
        "class A { void m() { try (var x = f(); y) { a.<T>b(A::new, int[]::new).c()[1]++; } catch (final A | B e) { } finally { } do { x >>>= 1; } while (x >= 2); new int[]{1}; o = new X<>() { }; l: for (var v : vs) break l; } }\n",
    ],
    "rust": [
        "", "#![allow(x)]\nuse a::{self, b as c, d::*};\npub(crate) struct S<'a, T: ?Sized + 'a, const N: usize = 3>(pub &'a T) where T: Fn(u8) -> u8;\n", "impl<'a, T> Tr<Item = T> for S<'a, T> { const X: u8 = 1; type Y = Vec<Vec<T>>; async unsafe fn f(&mut self, (a, b): (u8, &str)) -> Result<(), Box<dyn Error + Send>> { Ok(()) } }\n" if False else "impl<'a, T> Tr for S<'a, T> { const X: u8 = 1; type Y = Vec<Vec<T>>; async fn f(&mut self, (a, b): (u8, &str)) -> Result<(), Box<dyn Error + Send>> { Ok(()) } }\n",
        "fn f() { let x = if a { 1 } else if let Some(y) = b { y } else { 2 }; match x { 0 | 1..=5 if z => {}, S { a, ref b, .. } => (), _ => return, } 'l: loop { break 'l 5; } let c = move |a: u8, b| -> u8 { a + b }; println!(\"{}\", x); v[0]?.await.0.1; a as u8 as u16; &mut *p; r#\"raw\"#; 'c'; b'x'; 1u8..2; ..; x = S { a: 1, ..d }; }\n",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nunsafe extern \"C\" { fn g(x: *const u8, ...); }\nenum E { A, B(u8), C { x: u8 } = 3 }\ntrait T: A + B { fn d(&self) where Self: Sized {} }\n/* a /* nested */ b */\nstatic mut X: [u8; 3] = [0; 3];\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "3", '""'],
}
INVALID = {
    "python": ["x = (1\n", "def f(:\n    pass\n", "if x:\n", "  x = 1\n", "x = 1\n  y = 2\n", "<<<<<<< HEAD\n", "'''open\n", "x = 1 +\n", "f(x for x in y, 1)\n", "1 = x\n", "f'{a b}'\n", "f'}'\n", "def f(a=1, b): pass\n", "print 'x'\n", "x = 12ab\n", "else:\n    pass\n", "if x:\n        a\n    b\n", "x²\n", "f() = 1\n", "import\n"],
    "javascript": ["let = ;", "function f( {", "if (x) {", "a b", "`open ${x", "class A { x y }", '{"a": 1, "b": 2}', "def f(x):\n    return x\n", "<<<<<<< HEAD\n", "import x from;", "'open\n"],
    "typescript": ["interface A { x: }", "let x: = 1", "const f = (a: number => a", "class A { m( }", "=======\n"],
    "go": ["", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() { a.b }}\n", "import { x } from 'y';\n", "package a\nfunc f() int { return [1, 2] }\n", "# Title\n"],
    "java": ["class A {", "class A { int x }", "class A { void m() { x = ; } }", "def f(): pass", "class A { void m() { f(1 } }", "<<<<<<< ours\nclass A {}"],
    "rust": ["fn f( {}", "fn f() { let = 1; }", "struct S { a }", "package x", "fn f() { match x { 1 => } }", "fn f() {", "impl {} }"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "[1 2]", "NaN", '"\n"', "01", "é", '{"a" 1}'],
}


@pytest.mark.parametrize("name", VALID)
def test_valid_texts(name):
    assert [t for t in VALID[name] if L.check(t, name) is not None] == []


@pytest.mark.parametrize("name", INVALID)
def test_invalid_texts(name):
    assert [t for t in INVALID[name] if L.check(t, name) is None] == []


def test_python_mutants_agree_with_the_interpreter():
    """Brute force: broken and whole variants of real modules, against the interpreter's own parser."""
    warnings.simplefilter("ignore")
    random.seed(4)
    sources = [open(m.__file__, encoding="utf-8").read() for m in (ast, json, random, pytest)]
    from siltstone.llm import docpairs, gll

    sources += [open(m.__file__, encoding="utf-8").read() for m in (L, docpairs, gll)]
    wrong = []
    for i in range(250):
        s = random.choice(sources)
        a = random.randrange(len(s))
        s = [s[:a], s[:a] + s[a + random.randrange(1, 6) :], s[:a] + random.choice("()[]{}:;,'\"\\ \n\t=#") + s[a:], s][i % 4]
        try:
            ast.parse(s)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ok != (L.check(s, "python") is None):
            wrong.append((ok, s[max(0, a - 40) : a + 40]))
    assert len(wrong) <= 3, wrong


def test_error_lines_and_odd_input():
    assert L.check("x = 1\ny = (\n", "python") >= 2
    assert L.check("let a = 1;\nlet b = ;\n", "javascript") == 2
    assert L.check("package a\n\nfunc f() {\n\tx y\n}\n", "go") == 4
    random.seed(1)
    junk = "`$ {}[]()'\"\\/*<>=;:,.é²º \x0b\x85#@!?%^&|~0x1e9_\n\r\t\U0001f642"
    for name in VALID:
        for _ in range(150):
            L.check("".join(random.choices(junk, k=random.randrange(60))), name)
    assert L.check("(" * 20000, "python") is not None
    assert L.check("x = [" + "1, " * 50_000 + "]\n", "python") is None


def test_dialects_that_accept():
    assert L.accepting("x = 1\n", "python") == (None, ["python3.13", "python3.8"])
    assert L.accepting("match x:\n    case 1: pass\n", "python")[1] == ["python3.13"] == L.accepting("type A[T] = list[T]\n", "python")[1]
    assert L.accepting("with (a) b();\n", "javascript")[1] == ["javascript script"] and L.accepting("import x from 'y';\n", "javascript")[1] == ["javascript module"]
    assert L.check("import x from 'y';\nwith (a) b();\n", "javascript") is not None
    assert L.check("class A { void m() { s.x = f(1, [1, s]); } }\n", "java+lists") is None
    lists = "class A { int[] m() { return f(1, [1, x]); } }"
    assert L.check(lists, "java") is not None and L.accepting(lists, "java+lists") == (None, ["java with lists"])


def test_operator(spark):
    rows = [("r/a.py", "x = (\n"), ("r/a.py", "x = (\n"), ("r/b.py", "x = 1\n"), ("r/c.py", None), (None, "x"), ("r/d.txt", "((("), ("r/e.PY", ""), ("r/g.go", ""), ("q/two.py", "1"), ("q/two.py", "1 1")]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("parse_error", F.lit("clash"))
    got = {r.path: r.parse_error for r in parse.parse_files(df).collect()}
    assert got == {"r/a.py": True, "r/b.py": False, "r/e.PY": False, "r/g.go": True, "q/two.py": True}
    assert parse.parse_files(df.where("false")).count() == 0
    units = df.withColumn("node_type", F.lit("file"))
    files = spark.createDataFrame([("r/a.py", "SyntaxError"), ("r/b.py", "timed out")], "path string, parse_error string")
    ext = spark.createDataFrame([("r/g.go", ["unexpected EOF"]), ("r/b.py", None)], "path string, parse_errors array<string>")
    rates = {(r.repository, r.language): (r.files, r.errors, r.reported, r.rate) for r in parse.parse_rates(units, files, ext).collect()}
    assert rates == {("r", "python"): (3, 1, 1, 0.333333), ("r", "go"): (1, 1, 1, 1.0), ("q", "python"): (1, 1, 0, 1.0)}
