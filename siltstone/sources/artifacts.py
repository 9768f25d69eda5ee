"""Nodes and edges of source files in many languages: the syntax tree for Python, patterns elsewhere."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import batch
from siltstone.plans.stage import spread, stage

from siltstone.sources.python_units import _dotted

NODE = "id string, label string, kind string, source_file string, source_location string, language string, qualname string, signature string, start_line int, end_line int"
EDGE = "source string, target string, target_ref string, relation string, confidence string, source_location string"
_ROW = f"row string, {NODE}, source string, target string, target_ref string, relation string, confidence string, parse_error string"

_COMMENTS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)
_HASH_COMMENTS = re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_HASHED = {"bash", "ruby", "python", "elixir", "julia", "powershell"}
#: Definitions by keyword: pattern with the name, and the node's kind.
_DEFINITIONS = [
    (re.compile(r"\b(?:class|struct|object|union)\s+([A-Za-z_]\w*)"), "class"),
    (re.compile(r"\bimpl(?:\s*<[^>{]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)"), "class"),
    (re.compile(r"\btype\s+([A-Za-z_]\w*)\s+struct\b"), "class"),
    (re.compile(r"\b(?:interface|trait|protocol)\s+([A-Za-z_]\w*)"), "interface"),
    (re.compile(r"\btype\s+([A-Za-z_]\w*)\s+interface\b"), "interface"),
    (re.compile(r"\benum\s+(?:class\s+)?([A-Za-z_]\w*)"), "enum"),
    (re.compile(r"\b(?:namespace|defmodule)\s+([A-Za-z_][\w.]*)"), "module"),
    (re.compile(r"\bfunc\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*[(\[]"), "method"),
    (re.compile(r"\b(?:function\*?|func|fn|fun|def|defp|sub)\s+(?:self\.)?([A-Za-z_]\w*)"), "function"),
]
_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|final|async|abstract|override|virtual|synchronized|get|set|readonly)\s+)*(?:[\w<>\[\],.?]+\s+)?([A-Za-z_$]\w*)\s*\([^;{}]*\)[^;{}=]*\{", re.M)
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "new", "throw", "match", "loop", "select", "synchronized", "function", "with", "super", "constructor", "sizeof", "await", "typeof", "elif", "fn", "func", "def", "fun"}
_IMPORT = re.compile(r"^\s*(?:import\s+(?:type\s+)?(?:[^'\"\n]*?\bfrom\s+)?['\"]([^'\"\n]+)['\"]|import\s+(?:static\s+)?([\w.*]+)|use\s+([\w:]+)|using\s+([\w.]+)|#\s*include\s*[<\"]([^>\"\n]+)|require(?:_relative)?\s*\(?['\"]([^'\"\n]+))", re.M)
_GO_IMPORTS = re.compile(r"^import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", re.M)
_CALL = re.compile(r"(?<![\w.])([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*(?:::<[^>]*>)?\(")
_BASES = re.compile(r"\b(?:class|interface|struct)\s+[A-Za-z_]\w*(?:<[^>{]*>)?\s*(?:\(([^)]*)\)|((?:\s*(?:extends|implements|:)\s*[^{]+)))")


#: What a reference may hold, its longest length, and the quotes and brackets taken off its ends.
NO_REFERENCE = r"[^A-Za-z0-9_.$:/@#-]+"
MOST_REFERENCE = 180
ENDS = "'\"`<>()[]{}"


def clean(reference: str) -> str:
    """A reference as one word; empty if it is several words or too long."""
    text = re.sub(NO_REFERENCE, " ", (reference or "").strip().strip(ENDS)).strip()
    return "" if " " in text or len(text) > MOST_REFERENCE else text


class _File:
    def __init__(self, path, language, source):
        self.path, self.language, self.rows = path, language, []
        self.ids, self.links = set(), set()
        self.file = f"file:{path}"
        self.node(self.file, path.rsplit("/", 1)[-1], "file", path, "", 1, source.count("\n") + 1)

    def node(self, node_id, label, kind, qualname, signature, start, end):
        if node_id in self.ids:
            return False
        self.ids.add(node_id)
        self.rows.append({"row": "node", "id": node_id, "label": label, "kind": kind, "source_file": self.path, "source_location": f"L{start}", "language": self.language,
                          "qualname": qualname, "signature": signature.strip()[:500], "start_line": start, "end_line": end})
        return True

    def edge(self, source, relation, confidence, line, target="", ref=""):
        key = (source, relation, target or ref)
        if (target or ref) and key not in self.links:
            self.links.add(key)
            self.rows.append({"row": "edge", "source": source, "target": target, "target_ref": ref, "relation": relation, "confidence": confidence, "source_location": f"L{line}"})

    def define(self, kind, qualname, label, signature, start, end, parent):
        node_id = f"{kind}:{self.path}:{qualname}"
        if self.node(node_id, label, kind, qualname, signature, start, end):
            self.edge(parent, "defines", "EXTRACTED", start, target=node_id)
        return node_id


def _python(f: _File, source: str):
    lines = source.splitlines() or [""]
    todo = [(n, f.file, "") for n in reversed(ast.parse(source).body)]
    while todo:
        node, parent, prefix = todo.pop()
        inner = parent, prefix
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            qualname = f"{prefix}.{node.name}" if prefix else node.name
            node_id = f.define(kind, qualname, node.name, lines[node.lineno - 1], node.lineno, node.end_lineno, parent)
            for base in getattr(node, "bases", ()):
                f.edge(node_id, "inherits", "INFERRED", node.lineno, ref=clean(_dotted(base)))
            inner = node_id, qualname
        elif isinstance(node, ast.Import):
            for a in node.names:
                f.edge(f.file, "imports", "EXTRACTED", node.lineno, ref=a.name)
        elif isinstance(node, ast.ImportFrom):
            f.edge(f.file, "imports", "EXTRACTED", node.lineno, ref="." * node.level + (node.module or ""))
        elif isinstance(node, ast.Call):
            f.edge(parent, "calls", "INFERRED", node.lineno, ref=clean(_dotted(node.func)))
        todo += [(c, *inner) for c in reversed(list(ast.iter_child_nodes(node)))]


def _patterns(f: _File, source: str):
    pattern = _HASH_COMMENTS if f.language in _HASHED else _COMMENTS
    # blank comments and strings, keeping the places of everything else
    blank = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)
    breaks = [m.start() for m in re.finditer("\n", source)]
    line_of = lambda at: bisect_left(breaks, at) + 1
    found = []
    for p, kind in _DEFINITIONS:
        found += [(m.start(), m.group(1), kind) for m in p.finditer(blank)]
    if f.language in ("java", "javascript", "typescript", "tsx", "csharp", "cpp", "groovy", "php", "scala", "kotlin"):
        found += [(m.start(1), m.group(1), "method") for m in _METHOD.finditer(blank) if m.group(1) not in _CONTROL]
    found.sort()
    closes, opened = {}, []
    for m in re.finditer(r"[{}]", blank):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            closes[opened.pop()] = m.end()
    spans, taken = [], set()
    for at, name, kind in found:
        if (line_of(at), name) in taken:
            continue
        taken.add((line_of(at), name))
        brace, stop = blank.find("{", at), blank.find(";", at)
        end = at
        if brace >= 0 and (stop < 0 or brace < stop):
            end = closes.get(brace, len(blank))
        spans.append((at, end, name, kind))
    owners = []
    for at, end, name, kind in spans:
        while owners and owners[-1][1] <= at:
            owners.pop()
        parent, prefix = (owners[-1][2], owners[-1][3]) if owners else (f.file, "")
        if kind == "function" and owners and owners[-1][4] in ("class", "interface"):
            kind = "method"
        qualname = f"{prefix}.{name}" if prefix else name
        first = source[source.rfind("\n", 0, at) + 1 : source.find("\n", at) if "\n" in source[at:] else len(source)]
        node_id = f.define(kind, qualname, name, first, line_of(at), line_of(max(at, end - 1)), parent)
        m = _BASES.match(blank, at)
        if m:
            for base in re.findall(r"[A-Za-z_][\w.:]*", re.sub(r"\b(?:extends|implements|public|private|protected|virtual)\b|<[^>]*>", " ", m.group(1) or m.group(2) or "")):
                f.edge(node_id, "inherits", "INFERRED", line_of(at), ref=clean(base))
        owners.append((at, end, node_id, qualname, kind))
    owner_of = [f.file] * (len(breaks) + 2)  # innermost definition of each line
    for r in sorted((r for r in f.rows if r["row"] == "node" and r["id"] != f.file), key=lambda r: (r["start_line"], -r["end_line"])):
        for n in range(r["start_line"], r["end_line"] + 1):
            owner_of[n] = r["id"]
    if f.language == "go":
        for m in _GO_IMPORTS.finditer(source):
            for ref in re.findall(r'"([^"]+)"', m.group()):
                f.edge(f.file, "imports", "EXTRACTED", line_of(m.start()), ref=clean(ref))
    else:
        for m in _IMPORT.finditer(source):
            f.edge(f.file, "imports", "EXTRACTED", line_of(m.start() + len(m.group()) - len(m.group().lstrip())), ref=clean(next(g for g in m.groups() if g)))
    starts = {(at, name) for at, _, name, _ in spans}
    for m in _CALL.finditer(blank):
        name = m.group(1)
        if name.split(".")[0].split("::")[0] in _CONTROL or (m.start(1), name) in starts:
            continue
        line = line_of(m.start())
        before = blank[blank.rfind("\n", 0, m.start()) + 1 : m.start()]
        if re.search(r"\b(?:function\*?|func|fn|fun|def|class)\s+(?:\([^)]*\)\s*)?$", before) or (line, name) in taken:
            continue
        f.edge(owner_of[line], "calls", "INFERRED", line, ref=clean(name))


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, extractions) of ``(path, language, content)`` rows.

    Extractions are ``(path, language, n_nodes, n_edges, parse_errors)``.
    References stay unresolved (``target_ref``).  Languages other than Python
    are read by patterns over the code without comments and strings: best effort.
    """
    def parse(batches):
        for b in batches:
            out = []
            for path, language, content in zip(*(c.to_pylist() for c in b.columns)):
                f, error = _File(path, language, content or ""), None
                if language == "python":
                    try:
                        _python(f, content or "")
                    except (SyntaxError, ValueError, RecursionError) as e:
                        error = f"{type(e).__name__}: {e}"[:1000]
                elif language != "json":
                    _patterns(f, content or "")
                out += f.rows
                out.append({"row": "file", "source_file": path, "language": language, "start_line": sum(r["row"] == "node" for r in f.rows), "end_line": sum(r["row"] == "edge" for r in f.rows), "parse_error": error})
            yield batch(out, _ROW)

    rows = stage(spread(files.select("path", "language", "content"), "path").mapInArrow(parse, _ROW), "extraction")
    nodes = rows.where("row = 'node'").select(*[c.split()[0] for c in NODE.split(", ")])
    edges = rows.where("row = 'edge'").select(*[c.split()[0] for c in EDGE.split(", ")])
    errors = F.filter(F.array("parse_error"), lambda x: x.isNotNull())
    meta = rows.where("row = 'file'").select(F.col("source_file").alias("path"), "language", F.col("start_line").alias("n_nodes"), F.col("end_line").alias("n_edges"), errors.alias("parse_errors"))
    return nodes, edges, meta
