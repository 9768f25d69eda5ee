"""Lexers and dialect tables of the languages whose files can be checked.

``check(text, extension)`` recognises one file with the generalised LL
machine of its extension.  All dialects of a language run in the same pass; a
file is in error only if every one of them rejects it.
"""

from __future__ import annotations

import re

from . import grammars as G
from .gll import Machine, Network, Reject

_BRACKETS = {"(": ")", "[": "]", "{": "}"}
#: A worker drops its memo beyond so many entries (memory bound; results don't change).
MEMO_LIMIT = 200_000


class _Kinds(dict):
    """token text -> kind number; None is skipped, -1 is illegal."""

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, text):
        kind = self.classify(text)
        if len(text) <= 64:
            if len(self) > MEMO_LIMIT:
                self.clear()
            self[text] = kind
        return kind


class Language:
    name = ""
    pattern: re.Pattern
    ops: dict[str, str] = {}
    comment = ("//", "/*")
    number = re.compile(r".*", re.S)

    def __init__(self, dialects, *, soft="", words="", brackets=None, eos=None, newline=None):
        self.dialects, self.brackets = dialects, brackets or _BRACKETS
        self.soft, self.words = soft.split(), words.split()
        self.eos, self.newline = eos, newline
        self.build()

    def build(self):
        self.net = Network(self.dialects, self.brackets, self.soft, self.words)
        self.nl = self.net.kinds.get("NL", -2)
        self.machine = Machine(self.net, self.eos, self.newline)
        self.rules = frozenset(self.net.starts.values())
        self.by_rule = {r: n for n, r in self.net.starts.items()}
        self.kinds = _Kinds(self.classify)

    def classify(self, t):
        known = self.net.kinds
        c = t[0]
        if c == "\n":
            return self.nl if "NL" in known else None
        if t.startswith(self.comment):
            if self.nl >= 0 and "\n" in t:
                return self.nl
            return None
        if t in self.ops:
            return known.get(self.ops[t], -1)
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return known["NUM"] if self.number.fullmatch(t) else -1
        if len(t) > 1 and t[-1] in "\"'`" and self.is_string(t):
            return known["STR"]
        if c.isalpha() or c in "_$" or ord(c) > 127 and c.isidentifier():
            if t in known and (t in self.soft or t in self.words):
                return known[t]
            return known.get("NAME", -1)
        got = known.get(t, -1)
        return got

    def is_string(self, t):
        return t[0] in "\"'`"

    def lex(self, text, index=None):
        """Kind numbers of the text; ``index`` collects the number of each one's raw token."""
        kinds = list(map(self.kinds.__getitem__, self.pattern.findall(text)))
        if index is not None:
            index.extend(i for i, k in enumerate(kinds) if k is not None)
        return [k for k in kinds if k is not None]

    def prepare(self, text):
        return text[1:] if text.startswith("﻿") else text

    def check(self, text):
        """None if some dialect derives the text, else the 1-based line of the first bad token."""
        text = self.prepare(text.replace("\r\n", "\n").replace("\r", "\n"))
        if len(self.machine.levels) > MEMO_LIMIT:
            self.build()
        kinds = self.lex(text)
        bad = self.machine.run(kinds, self.rules)
        if bad < 0:
            return None
        return self.line(text, bad)

    def line(self, text, bad):
        index: list[int] = []
        self.lex(text, index)
        if bad >= len(index):
            return max(1, text.rstrip("\n").count("\n") + 1)
        for i, m in enumerate(self.pattern.finditer(text)):
            if i == index[bad]:
                return text.count("\n", 0, m.start()) + 1
        return max(1, text.rstrip("\n").count("\n") + 1)


class Json(Language):
    pattern = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?\d[\w.+-]*|[A-Za-z_]\w*|[^ \t\n]')
    number = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.A)
    comment = ("\0",)

    def classify(self, t):
        if t[0] == "-" and len(t) > 1:
            return self.net.kinds["NUM"] if self.number.fullmatch(t) else -1
        if t in ("true", "false", "null"):
            return self.net.kinds[t]
        if t[0].isalpha() or t[0] == "_":
            return -1
        return super().classify(t)

    def prepare(self, text):
        return text


class Python(Language):
    pattern = re.compile(
        r"\n(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*"
        r"|(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''"
        r"|(?!\"\"\")\"(?:[^\"\\\n]|\\.)*\"|(?!''')'(?:[^'\\\n]|\\.)*')"
        r"|[^\W\d]\w*|0[xX]\w+|\.?\d(?:[eE][+-](?=\d)|\w|\.(?!\.))*"
        r"|#[^\n]*|\\\n|\*\*=?|//=?|>>=?|<<=?|!=|->|:=|\.\.\.|[-+*/%@&|^=<>]=?|[~:;.,()\[\]{}]|[^ \t\f\n]",
        re.S,
    )
    number = re.compile(
        r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|0(?:_?0)*|[1-9](?:_?\d)*"
        r"|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.|\d(?:_?\d)*(?=[eE]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[jJ])",
        re.A,
    )
    comment = ("#",)
    _badescape = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{[^}]+\}))")
    ops = dict.fromkeys(("==", "!=", "<=", ">="), "CMP") | dict.fromkeys(("%", "//", "|", "&", "^", "<<", ">>"), "BIN")
    ops |= dict.fromkeys(("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="), "AUG")
    ops |= {"|": "|", "/": "/"}
    _indents: dict[str, tuple[int, int]] = {}

    def __init__(self):
        now = G.python("P310", "P312")
        super().__init__(
            {"python3.13": (now, "file"), "python3.8": (G.python(), "file"), "expression": (now, "fexpr")},
            brackets=_BRACKETS | {"INDENT": "DEDENT"},
            soft="match case type",
            words="and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False",
        )

    def build(self):
        super().build()
        k = self.net.kinds
        self.rules = frozenset([self.net.starts["python3.13"], self.net.starts["python3.8"]])
        self.inner = frozenset([self.net.starts["expression"]])
        self.k_newline, self.k_in, self.k_out = k["NEWLINE"], k["INDENT"], k["DEDENT"]

    def classify(self, t):
        c = t[0]
        if c == "\n":
            return -3
        if c == "#" or t == "\\\n":
            return None
        if t[-1] in "\"'":
            return self.string(t)
        if not t.isascii() and not t.isidentifier():
            return -1
        return super().classify(t)

    def string(self, t):
        q = min(i for i in (t.find('"'), t.find("'")) if i >= 0)
        prefix = t[:q].lower()
        if len(t) == q + 1:
            return -1
        if "b" in prefix:
            if not t.isascii():
                return -1
        elif "r" not in prefix and "\\" in t and self._badescape.search(t):
            return -1
        if "f" in prefix and ("{" in t or "}" in t) and not self.fields(t[q + 3 : -3] if t[q : q + 3] in ('"""', "'''") and len(t) >= q + 6 else t[q + 1 : -1]):
            return -1
        return self.net.kinds["STR"]

    def fields(self, body, depth=0):
        """Whether the replacement fields of an f-string's text are expressions."""
        i, n = 0, len(body)
        while i < n:
            c = body[i]
            if c == "}":
                if not depth and body[i : i + 2] == "}}":
                    i += 2
                    continue
                return False
            if c != "{":
                i += 1
                continue
            if not depth and body[i : i + 2] == "{{":
                i += 2
                continue
            j, nest, quote = i + 1, [], ""
            while j < n:
                d = body[j]
                if quote:
                    if d == quote:
                        quote = ""
                elif d in "\"'":
                    quote = d
                elif d in "([{":
                    nest.append(d)
                elif nest and d in ")]}":
                    nest.pop()
                elif not nest and (d in "}:" or d == "!" and body[j + 1 : j + 2] != "="):
                    break
                j += 1
            if j >= n:
                return False
            expr = body[i + 1 : j].rstrip()
            if expr.endswith("=") and not re.search(r"[=!<>]=$", expr):
                expr = expr[:-1]
            if not expr.strip() or self.machine.run(self.lex("(" + expr + ")", tail=False)[1:-1], self.inner) >= 0:
                return False
            if body[j] == "!":
                m = re.compile(r"![rsa]\s*").match(body, j)
                if not m or m.end() >= n:
                    return False
                j = m.end()
            if body[j] == ":":
                k, nest2 = j + 1, 0
                while k < n and (nest2 or body[k] != "}"):
                    nest2 += (body[k] == "{") - (body[k] == "}")
                    k += 1
                if k >= n or not self.fields(body[j + 1 : k], depth + 1):
                    return False
                j = k
            if body[j] != "}":
                return False
            i = j + 1
        return True

    def indent(self, t):
        got = self._indents.get(t)
        if got is None:
            wide = narrow = 0
            for c in t[t.rfind("\n") + 1 :]:
                if c == "\t":
                    wide, narrow = (wide // 8 + 1) * 8, narrow + 1
                elif c == "\f":
                    wide = narrow = 0
                else:
                    wide, narrow = wide + 1, narrow + 1
            got = (wide, narrow)
            if len(t) < 64:
                self._indents[t] = got
        return got

    def lex(self, text, index=None, tail=True):
        known, n_open, n_close = self.kinds, self.net.n_open, self.net.n_close
        newline, k_in, k_out = self.k_newline, self.k_in, self.k_out
        toks = self.pattern.findall("\n" + text + "\n" if tail else text)
        out: list[int] = []
        put = out.append
        stack, depth, at_line = [(0, 0)], 0, True
        for i, t in enumerate(toks):
            k = known[t]
            if k is None:
                continue
            if k == -3:
                if depth:
                    continue
                if not at_line:
                    put(newline)
                    at_line = True
                if i + 1 < len(toks) or not tail:
                    col = self.indent(t)
                    top = stack[-1]
                else:
                    col, top = (0, 0), stack[-1]
                if col != top:
                    if known.get(toks[i + 1] if i + 1 < len(toks) else "", 0) is None and toks[i + 1][0] == "#":
                        continue
                    if col > top:
                        put(k_in if col[1] > top[1] else -1)
                        stack.append(col)
                    else:
                        while stack[-1] > col:
                            stack.pop()
                            put(k_out)
                        if stack[-1] != col:
                            put(-1)
            else:
                at_line = False
                if k < n_close and k >= 0:
                    depth += 1 if k < n_open else -1
                put(k)
            if index is not None:
                index.extend([i] * (len(out) - len(index)))
        return out

    def line(self, text, bad):
        index: list[int] = []
        self.lex(text, index)
        if bad < len(index):
            for i, m in enumerate(self.pattern.finditer("\n" + text + "\n")):
                if i == index[bad]:
                    t = m.group()
                    at = m.end() if t[0] == "\n" else m.start()
                    return max(1, min(("\n" + text).count("\n", 0, at), text.count("\n") + 1))
        return max(1, text.rstrip("\n").count("\n") + 1)

    def check(self, text):
        if "\0" in text:
            return 1
        got = super().check(text)
        if got is not None and self._fprefix.search(text):
            flat = flatten_fstrings(text.replace("\r\n", "\n").replace("\r", "\n"))
            if flat is not None and super().check(flat) is None:
                return None
        return got

    _fprefix = re.compile(r"""(?<!\w)(?:[fF][rR]?|[rR][fF])["']""")


def flatten_fstrings(text):
    """Replace f-strings that reuse their quotes inside fields by plain strings.

    Only tried after a rejection: such nesting can't be seen by the token
    pattern.  ``f"a{b["c"]}"`` becomes ``""``, and its field is appended to the
    text as the line ``(b["c"])``; None if a field never ends.
    """
    out, fields, i, n = [], [], 0, len(text)
    plain = re.compile(r"""#[^\n]*|(?:[rR][bB]?|[bB][rR]?|[uU])?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')""", re.S)
    start = re.compile(r"""(?:[fF][rR]?|[rR][fF])(\"\"\"|'''|"|')""")

    def fstring(i, q):
        while i < n:
            if text.startswith(q, i):
                return '""', i + len(q)
            c = text[i]
            if c == "\\":
                i += 2
            elif text.startswith(("{{", "}}"), i):
                i += 2
            elif c == "{":
                depth, i, expr = 0, i + 1, []
                while i < n:
                    m = start.match(text, i) if not text[i - 1].isalnum() else None
                    if m:
                        part, i = fstring(m.end(), m.group(1))
                        if part is None:
                            return None, i
                        expr.append(part)
                        continue
                    m = plain.match(text, i)
                    if m:
                        expr.append(m.group())
                        i = m.end()
                        continue
                    c = text[i]
                    if c in "([{":
                        depth += 1
                    elif c in ")]}":
                        if not depth:
                            break
                        depth -= 1
                    elif not depth and c == "!" and text[i + 1 : i + 2] != "=":
                        i += 2
                        continue
                    elif not depth and c == ":":
                        nest = 0
                        while i < n and (nest or text[i] != "}"):
                            nest += (text[i] == "{") - (text[i] == "}")
                            i += 1
                        break
                    expr.append(c)
                    i += 1
                e = "".join(expr).rstrip()
                if e.endswith("=") and not re.search(r"[=!<>]=$", e):
                    e = e[:-1]
                fields.append("(" + e + "\n)\n")
                i += 1
            elif c == "}" or c == "\n" and len(q) == 1:
                return None, i
            else:
                i += 1
        return None, i

    while i < n:
        m = start.match(text, i) if not i or not (text[i - 1].isalnum() or text[i - 1] == "_") else None
        if m:
            part, i = fstring(m.end(), m.group(1))
            if part is None:
                return None
            out.append(part)
            continue
        m = plain.match(text, i)
        if m:
            out.append(m.group())
            i = m.end()
        else:
            out.append(text[i])
            i += 1
    return "".join(out) + "\n" + "".join(fields)


_NUM = r"\.?\d(?:[eEpP][+-](?=\d)|[\w]|\.(?!\.))*"


class Ecma(Language):
    pattern = re.compile(
        r"\n\s*|//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\W\d][\w$]*|\$[\w$]*|\#[\w$]+|0[xX]\w+|" + _NUM +
        r"|\.\.\.|=>|===?|!==?|\*\*=?|\?\?=?|&&=?|\|\|=?|\+\+|--|<<=?|<=|\?\.(?!\d)|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;.,@(){}\[\]]|[^\s]",
        re.S,
    )
    number = re.compile(r"(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+)n?|(?:\d[\d_]*)?\.?\d*[\d_]*(?:[eE][+-]?\d+)?n?", re.A)
    ops = dict.fromkeys(("===", "==", "!==", "!=", "**", "??", "&&", "||", "<<", "<=", "%", "^"), "BIN") | dict.fromkeys(("++", "--"), "INC")
    ops |= dict.fromkeys(("**=", "??=", "&&=", "||=", "<<=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="), "ASGN") | {"&": "AMP", "|": "BAR"}

    def __init__(self, *flags):
        text = lambda *more: G.variant(G.ECMA, *flags, *more).replace("'BIN'", "('BIN' | 'AMP' | 'BAR')")
        name, modules = ("typescript", ("MODULE", "TSM")) if "TS" in flags else ("javascript", ("MODULE",))
        soft = "as async from get set of static target accessor let await yield" + (
            " abstract asserts declare global infer interface is keyof module namespace override private protected public readonly satisfies type unique out any" if "TS" in flags else " any")
        words = ("break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof new null return super switch this throw true try typeof var void while with")
        if "TS" not in flags:
            words = words.replace(" implements", "")
        self.flags = flags
        super().__init__({f"{name} module": (text(*modules), "program"), f"{name} script": (text("SCRIPT"), "program")}, brackets=_BRACKETS | {"${": "}"}, soft=soft, words=words, eos="NL", newline="NL")

    def build(self):
        super().build()
        k = self.net.kinds
        self.k = k
        self.slow = {k["/"], self.kinds["/="], -1} if "/" in k else {-1}
        self.template = {n: k[n] for n in ("TPL", "TPLOPEN", "TPLMID", "TPLEND", "REGEX")}
        self.operand = {k[x] for x in ("NAME", "NUM", "STR", "TPL", "TPLEND", "REGEX", "PRIVATE", ")", "]", "this", "super", "null", "true", "false", "INC")} | {k[s] for s in self.soft}

    def classify(self, t):
        if t[0] == "#" and len(t) > 1:
            return self.net.kinds["PRIVATE"]
        if t[0] in "$_" or t[0].isidentifier():
            return super().classify(t)
        if t == "`":
            return -1
        return super().classify(t)

    def prepare(self, text):
        text = super().prepare(text)
        return re.sub(r"\A#![^\n]*", "", text)

    def lex(self, text, index=None):
        kinds = list(map(self.kinds.__getitem__, self.pattern.findall(text)))
        if not self.slow.isdisjoint(kinds):
            return self.careful(text, index)
        if index is not None:
            index.extend(i for i, k in enumerate(kinds) if k is not None)
        return [k for k in kinds if k is not None]

    _regex = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
    _chunk = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)

    def careful(self, text, index=None):
        """Lexing with regard to what precedes a slash, and with template literals."""
        k, tp, out = self.k, self.template, []
        pos, n, braces, parens, last, before = 0, len(text), [], [], -9, -9
        control = {k.get(w) for w in ("if", "while", "for", "with")}
        match, known = self.pattern.match, self.kinds
        where: list[int] = []
        self._where = where
        closed_control = False

        def put(kind):
            out.append(kind)
            where.append(pos)

        while pos < n:
            c = text[pos]
            if c.isspace() and c != "\n":
                pos += 1
                continue
            if c == "`" or c == "}" and braces and braces[-1] == "${":
                opening = c == "`"
                m = self._chunk.match(text, pos + 1)
                if not m:
                    put(-1)
                    break
                if not opening:
                    braces.pop()
                    put(k["}"])
                if m.group(1) == "`":
                    put(tp["TPL" if opening else "TPLEND"])
                    last = tp["TPL"]
                else:
                    put(tp["TPLOPEN" if opening else "TPLMID"])
                    put(k["${"])
                    braces.append("${")
                    last = k["${"]
                pos = m.end()
                continue
            if c == "/" and text[pos : pos + 2] not in ("//", "/*") and (last not in self.operand or last == k[")"] and closed_control):
                m = self._regex.match(text, pos)
                if m:
                    put(tp["REGEX"])
                    last, pos = tp["REGEX"], m.end()
                    continue
            m = match(text, pos)
            if not m:
                put(-1)
                break
            kind = known[m.group()]
            if kind is None or kind == self.nl:
                if kind is not None:
                    put(kind)
                pos = m.end()
                continue
            put(kind)
            if c == "{":
                braces.append("{")
            elif c == "}" and braces:
                braces.pop()
            elif c == "(":
                parens.append(last in control)
            elif c == ")" and parens:
                closed_control = parens.pop()
            last, pos = kind, m.end()
        if index is not None:
            index.extend(range(len(out)))
        return out

    def line(self, text, bad):
        kinds = list(map(self.kinds.__getitem__, self.pattern.findall(text)))
        if self.slow.isdisjoint(kinds):
            return super().line(text, bad)
        self.careful(text)
        if bad < len(self._where):
            return text.count("\n", 0, self._where[bad]) + 1
        return max(1, text.rstrip("\n").count("\n") + 1)


class Go(Language):
    pattern = re.compile(
        r"\n|//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n]+?)'|[^\W\d]\w*|0[xX][\w.]+(?:[+-]\d+)?|" + _NUM +
        r"|\.\.\.|<<=?|>>=?|&\^=?|&&|\|\||<-|\+\+|--|:=|[-+*/%&|^=!<>]=|[-+*/%&|^!~<>=:;.,(){}\[\]]|[^ \t\f\n]",
        re.S,
    )
    number = re.compile(r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[oO][0-7_]+|0[bB][01_]+|[\d_]*\.?[\d_]*(?:[eE][+-]?[\d_]+)?)i?", re.A)
    ops = dict.fromkeys(("==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "&^", "/", "%"), "BIN") | {"++": "INC", "--": "INC", "&": "AMP", "|": "BAR"}
    ops |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="), "ASGN")

    def __init__(self):
        super().__init__({"go": (G.GO, "file")}, eos=";",
            words="break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")

    def build(self):
        super().build()
        k = self.net.kinds
        self.ends = {k[x] for x in ("NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "INC", ")", "]", "}")}

    def classify(self, t):
        if t[0] == "\n":
            return -3
        if t.startswith("/*"):
            return -3 if "\n" in t else None
        return super().classify(t)

    def lex(self, text, index=None):
        out, semi, ends, last = [], self.net.kinds[";"], self.ends, -9
        for i, k in enumerate(map(self.kinds.__getitem__, self.pattern.findall(text + "\n"))):
            if k is None:
                continue
            if k == -3:
                if last not in ends:
                    continue
                k = semi
            out.append(k)
            last = k
            if index is not None:
                index.append(i)
        return out


class Java(Language):
    pattern = re.compile(
        r"//[^\n]*|/\*.*?\*/|\"\"\"[ \t\f]*\n(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n]+?)'|[^\W\d][\w$]*|\$[\w$]*|0[xX][\w.]+|" + _NUM +
        r"|\.\.\.|->|::|<<=?|<=|&&|\|\||\+\+|--|[-+*/%&|^=!]=|[-+*/%&|^!~<>=?:;.,@(){}\[\]]|[^\s]",
        re.S,
    )
    number = re.compile(r"0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?[lLfFdD]?|0[xX][\da-fA-F_.]+[pP][+-]?\d+[fFdD]?", re.A)
    ops = dict.fromkeys(("==", "!=", "<=", "&&", "||", "<<", "/", "%", "^"), "BIN") | {"++": "INC", "--": "INC", "&": "AMP", "|": "BAR"}
    ops |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="), "ASGN")
    ops |= dict.fromkeys(("int", "long", "short", "byte", "char", "float", "double", "boolean"), "PRIM")
    ops |= dict.fromkeys(("public", "private", "protected", "native", "transient", "volatile"), "MOD")

    def __init__(self, lists=False):
        text = lambda *f: G.variant(G.JAVA, *f).replace("('BIN' |", "('BIN' | 'AMP' | 'BAR' |", 1)
        super().__init__({"java": (text(), "file")} | ({"java with lists": (text("LISTS"), "file")} if lists else {}),
            soft="record sealed permits non yield when module open requires exports opens uses provides to with transitive",
            words="abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface new package return static strictfp super switch synchronized this throw throws try void while true false null")


class Rust(Language):
    pattern = re.compile(
        r"//[^\n]*|/\*.*?\*/|[bc]?r\"[^\"]*\"|[bc]?r#\".*?\"#|[bc]?r##\".*?\"##|[bc]?r###\".*?\"###|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'"
        r"|'[^\W\d]\w*|(?:r#)?[^\W\d]\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]\d[\d_]*)?\w*"
        r"|\.\.[.=]|\.\.|::|->|=>|<<=?|<=|&&|\|\||[-+*/%&|^=!]=|[-+*/%&|^!~<>=?:;.,@#$(){}\[\]]|[^\s]",
        re.S,
    )
    number = re.compile(r"0x[\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+\w*|0b[01_]+\w*|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?_*(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))?", re.A)
    ops = dict.fromkeys(("==", "!=", "<=", "<<", "/", "%", "^"), "BIN") | {"&": "AMP", "|": "BAR", "&&": "AMP2", "||": "BAR2"}
    ops |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="), "ASGN")

    def __init__(self):
        super().__init__({"rust": (G.RUST.replace("chain := ('BIN'", "chain := ('BIN' | 'BAR2'"), "file")},
            soft="union auto default safe raw box",
            words="$ as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while yield _")

    def classify(self, t):
        k = self.net.kinds
        if t[0] == "'" and len(t) > 1 and t[-1] != "'":
            return k["LIFE"]
        if t[-1] in "\"#" and '"' in t:
            return k["STR"]
        if t == "_":
            return k["_"]
        if t == "$":
            return k["$"]
        return super().classify(t)

    def is_string(self, t):
        return "'" in t or '"' in t

    def prepare(self, text):
        text = re.sub(r"\A#!(?!\s*\[)[^\n]*", "", super().prepare(text))
        if re.search(r"/\*(?:(?!\*/).)*/\*", text, re.S):
            text = _strip_nested(text)
        return text


def _strip_nested(text):
    """Blank out nested block comments, outside strings and line comments."""
    out, depth, i = [], 0, 0
    for m in re.finditer(r"//[^\n]*|/\*|\*/|[bc]?r#*\".*?\"#*|\"(?:[^\"\\]|\\.)*\"", text, re.S):
        t = m.group()
        if m.start() < i:
            continue
        if t == "/*":
            if not depth:
                out.append(text[i : m.start()])
            depth += 1
            i = m.end()
        elif t == "*/" and depth:
            depth -= 1
            i = m.end()
    return "".join(out) + (text[i:] if not depth else "\x00")


#: extension -> (language name, factory); the extension alone decides.
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".js": "javascript",
    ".go": "go", ".java": "java", ".rs": "rust", ".json": "json",
}
_FACTORIES = {
    "python": Python, "typescript": lambda: Ecma("TS"), "javascript": lambda: Ecma("JS"), "go": Go, "java": Java, "rust": Rust,
    "java+lists": lambda: Java(True),
    "json": lambda: Json({"json": (G.JSON, "value")}),
}
_made: dict[str, Language] = {}


def language(name: str) -> Language:
    if name not in _made:
        _made[name] = _FACTORIES[name]()
    return _made[name]


def check(text: str, name: str) -> int | None:
    """None if the text is valid in some dialect of the language, else the first bad line."""
    return language(name).check(text)


def accepting(text: str, name: str) -> tuple[int | None, list[str]]:
    """:func:`check` and the names of the dialects that derive the text."""
    known = language(name)
    bad = known.check(text)
    return bad, [] if bad is not None else sorted(known.by_rule[r] for r in known.machine.accepted if r in known.by_rule)


__all__ = ["EXTENSIONS", "Reject", "accepting", "check", "language"]
