"""Functions paired with their documentation, by island grammars per language.

Only islands are parsed - documentation, annotations, signature, balanced
body; all other code is water and skipped token by token.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import languages
from .parse import _language_of

_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_STRING = r"(?:[rR]|[uU])?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
_DOCSTRING = re.compile(r"(?:\s|#[^\n]*(?:\n|\Z)|\\\n)*(" + _STRING + r"(?:[ \t]*" + _STRING + r")*)[ \t]*(?:;|#|\r?\n|\r|\Z)", re.S)
_PY_TOKEN = re.compile(_STRING + r"|#[^\n]*|[()\[\]{}:]|\n|[^\s()\[\]{}:#'\"]+|[ \t\r\f]+|.", re.S)
_PY_DEF = re.compile(r"(?:async\s+)?def\s+(\w+)")


# -- islands of one definition ------------------------------------------------


def _skip_balanced(text: str, at: int, pattern: re.Pattern) -> int:
    """Past the bracket group that opens at ``at`` (the end of the text if it never closes)."""
    depth = 0
    for m in pattern.finditer(text, at):
        t = m.group()
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(text)


def _brace_head(text: str, pattern: re.Pattern):
    """(documentation, signature, body start) of a definition at the start of ``text``."""
    at, n, comments = 0, len(text), []
    while at < n:
        c = text[at]
        if c.isspace():
            end = at
            while end < n and text[end].isspace():
                end += 1
            if text.count("\n", at, end) > 1:
                comments = []  # a blank line: what stood before is not directly before
            at = end
            continue
        m = _COMMENT.match(text, at)
        if m:
            comments.append(m.group())
            at = m.end()
            continue
        if c == "@" and not text.startswith("@interface", at):
            m = re.compile(r"@[\w.$]+\s*").match(text, at)
            at = m.end() if m else at + 1
            if text.startswith("(", at):
                at = _skip_balanced(text, at, pattern)
            continue
        if text.startswith("#[", at):
            at = _skip_balanced(text, at + 1, pattern)
            continue
        break
    begin, depth = at, 0
    for m in pattern.finditer(text, at):
        t = m.group()
        if t in ("(", "["):
            depth += 1
        elif t in (")", "]"):
            depth -= 1
        elif depth <= 0 and t in ("{", ";", "=>"):
            return comments, text[begin : m.start()].strip(), m.start()
    return comments, text[begin:].strip(), n


def _python_head(text: str):
    """(docstring or None, signature, body start) of a ``def`` after its decorators."""
    m = re.compile(r"(?:\s|#[^\n]*\n|@[^\n]*\n)*?(?=(?:async\s+)?(?:def|class)\b)").match(text)
    begin, depth, end = (m.end() if m else 0), 0, len(text)
    for m in _PY_TOKEN.finditer(text, begin):
        t = m.group()
        if t in ("(", "[", "{"):
            depth += 1
        elif t in (")", "]", "}"):
            depth -= 1
        elif t == ":" and depth <= 0:
            end = m.end()
            break
    m = _DOCSTRING.match(text, end)
    return (_unquote(m.group(1)) if m else None), text[begin : max(begin, end - 1)].strip(), end


def _unquote(literals: str) -> str:
    out = []
    for m in re.finditer(_STRING, literals, re.S):
        t = m.group().lstrip("rRuU")
        q = 3 if t[:3] in ('"""', "'''") and len(t) >= 6 else 1
        out.append(t[q:-q])
    return "".join(out)


def uncomment(comments: list[str]) -> str:
    """The text of comments without their markers."""
    out = []
    for c in comments:
        if c.startswith("//"):
            out.append(re.sub(r"^//+!?", "", c).strip())
        else:
            out.extend(re.sub(r"^\s*\*+(?!/)", "", line).strip() for line in re.sub(r"^/\*+!?|\**\*/$", "", c).splitlines())
    return "\n".join(out)


# -- does it say something? ---------------------------------------------------

_DIRECTIVE = re.compile(
    r"(?i)^\W{0,3}(?:noqa|nolint|nosec|nosonar|noinspection|eslint|tslint|jshint|jslint|jscs|standard|istanbul|prettier|biome|stylelint|pylint|pyright|mypy|"
    r"type\s*:\s*ignore|pragma|fmt\s*:|yapf|isort|flake8|ruff|black|coverage|c8 |v8 |ts-|go:|\+build|lint[:\s-]|rustfmt|clippy|allow\(|deny\(|checkstyle|"
    r"suppresswarnings|suppress\b|formatter|webpack|region\b|endregion\b|-\*-|vim?:|coding\s*[:=]|sourcemapping|global[s]?\s|jsx\b|flow\b|nodoc|doctest)"
)
_TODO = re.compile(r"(?i)\b(?:todo|fixme|xxx|tbd|tbc|hack|wip)\b.*", re.S)
_NOUN = r"(?:description|documentation|docstring|docs?|comment|summary|text|details?|explanation)"
_PLACEHOLDER = re.compile(
    r"(?i)^(?:n\s*/?\s*a|none|nil|null|nothing|empty|stub|placeholder|dummy|foo|bar|test|pending|unknown|undefined|tbd|tbc|x+|\?+"
    rf"|(?:please |to )?(?:add|insert|write|put|provide|fill\s*in|enter|complete|replace|update|needs?|missing|no|without|lacks?|your|some|a|the)\b.{{0,24}}\b{_NOUN}\b.{{0,30}}"
    rf"|{_NOUN}\b.{{0,12}}\b(?:here|missing|pending|needed|follows?|later|soon|unavailable|goes|comes|required|tbd).{{0,20}}"
    r"|(?:this (?:method |function )?(?:is |was )?)?(?:auto[- ]?|automatically )generated\b.{0,60}"
    r"|(?:not (?:yet )?|un)documented(?: yet)?|(?:to be|yet to be|not yet) (?:documented|written|done|determined|described)|self[- ]explanatory|work in progress|coming soon|lorem ipsum.*"
    r"|(?:no|needs?) (?:docs?|documentation|description)(?: yet)?)$"
)
_POINTER = re.compile(
    r"(?i)^(?:see\b.*|cf\b.*|refer(?:s)? to\b.*|same as\b.*|as (?:in|for)\b.*|like\b.{0,40}|ditto|idem|inherit(?:s|ed)?\b.*|inherit ?doc.*|overrides?\b.{0,60}|overridden\b.{0,60}|implements\b.{0,40}"
    r"|(?:documented|described|explained|defined|specified)\b.{0,12}\b(?:in|at|elsewhere|by|above|below|on)\b.*|documentation (?:in|at|see)\b.*|copied from\b.*|alias (?:of|for)\b.*|https?://\S+)$"
)
_SECTION = re.compile(
    r"(?i)^(?:args?|arguments?|param(?:eter)?s?|other parameters|keyword arg(?:ument)?s|returns?|yields?|raises?|throws?|errors?|panics?|safety|examples?|notes?|warnings?|see also|references|attributes|usage|todo)\s*:?$"
)
_TAG = re.compile(r"^(?:[@\\](?P<at>\w+)|:(?P<colon>[\w ]+?)\s*(?P<arg>[\w.*]+)?\s*:)\s*(?P<rest>.*)$", re.S)
_NAMED_TAGS = {"param", "arg", "argument", "parameter", "property", "prop", "keyword", "key", "raises", "raise", "throws", "exception", "except", "typeparam", "template", "var", "ivar"}
_EMPTY_TAGS = {"see", "author", "since", "version", "link", "override", "deprecated", "type", "rtype", "inheritdoc", "private", "public", "protected", "internal", "async", "static", "readonly", "access", "memberof", "module", "suppress", "hidden", "ignore", "test", "todo"}
_FILLER = frozenset(
    "a an the this that these it its is are was be of for to in on and or with by from as method function func fn test tests testing class "
    "constructor getter setter helper routine procedure implementation implements implement does do performs perform which simply just here def".split()
)


def _stem(word: str) -> str:
    for tail in ("ing", "ies", "es", "ed", "s"):
        if word.endswith(tail) and len(word) - len(tail) >= 3:
            word = word[: -len(tail)]
            break
    return word[:-1] if len(word) > 3 and word.endswith("e") else word


def _name_words(name: str) -> set[str]:
    got = {_stem(w.lower()) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+", name)}
    return got | {_stem(name.lower()), _stem(name.lower().replace("_", ""))}


def describes(doc: str | None, name: str, parameters=()) -> bool:
    """Whether documentation says something about the unit ``name``.

    Taken away first: markup, section heads, tags with their parameter names
    and types, tool directives, TODO remarks, pointers to elsewhere and
    placeholders.  What is left must have a word that isn't one of the unit's
    own name or a mere connective.
    """
    if not doc:
        return False
    known = _name_words(name or "")
    numpy_section, previous = False, ""
    pieces = []
    for raw in doc.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = re.sub(r"</?[A-Za-z][^<>]*>|\{@(?:code|literal|link|linkplain)\s+([^{}]*)\}", r" \1 ", raw)
        if re.fullmatch(r"[\s{}]*@?inherit-?doc[\s{}.]*", line, re.I):
            continue
        line = line.strip().strip("`*_~").strip()
        if re.fullmatch(r"[\W_]*", line):
            if re.fullmatch(r"-{3,}|={3,}", line) and _SECTION.match(previous):
                numpy_section = bool(re.match(r"(?i)(?:other )?param|arg|attr|return|yield|rais", previous))
            previous = line
            pieces.append("")
            continue
        previous = line
        if _SECTION.match(line):
            numpy_section = False
            pieces.append("")
            continue
        if _DIRECTIVE.match(line):
            continue
        m = _TAG.match(line)
        if m:
            tag, rest = (m["at"] or m["colon"].strip()).lower(), m["rest"]
            if tag in _EMPTY_TAGS:
                continue
            if m["at"]:
                rest = re.sub(r"^\{[^{}]*\}\s*", "", rest)
                if tag in _NAMED_TAGS:
                    rest = re.sub(r"^\[?[\w.$<>=\]]+\s*(?:-\s+)?", "", rest)
            pieces.append("\n" + rest)
            continue
        m = re.match(r"^\*{0,2}(\w+)\s*(\([^()]*\))?\s*:\s*(.*)$", line)
        if m and (m[1] in parameters or numpy_section or not m[3]):
            if numpy_section and m[3] and re.fullmatch(r"[\w.\[\], |]+", m[3]) and len(m[3].split()) <= 3:
                continue
            pieces.append("\n" + m[3])
            continue
        if line in parameters:
            continue
        pieces.append(line)
    text = "\n".join(pieces)
    kept = []
    for block in re.split(r"\n\s*\n", text):
        for sentence in re.split(r"(?<=[.!?])\s+|\n(?=\n)", " ".join(block.split())):
            sentence = _TODO.sub("", sentence).strip()
            bare = sentence.strip(" .!?:;,-*#`\"'()[]<>{}")
            if not bare or _PLACEHOLDER.match(bare) or _POINTER.match(bare):
                continue
            kept.append(bare)
    words = re.findall(r"[^\W\d_]+(?:_[^\W_]+)*", " ".join(kept))
    for w in words:
        parts = _name_words(w) if "_" in w or re.search(r"[a-z][A-Z]", w) else {_stem(w.lower())}
        if len(w) > 1 and w.lower() not in _FILLER and not parts <= known and not (parts & known and ("_" in w or w != w.lower() and w[1:] != w[1:].lower())):
            return True
    return False


def pair_of(content: str, language: str, name: str, docstring: str | None = None):
    """(documentation, signature) of the definition that ``content`` begins with, or None if its documentation says nothing.

    The content is read by the island grammar of its language as a file is; what
    counts is the island that begins where the text does.
    """
    first = min(islands(content, language), key=lambda x: x[3], default=None)
    if first is None or content[: first[3]].strip() and language != "python":
        return None
    _, doc, signature, *_ = first
    parameters = frozenset(re.findall(r"\w+", signature.partition("(")[2]))
    for text in (doc, docstring) if language == "python" else (doc,):
        if text and describes(text, name, parameters):
            return text.strip(), signature
    return None


# -- islands of a whole file --------------------------------------------------

_CONTROL = re.compile(r"^(?:if|for|while|switch|catch|with|return|else|do|try|new|throw|match|loop|select|synchronized|unsafe|finally|case|await|yield|super|this)\b")
_HEADS = {
    "go": re.compile(r"^func\s*(?:\([^()]*\)\s*)?(\w+)\s*[\[(]"),
    "rust": re.compile(r"^(?:[\w()\"\s:]*\s)?fn\s+(\w+)"),
    "javascript": re.compile(r"^(?:export\s+|default\s+|async\s+|static\s+|get\s+|set\s+|\*\s*)*(?:function\s*\*?\s*)?(#?[\w$]+)\s*\("),
    "typescript": re.compile(r"^(?:export\s+|default\s+|declare\s+|async\s+|static\s+|public\s+|private\s+|protected\s+|readonly\s+|abstract\s+|override\s+|get\s+|set\s+|\*\s*)*(?:function\s*\*?\s*)?(#?[\w$]+)\s*[<(]"),
    "java": re.compile(r"^(?:[\w.<>,\[\]?&\s]+\s)?([\w$]+)\s*\("),
}


def islands(text: str, language: str):
    """``(name, documentation, signature, begin, end)`` of every function in a file, by code-point offsets."""
    return list(_python_islands(text) if language == "python" else _brace_islands(text, language))


#: What holds bodiless functions: types, and what may stand before such a function elsewhere.
_TYPE = re.compile(r"\b(?:class|interface|trait|impl|enum|record)\b")
_BARE = re.compile(r"\b(?:function|fn|func|abstract|native|declare)\b")
#: A function expression bound to a name.
_BOUND = re.compile(r"^(?:(?:export|default|const|let|var|static|public|private|protected|readonly|override)\s+)*(#?[\w$]+)\s*(?::[^=]*(?:=>[^=]*)?)?=\s*(?:async\b\s*)?(?:function\b|\(|[\w$]+\s*=>|<)")


def _brace_islands(text: str, language: str):
    """Functions with a body end at its closing bracket (at the end of a text that lacks it); those without one at the semicolon or line end."""
    pattern, head_of, opened, start, code = languages.language(language).pattern, _HEADS[language], [], None, None
    depth, found, scripts = 0, [], language in ("javascript", "typescript")

    def entry_of(end: int, bare: bool):
        comments, signature, at = _brace_head(text[start:end], pattern)
        got = None if _CONTROL.match(signature) else head_of.match(signature)
        if got and at == end - start:
            inside = bool(opened) and opened[-1][2]
            if not bare or inside or _BARE.search(signature):
                return got.group(1), uncomment(comments), signature, start
        if scripts and not _CONTROL.match(signature):
            whole = text[code:end].strip()
            got = _BOUND.match(whole)
            if got and ("=>" in whole or "function" in whole) and (not bare or "=>" in whole):
                return got.group(1), uncomment(comments), whole.removesuffix("=>").strip(), start
        return None

    for m in pattern.finditer(text):
        t = m.group()
        if t[0] == "\n":  # only tokens of languages where a line may end a statement
            if depth <= 0 and code is not None and text[code] != "@":
                if opened and opened[-1][2] and language == "go" and re.match(r"\w+\s*\(", text[code:]):  # a method of an interface
                    comments, signature, _ = _brace_head(text[start : m.start()], pattern)
                    found.append((signature.partition("(")[0].strip(), uncomment(comments), signature, start, m.start()))
                start = code = None
            continue
        if t.startswith(("//", "/*")):
            if start is None:
                start = m.start()
            continue
        if code is None:
            code = m.start()
        if t in ("(", "["):
            depth += 1
        elif t in (")", "]"):
            depth -= 1
        elif t == "{":
            entry = entry_of(m.start(), False) if depth <= 0 and start is not None else None
            opened.append((entry, depth, entry is None and depth <= 0 and bool(_TYPE.search(text[code : m.start()])), start, code))
            depth, start, code = 0, None, None
        elif t == "}":
            if opened:
                entry, depth, _, start, code = opened.pop()
                if entry:
                    found.append((*entry, m.end()))
            if depth <= 0:  # else a literal within the brackets of a head that goes on
                start = code = None
        elif t == ";" and depth <= 0:
            if start is not None and code is not None:
                entry = entry_of(m.start(), True)
                if entry:
                    found.append((*entry, m.end()))
            start = code = None
        elif start is None and depth <= 0:
            start = m.start()
    found += [(*entry, len(text)) for entry, *_ in opened if entry]
    return sorted(found, key=lambda x: x[3])


def _python_islands(text: str):
    flat = text.replace("\r\n", "\n").replace("\r", "\n")
    starts, depth, at_line = [], 0, True
    for m in _PY_TOKEN.finditer(flat):
        t = m.group()
        if t == "\n":
            at_line = at_line or depth <= 0
        elif t in "([{":
            depth, at_line = depth + 1, False
        elif t in ")]}":
            depth, at_line = max(0, depth - 1), False
        elif not t.isspace() and not t.startswith("#"):
            if at_line and depth <= 0:
                column = m.start() - (flat.rfind("\n", 0, m.start()) + 1)
                starts.append((m.start(), column, _PY_DEF.match(flat, m.start())))
            at_line = False
    for i, (begin, column, d) in enumerate(starts):
        if d:
            end = next((b for b, c, _ in starts[i + 1 :] if c <= column), len(flat))
            doc, signature, _ = _python_head(flat[begin:end])
            yield d.group(1), doc or "", signature, begin, begin + len(flat[begin:end].rstrip())


# -- operators ----------------------------------------------------------------

_PAIR = "unit_id string, name string, language string, signature string, documentation string"


def _pair_batches(batches):
    import pyarrow as pa

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:4]]
        rows = []
        for unit, name, language, doc, content in zip(*columns, batch.column(4)):
            got = pair_of(content.as_py(), language, name, doc)
            if got:
                rows.append((unit, name, language, got[1], got[0]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], ["unit_id", "name", "language", "signature", "documentation"])


def documented_units(units: DataFrame) -> DataFrame:
    """``(unit_id, name, language, signature, documentation)`` of documented functions, methods and tests.

    The documentation is the docstring of a Python unit (its content's, else
    the column's), elsewhere the comment directly before the definition.
    Units without content, or whose documentation says nothing (see
    :func:`describes`), are left out; contents are read by the same islands as
    whole files, bodies balanced and other code skipped; the language is that of the path's
    extension, other extensions are left out.  Repeated rows may repeat a pair;
    null names count as empty.  Nothing is shuffled.
    """
    rows = units.where("node_type in ('function', 'method', 'test') and unit_id is not null and trim(content) <> ''")
    rows = rows.select("unit_id", F.coalesce("name", F.lit("")).alias("name"), _language_of(F.col("path")).alias("language"), "docstring", "content")
    return rows.where("language is not null and language <> 'json'").mapInArrow(_pair_batches, _PAIR)


def _island_batches(batches):
    import pyarrow as pa

    names = ["path", "name", "signature", "documentation", "begin", "end"]
    for batch in batches:
        rows = []
        for path, language, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            for name, doc, signature, begin, end in islands(content.as_py(), language):
                if describes(doc, name, frozenset(re.findall(r"\w+", signature.partition("(")[2]))):
                    rows.append((path, name, signature, doc.strip(), begin, end))
        kinds = [pa.string()] * 4 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def documented_functions(files: DataFrame) -> DataFrame:
    """``(path, name, signature, documentation, begin, end)`` of the documented functions in whole source files.

    ``begin`` and ``end`` are offsets of the function with its comment; Python
    texts count a CRLF as one character.  Damaged files give the islands that can be told.
    """
    rows = files.select("path", _language_of(F.col("path")).alias("language"), "content")
    rows = rows.where("path is not null and content is not null and language is not null and language <> 'json'")
    return rows.mapInArrow(_island_batches, "path string, name string, signature string, documentation string, `begin` int, `end` int")
