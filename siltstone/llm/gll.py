"""Generalised LL recognition over graph-structured stacks, with memoised steps.

A grammar is compiled to a recursive transition network.  Recognition keeps
*all* live descriptors ``(slot, stack node)`` of one input position together:
a call of a nonterminal made at a position is one shared stack node whose
edges are the return slots of every caller (the graph-structured stack), and
a pop continues along every edge.  Nothing is predicted away, so ambiguous
and non-LL(k) grammars are fine; left recursion is written as iteration.

Two properties make it fast enough for a corpus:

* Stack nodes are hash-consed once a position is finished, so the descriptor
  set of a position has a canonical form.  The step "descriptor set x token
  -> descriptor set" is then a pure function and is memoised in a dict that
  lives as long as the worker process.
* A bracket pair always belongs to one production, so the content of a pair
  is recognised on a level of its own: the outer descriptor set asks which
  bodies it could accept, the inner level reports which of them it derived.
  Stacks therefore never grow with nesting and descriptor sets recur.

After warm-up one token costs one dict look-up.  Several dialects are merged
into one network (each with its own start symbol) and run in the same pass.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"\s+|(?P<lit>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[:;|()*+?])")


class Reject(Exception):
    """No descriptor survives the token."""


class Network:
    """Transition network of one or more dialect grammars."""

    def __init__(self, dialects: dict[str, tuple[str, str]], brackets: dict[str, str], soft=(), words=(), wild=()):
        """``dialects``: name -> (grammar text, start rule). ``brackets``: open -> close.

        ``soft``: contextual keywords, which a NAME terminal matches too.
        ``words``: reserved words, which only an IDNAME terminal matches.
        """
        self.brackets = brackets
        self.kinds: dict[str, int] = {}
        for b in brackets:
            self.kind(b)
        for b in dict.fromkeys(brackets.values()):
            self.kind(b)
        self.n_open = len(brackets)
        self.n_close = len(self.kinds)
        self.soft, self.words = tuple(soft), tuple(words)
        for w in (*self.soft, *self.words):
            self.kind(w)
        self.term: list[dict[int, list[int]]] = []
        self.calls: list[list[tuple[int, int]]] = []
        self.eps: list[list[int]] = []
        self.groups: list[list[tuple[int, int, int]]] = []
        self.rules: dict[str, int] = {}
        self.entry: list[int] = []
        self.final: set[int] = set()
        self._later: list = []
        self.starts = {}
        for name, (text, start) in dialects.items():
            self._prefix = name + "/"
            self._grammar(text)
            self.starts[name] = self.rules[self._prefix + start]
        any_kinds = [k for k in self.kinds.values() if k >= self.n_close]
        for edges in self.term:  # the wildcard, once every kind is known
            for to in edges.pop(-9, ()):
                for k in any_kinds:
                    edges.setdefault(k, []).append(to)
        self.pure = [
            s in self.final and not (self.term[s] or self.calls[s] or self.eps[s] or self.groups[s])
            for s in range(len(self.term))
        ]

    def kind(self, name: str) -> int:
        return self.kinds.setdefault(name, len(self.kinds))

    def _state(self) -> int:
        self.term.append({})
        self.calls.append([])
        self.eps.append([])
        self.groups.append([])
        return len(self.term) - 1

    def _rule(self, name: str) -> int:
        if name not in self.rules:
            self.rules[name] = len(self.entry)
            self.entry.append(self._state())
        return self.rules[name]

    def _grammar(self, text: str) -> None:
        for body in re.split(r";;", text):
            if not body.strip():
                continue
            name, _, rest = body.partition(":=")
            toks = [m for m in _LEX.finditer(rest) if m.lastgroup]
            self._define(name.strip(), toks)
        while self._later:
            name, toks = self._later.pop()
            self._define(name, toks)

    def _define(self, name: str, toks: list) -> None:
        at = self.entry[self._rule(self._prefix + name)]
        end, pos = self._alt(toks, 0, at)
        assert pos == len(toks), (name, pos, [t.group() for t in toks])
        self.final.add(end)

    def _alt(self, toks, pos, at):
        out = self._state()
        while True:
            end, pos = self._seq(toks, pos, at)
            self.eps[end].append(out)
            if pos < len(toks) and toks[pos].group() == "|":
                pos += 1
                continue
            return out, pos

    def _seq(self, toks, pos, at):
        while pos < len(toks) and toks[pos].group() not in ("|", ")"):
            begin = self._state()
            self.eps[at].append(begin)
            end, pos = self._item(toks, pos, begin)
            mark = toks[pos].group() if pos < len(toks) else ""
            if mark in ("*", "+", "?"):
                pos += 1
                out = self._state()
                self.eps[end].append(out)
                if mark != "+":
                    self.eps[begin].append(out)
                if mark != "?":
                    self.eps[end].append(begin)
                end = out
            at = end
        return at, pos

    def _item(self, toks, pos, at):
        t = toks[pos].group()
        if t == "(":
            end, pos = self._alt(toks, pos + 1, at)
            assert toks[pos].group() == ")"
            return end, pos + 1
        end = self._state()
        if t[0] == "'":
            lit = t[1:-1]
            if lit in self.brackets:
                close, depth, k = "'" + self.brackets[lit] + "'", 1, pos + 1
                while True:
                    g = toks[k].group()
                    depth += (g == t) - (g == close)
                    if not depth:
                        break
                    k += 1
                body = toks[pos + 1 : k]
                name = lit + " ".join(x.group() for x in body)
                if self._prefix + name not in self.rules:
                    self._rule(self._prefix + name)
                    self._later.append((name, body))
                self.groups[at].append((self.kind(lit), self.rules[self._prefix + name], end))
                return end, k + 1
            self.term[at].setdefault(self.kind(lit), []).append(end)
        elif t == "ANY":
            self.term[at].setdefault(-9, []).append(end)
        elif t.isupper():
            kinds = [self.kind(t)] if t != "IDNAME" else [self.kind("NAME"), *map(self.kind, self.words)]
            if t in ("NAME", "IDNAME"):
                kinds += map(self.kind, self.soft)
            for k in kinds:
                self.term[at].setdefault(k, []).append(end)
        else:
            self.calls[at].append((self._rule(self._prefix + t), end))
        return end, pos + 1


class Level(dict):
    """The descriptor set of one position on one bracket level, and its known steps."""

    __slots__ = ("items", "accepted", "machine", "_end")

    def __init__(self, machine, items, accepted):
        super().__init__()
        self.machine, self.items, self.accepted, self._end = machine, items, accepted, None

    def __missing__(self, key):
        got = self.machine.step(self, key)
        self[key] = got
        return got

    def end(self):
        """Bodies derived if the level ends here; an end also counts as ``eos``."""
        if self._end is None:
            acc, eos = set(self.accepted), self.machine.eos
            if eos is not None:
                try:
                    acc |= self[eos].accepted
                except Reject:
                    pass
            self._end = frozenset(acc)
        return self._end


class Machine:
    """Memoised recogniser of a network."""

    def __init__(self, net: Network, eos: str | None = None, newline: str | None = None):
        self.net = net
        self.eos = net.kinds.get(eos) if eos else None
        self.newline = net.kinds.get(newline) if newline else None
        self.nodes: dict = {}
        self.levels: dict = {}
        self.accepted: frozenset = frozenset()
        self.close_of = {net.kinds[o]: net.kinds[c] for o, c in net.brackets.items()}

    def node(self, edges: frozenset):
        """Hash-consed stack node; an edge is (return slot, node), a root is a rule number."""
        return self.nodes.setdefault(edges, edges)

    def start(self, rules: frozenset) -> Level:
        return self.closure([(self.net.entry[r], r) for r in sorted(rules)], ())

    def closure(self, todo, kept) -> Level:
        net = self.net
        term, calls, eps, groups, final, pure = net.term, net.calls, net.eps, net.groups, net.final, net.pure
        todo = list(todo)
        seen = set(todo)
        local: dict[int, set] = {}  # called rule -> edges; a local node is the tuple ("@", rule)
        popped: set[int] = set()
        kernel, accepted = set(kept), set()

        def add(item):
            if item not in seen:
                seen.add(item)
                todo.append(item)

        while todo:
            slot, node = todo.pop()
            if term[slot] or groups[slot]:
                kernel.add((slot, node))
            for to in eps[slot]:
                add((to, node))
            for rule, back in calls[slot]:
                edges = local.get(rule)
                if edges is None:
                    edges = local[rule] = set()
                    add((net.entry[rule], ("@", rule)))
                if pure[back] and isinstance(node, frozenset):
                    new = node - edges  # a tail call needs no stack node of its own
                else:
                    new = {(back, node)} - edges
                edges |= new
                if rule in popped:
                    for e in new:
                        add(e)
            if slot in final:
                if isinstance(node, int):
                    accepted.add(node)
                elif isinstance(node, frozenset):
                    for e in node:
                        add(e)
                else:
                    popped.add(node[1])
                    for e in list(local[node[1]]):
                        add(e)
        frozen: dict = {}

        def freeze(node):
            if not (isinstance(node, tuple) and node[0] == "@"):
                return node
            got = frozen.get(node)
            if got is None:
                frozen[node] = None
                got = frozen[node] = self.node(frozenset((b, freeze(n)) for b, n in local[node[1]]))
            return got

        items = frozenset((s, freeze(n)) for s, n in kernel)
        acc = frozenset(accepted)
        got = self.levels.get((items, acc))
        if got is None:
            got = self.levels[(items, acc)] = Level(self, items, acc)
        return got

    def step(self, level: Level, key):
        net = self.net
        if isinstance(key, tuple):
            close, derived = key
            todo = [
                (to, node)
                for slot, node in level.items
                for opened, rule, to in net.groups[slot]
                if rule in derived and self.close_of[opened] == close
            ]
        elif key < net.n_open:
            rules = frozenset(rule for slot, _ in level.items for opened, rule, _ in net.groups[slot] if opened == key)
            if not rules:
                raise Reject
            return self.start(rules)
        else:
            todo = [(to, node) for slot, node in level.items for to in net.term[slot].get(key, ())]
            if key == self.newline:  # a line end may always be plain white space
                got = self.closure(todo, level.items)
                if not level.accepted <= got.accepted:
                    acc = got.accepted | level.accepted
                    got = self.levels.setdefault((got.items, acc), Level(self, got.items, acc))
                return got
        if not todo:
            raise Reject
        return self.closure(todo, ())

    def run(self, kinds, rules: frozenset) -> int:
        """-1 if some start rule derives the tokens (``accepted`` are those that do), else the index of the first bad one."""
        n_open, n_close = self.net.n_open, self.net.n_close
        cur, outer, i = self.start(rules), [], -1
        try:
            for i, k in enumerate(kinds):
                if k >= n_close:
                    cur = cur[k]
                elif k < 0:
                    return i
                elif k < n_open:
                    outer.append(cur)
                    cur = cur[k]
                else:
                    if not outer:
                        return i
                    cur = outer.pop()[(k, cur._end or cur.end())]
        except Reject:
            return i
        if not outer and cur.end() & rules:
            self.accepted = cur.end() & rules
            return -1
        return i + 1
