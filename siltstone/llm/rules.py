"""Ordered rule lists by incremental reduced-error pruning (IREP)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">=" or "<="
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.op == ">=" else x <= self.threshold

    def sql(self) -> str:
        return f"{self.feature} {self.op} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(table.values())))
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _grow(table, label, weight, steps: int) -> Rule:
    """Add the condition of largest FOIL gain until no negative is covered."""
    rule: list[Condition] = []
    live = np.ones(len(label), bool)
    while len(rule) < 8:
        p, n = weight[live & label].sum(), weight[live & ~label].sum()
        if not p or not n:
            break
        base, best, found = np.log2(p / (p + n)), 1e-9, None
        for name, x in table.items():
            seen = x[live]
            for t in np.unique(np.quantile(seen, np.linspace(0, 1, steps), method="nearest")):
                for op in (">=", "<="):
                    c = Condition(name, op, round(float(t), 6))
                    hit = live & c.holds(table)
                    p1, n1 = weight[hit & label].sum(), weight[hit & ~label].sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - base)
                        if gain > best:
                            best, found = gain, c
        if found is None:
            break
        rule.append(found)
        live &= found.holds(table)
    return tuple(rule)


def _prune(rule: Rule, table, label, weight) -> tuple[Rule, float]:
    """Drop final conditions while that raises (p - n) / (p + n) on the pruning rows."""
    best, worth = rule, -2.0
    for k in range(len(rule), 0, -1):
        hit = covers(rule[:k], table)
        p, n = weight[hit & label].sum(), weight[hit & ~label].sum()
        v = (p - n) / (p + n) if p + n else -1.0
        if v >= worth:
            best, worth = rule[:k], v
    return best, worth


def induce(table: dict[str, np.ndarray], label: np.ndarray, weight: np.ndarray | None = None, *, seed: int = 11,
           max_rules: int = 12, steps: int = 40, min_share: float = 0.002) -> list[Rule]:
    """Rules for the positive label, in order; rows that none covers are negative.

    Each round splits the remaining rows into growing (2/3) and pruning (1/3)
    rows, grows a rule on the former and prunes it at once on the latter.  It
    ends when a pruned rule is wrong more often than right, or covers less than
    ``min_share`` of the positives.  Deterministic for a given ``seed``.
    """
    label = np.asarray(label, bool)
    weight = np.ones(len(label)) if weight is None else np.asarray(weight, float)
    rng = np.random.default_rng(seed)
    left, rules, total = np.arange(len(label)), [], weight[label].sum()
    while len(rules) < max_rules and label[left].any():
        order = rng.permutation(len(left))
        cut = 2 * len(left) // 3
        grow, prune = left[order[:cut]], left[order[cut:]]
        part = lambda rows: {k: x[rows] for k, x in table.items()}
        rule = _grow(part(grow), label[grow], weight[grow], steps)
        if not rule:
            break
        rule, worth = _prune(rule, part(prune), label[prune], weight[prune])
        hit = covers(rule, part(left))
        if worth <= 0 or weight[left[hit & label[left]]].sum() < min_share * total:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def classify(rules: list[Rule], table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(next(iter(table.values()))), bool)
    for r in rules:
        out |= covers(r, table)
    return out


def to_case(rules: list[Rule]) -> str:
    """The rule list as a SQL CASE expression with value 1 (positive) or 0."""
    if not rules:
        return "0"
    return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN 1" for r in rules) + " ELSE 0 END"
