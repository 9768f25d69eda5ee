"""String similarities without a native counterpart, as Arrow-batched UDFs."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F


def sequence_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity 0..1."""
    return SequenceMatcher(None, a, b).ratio()


def best_ratio_udf(terms: list[str]):
    """Column function: the best :func:`sequence_ratio` of a name against fixed terms."""
    matchers = []

    @F.pandas_udf("double")
    def best(names: pd.Series) -> pd.Series:
        if not matchers:
            matchers.extend(terms)
        memo: dict[str, float] = {}
        for n in names.dropna().unique():
            memo[n] = max((sequence_ratio(t, n) for t in terms), default=0.0)
        return names.map(memo).fillna(0.0)

    return best.asNondeterministic()  # so that no plan evaluates it twice


def _indel(a: str, b: str) -> float:
    """Normalised insert-delete similarity 0..100 (twice the longest common subsequence over both lengths)."""
    if not a or not b:
        return 0.0 if a or b else 100.0
    if len(a) < len(b):
        a, b = b, a
    # bit-parallel longest common subsequence (Hyyro 2004)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(b) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def _partial(a: str, b: str) -> float:
    """Best similarity of the shorter string with any window of its length in the longer.

    A window is scored only if the letters it shares with the string, kept up
    as the window slides, allow for more than the best so far.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    m, best, shared = len(a), 0.0, 0
    left = Counter(a)
    for i in range(len(b) + m - 1):  # the window ends before i + 1
        if i < len(b):
            c = b[i]
            shared += left[c] > 0
            left[c] -= 1
        if i >= m:
            c = b[i - m]
            left[c] += 1
            shared -= left[c] > 0
        if 200.0 * shared / (m + min(i + 1, len(b)) - max(0, i + 1 - m)) > best:
            best = max(best, _indel(a, b[max(0, i + 1 - m) : i + 1]))
    return best


def _tokens(s: str) -> list[str]:
    return sorted(s.split())


def _token_ratio(a: str, b: str) -> float:
    """Best of the sorted-token similarity and the set similarity (common tokens against each side)."""
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [_indel(" ".join(_tokens(a)), " ".join(_tokens(b))), _indel(one, two)]
    if both:
        scores += [_indel(both, one), _indel(both, two)]
    return max(scores)


def _partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    one, two = (" ".join(_tokens(a)), " ".join(_tokens(b))), (" ".join(sorted(x)), " ".join(sorted(y)))
    return _partial(*one) if one == two else max(_partial(*one), _partial(*two))


def weighted_ratio(a: str, b: str) -> float:
    """Weighted combination of whole, partial and token similarities, 0..100.

    Own implementation of the published scheme: token scores count 0.95; once
    one string is 1.5 times as long, partial scores count 0.9, beyond 8 times 0.6.
    """
    if not a or not b:
        return 0.0
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    whole = _indel(a, b)
    if ratio < 1.5:
        return max(whole, 0.95 * _token_ratio(a, b))
    scale = 0.9 if ratio <= 8 else 0.6
    return max(whole, scale * _partial(a, b), 0.95 * scale * _partial_token_ratio(a, b))


def weighted_ratio_udf(query: str):
    """Column function: :func:`weighted_ratio` of a fixed query with a text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        memo = {t: weighted_ratio(query, t) for t in texts.dropna().unique()}
        return texts.map(memo).fillna(0.0)

    return score.asNondeterministic()


# -- Porter's algorithm (Porter 1980) -----------------------------------------

_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or c == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def porter_stem(word: str) -> str:
    """Stem of a lower-case word."""
    w = word
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
