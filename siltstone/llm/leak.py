"""Evaluation texts inside training texts: one word-level Aho-Corasick automaton."""

from __future__ import annotations

import pickle
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a passage that count as a leak.
PASSAGE = 13
#: Passages of one automaton; a larger test set is scanned by several, in one pass over the text.
PER_AUTOMATON = 200_000
#: Distinct test words of one alphabet (characters beyond the controls and surrogates number about 1.1 million).
WORDS = 1_000_000
#: Bytes that the broadcast scanner may have.
MOST_BYTES = 1 << 30

_WORD = re.compile(r"[A-Za-z0-9]+")
_LOWER = bytes(ord(chr(i).lower()) if chr(i).isalnum() and i < 128 else 32 for i in range(256))


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased."""
    return text.encode("ascii", "replace").translate(_LOWER).split()


def _letter(i: int) -> str:
    """The ``i``-th symbol: characters above the blank, without the surrogates."""
    return chr(0x21 + i if i < 0xD000 else 0x10000 + i - 0xD000)


class Scanner:
    """Automata over the passages of test texts.

    Each distinct test word is one symbol, so a passage of 13 words is a key of
    13 symbols and every text word that no test uses is the same blank: the
    automaton stays small and an offset in the symbol string *is* a word number.
    Tests of more than :data:`WORDS` distinct words make several alphabets, each
    with automata of its own.
    """

    def __init__(self, tests: list[tuple[str, str]], passage: int = PASSAGE):
        self.passage, self.parts = passage, []
        symbol: dict[bytes, str] = {}
        keys: dict[str, set] = {}
        for name, text in tests:
            got = words(text)
            if len(symbol) + len(got) > WORDS and keys:
                self._close(symbol, keys)
                symbol, keys = {}, {}
            code = [symbol.setdefault(w, _letter(len(symbol))) for w in got]
            for i in range(len(code) - passage + 1):
                keys.setdefault("".join(code[i : i + passage]), set()).add(name)
        if keys:
            self._close(symbol, keys)

    def _close(self, symbol: dict, keys: dict) -> None:
        import ahocorasick

        automata, todo = [], sorted(keys)
        for at in range(0, len(todo), PER_AUTOMATON):
            a = ahocorasick.Automaton()
            for k in todo[at : at + PER_AUTOMATON]:
                a.add_word(k, tuple(sorted(keys[k])))
            a.make_automaton()
            automata.append(a)
        self.parts.append((symbol, automata))

    def scan(self, text: str) -> dict[str, list[int]]:
        """test name -> last word numbers of its passages in the text."""
        found: dict[str, list[int]] = {}
        got = words(text) if self.parts else ()
        for symbol, automata in self.parts:
            get = symbol.get
            line = "".join([get(w, " ") for w in got])
            for a in automata:
                for end, names in a.iter(line):
                    for n in names:
                        found.setdefault(n, []).append(end)
        return found

    def spans(self, text: str) -> dict[str, tuple[int, int, int]]:
        """test name -> number of passages, and the original offsets from the first to past the last."""
        found = self.scan(text)
        if not found:
            return {}
        at = [m.span() for m in _WORD.finditer(text)]
        return {n: (len(e), at[min(e) - self.passage + 1][0], at[max(e)][1]) for n, e in found.items()}


def find_leaks(documents: DataFrame, tests: DataFrame, *, key: str = "doc_id", text: str = "text", test_key: str = "id",
               test_text: str = "task", passage: int = PASSAGE, max_tests: int = 100_000) -> DataFrame:
    """``(doc_id, task_id, passages, begin, end)``: documents sharing ``passage`` consecutive words with a test.

    The test set is held-out material of fixed size; its scanner is built once
    and broadcast, so its size is checked (``max_tests`` rows and
    :data:`MOST_BYTES`, else ValueError).  Documents are scanned once, whole, without a shuffle; only
    hits are aggregated.  ``begin`` and ``end`` are code-point offsets in the
    original text.  Null texts and keys take no part, tests of fewer words
    than a passage leak nothing, repeated rows count once, and a text
    containing several tests has a row for each.
    """
    kind = dict(documents.dtypes)[key]
    rows = tests.select(F.col(test_key).cast("string").alias("n"), F.col(test_text).alias("t")).where("n is not null and t is not null").distinct().limit(max_tests + 1).collect()
    if len(rows) > max_tests:
        raise ValueError(f"more than {max_tests} tests: raise max_tests only if executors can hold them")
    packed = pickle.dumps(Scanner(sorted((r.n, r.t) for r in rows), passage), protocol=pickle.HIGHEST_PROTOCOL)
    if len(packed) > MOST_BYTES:
        raise ValueError(f"the scanner has {len(packed)} bytes, more than {MOST_BYTES}: split the tests")
    held = documents.sparkSession.sparkContext.broadcast(packed)
    schema = f"{key} {kind}, task_id string, passages int, `begin` int, `end` int"

    def scan(batches):
        import pyarrow as pa

        scanner = pickle.loads(held.value)
        for batch in batches:
            ids, names, counts, starts, ends = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, (c, a, b) in scanner.spans(t.as_py()).items():
                    ids.append(i)
                    names.append(n)
                    counts.append(c)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), *(pa.array(x, pa.int32()) for x in (counts, starts, ends))],
                [key, "task_id", "passages", "begin", "end"],
            )

    docs = documents.select(F.col(key), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    hits = docs.mapInArrow(scan, schema)
    return hits.groupBy(key, "task_id").agg(F.max("passages").alias("passages"), F.min("begin").alias("begin"), F.max("end").alias("end"))


def leaked_tests(leaks: DataFrame) -> DataFrame:
    """Per leaked test: the number of documents that contain it and of passages in them."""
    return leaks.groupBy("task_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("passages").alias("passages"))
