from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from siltstone.llm import cooccur as C
from siltstone.llm import neighbors as N


def brute(baskets, least, lift):
    kept = {k: sorted(v) for k, v in baskets.items() if 1 <= len(v) <= 50}
    n_item = Counter(i for v in kept.values() for i in v)
    n_scope = Counter(s for v in kept.values() for s in {i.split("/")[0] for i in v})
    pairs = Counter(p for v in kept.values() for p in combinations(v, 2) if p[0].split("/")[0] == p[1].split("/")[0])
    return {p: n for p, n in pairs.items() if n >= least and n * n_scope[p[0].split("/")[0]] >= lift * n_item[p[0]] * n_item[p[1]]}


@pytest.mark.parametrize("heavy, block", [(1 / 8, 16), (1 / 64, 8192), (0.0, 8192), (2.0, 50)])
def test_pairs_against_brute_force(spark, heavy, block):
    rng = np.random.default_rng(5)
    rows, sets = [], {}
    for i in range(300):
        scope = "hot" if i % 3 else "cold"
        k = int(rng.integers(0, 60 if i % 40 == 0 else 7))
        items = [f"{scope}/{int(x)}" for x in rng.zipf(1.4, k) % 40] + (["cold/x"] if i % 25 == 0 else [])
        if i % 4 == 0:
            items += [f"{scope}/pair_a", f"{scope}/pair_b"][: 1 + (i % 12 > 0)]
        sets[f"c{i}"] = set(items)
        dirty = [x.replace("/", "\\") if j % 5 == 0 else f" ./{x}" if j % 7 == 0 else x for j, x in enumerate(items)] + [None, "", " "][: i % 4]
        rows.append((f"c{i}", dirty))
        if i % 10 == 0:
            rows.append((f"c{i}", list(reversed(items))))
    rows += [("empty", []), ("null", None), (None, ["hot/1", "hot/2"])]
    df = spark.createDataFrame(rows, "commit_hash string, changed_files array<string>")
    want = brute(sets, 3, 1.5)
    got = {(r.item_a, r.item_b): r.n_ab for r in C.pair_lift(df, min_support=3, min_lift=1.5, heavy=heavy, block=block).collect()}
    assert got == want and want
    assert C.pair_lift(df.where("false")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "unit_id string, provider string, content_hash string, dimensions int, vector array<float>")


def make(rng, n, dim=32):
    base = rng.normal(size=(n, dim))
    near = base[: n // 3] + rng.normal(size=(n // 3, dim)) * 0.25
    return np.vstack([base, near]).astype(np.float32)


def exact(ids, x, k):
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    return {ids[i]: sorted(((-s[i, j], ids[j]) for j in range(len(ids)) if j != i))[:k] for i in range(len(ids))}


def test_recall_and_exact_pairs(spark):
    rng = np.random.default_rng(1)
    x = make(rng, 1500)
    ids = [f"u{i:05d}" for i in range(len(x))]
    df = vectors(spark, [(i, "p", "h", 32, v.tolist()) for i, v in zip(ids, x)])
    want = exact(ids, x, 5)
    got = {}
    for r in N.most_similar(df, 5, probes=90, shortlist=32).collect():
        got.setdefault(r.unit_id, set()).add(r.other_id)
    recall = np.mean([len(got.get(i, set()) & {o for _, o in want[i]}) / 5 for i in ids])
    assert recall >= 0.9, recall
    pairs = {(r.unit_id_a, r.unit_id_b) for r in N.similar_pairs(df, 5, 0.8, probes=30).collect()}
    truth = {tuple(sorted((i, o))) for i in ids for s, o in want[i] if -s >= 0.8}
    assert len(pairs & truth) >= 0.97 * len(truth) and not pairs - truth


def test_copies_dirt_and_hot_lists(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = make(rng, 60, 8)
    rows = [(f"u{i:03d}", "p", "h", 8, v.tolist()) for i, v in enumerate(x)]
    hot = x[0].tolist()
    rows += [(f"copy{i:03d}", "p", "h", 8, hot) for i in range(40)] + rows[:5]  # a third are copies; repeated rows
    rows += [("null", "p", "h", 8, None), ("short", "p", "h", 8, [1.0]), ("zero", "p", "h", 8, [0.0] * 8), ("nan", "p", "h", 8, [float("nan")] + [1.0] * 7), ("inf", "p", "h", 8, [float("inf")] + [1.0] * 7), (None, "p", "h", 8, hot), ("q1", "other", "h", 8, hot)]
    df = vectors(spark, rows)
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "CHUNK", 5)
    found = N.most_similar(df, 5, probes=50).collect()
    good = {r[0]: np.array(r[4], np.float32) for r in rows if r[0] and r[1] == "p" and r[0] not in ("null", "short", "zero", "nan", "inf")}
    ids = sorted(good)
    want = exact(ids, np.array([good[i] for i in ids]), 5)
    got = {}
    for r in found:
        got.setdefault(r.unit_id, []).append((r.rank, r.other_id))
    assert set(got) == set(ids)  # the vector alone in its provider has no neighbour
    for i in ids:
        assert [o for _, o in sorted(got[i])] == [o for _, o in want[i]], i
    assert N.most_similar(df.where("false"), 5).count() == 0


@pytest.mark.parametrize("spread", [0.1, 0.0])
def test_near_and_rescaled_copies_in_one_cloud(spark, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[1000:] = (x[0] + rng.normal(size=(500, 32)) * spread) * rng.uniform(0.5, 2, (500, 1))  # a third of the rows
    x = x.astype(np.float32).astype(np.float64)  # norms in full precision
    ids = [f"u{i:05d}" for i in rng.permutation(len(x))]
    want, got = exact(ids, x, 5), {}
    for r in N.most_similar(vectors(spark, [(i, "p", "h", 32, v.tolist()) for i, v in zip(ids, x)]), 5, probes=90).collect():  # all lists probed
        got.setdefault(r.unit_id, []).append((r.rank, r.similarity))
    for i in ids:
        assert [s for _, s in sorted(got[i])] == pytest.approx([-s for s, _ in want[i]], abs=1e-9), i


def test_shortlists_in_a_near_copy_cloud(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x[2000:] = x[0] + rng.normal(size=(1000, 32)) * 0.1  # a third of the rows
    ids = [f"u{i:05d}" for i in rng.permutation(len(x))]
    x = x.astype(np.float32)
    want, got = exact(ids, x, 5), {}
    for r in N.most_similar(vectors(spark, [(i, "p", "h", 32, v.tolist()) for i, v in zip(ids, x)]), 5, probes=40, shortlist=32).collect():
        got.setdefault(r.unit_id, set()).add(r.other_id)
    cloud = ids[2000:]
    assert np.mean([len(got[i] & {o for _, o in want[i]}) / 5 for i in cloud]) >= 0.9


def test_providers_of_two_lengths_and_clashing_columns(spark):
    rows = [(f"a{i}", "p", "h", 4, [float(i), 1.0, 0.0, 2.0]) for i in range(6)] + [(f"b{i}", "p", "h", 3, [float(i), 1.0, 5.0]) for i in range(6)]
    df = vectors(spark, rows).selectExpr("*", "1 AS space", "2 AS cell", "3 AS raw")
    found = N.most_similar(df, 3, probes=9).collect()
    assert len(found) == 36 and all(r.unit_id[0] == r.other_id[0] and r.provider == "p" for r in found)


def test_late_repositories_of_another_kind(spark):
    rng = np.random.default_rng(4)
    x = np.zeros((8900, 16))
    x[:8500, :8] = rng.normal(size=(8500, 8))
    x[8500:, 8:] = 3 + rng.normal(size=(400, 8)) * 0.3  # the last ids lie in dimensions of their own
    x = x.astype(np.float32).astype(np.float64)
    ids = [f"{'a' if i < 8500 else 'z'}/{i:05d}" for i in range(len(x))]
    want, got = exact(ids[8500:], x[8500:], 5), {}
    df = vectors(spark, [(i, "p", "h", 16, v.tolist()) for i, v in zip(ids, x)])
    for r in N.most_similar(df, 5, probes=40).where("unit_id like 'z/%'").collect():
        got.setdefault(r.unit_id, set()).add(r.other_id)
    assert all(got[i] == {o for _, o in want[i]} for i in want)
