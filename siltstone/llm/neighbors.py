"""Most similar vectors for every vector: inverted file, product-quantised residuals, exact reranking."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.stage import stage

#: Inverted lists of a provider: so many times the square root of its number of vectors.
LISTS = 2
#: Vectors per provider on which coarse cells and codebooks are fitted, and per list on which its centroid is (all are indexed).
SAMPLE, PER_LIST = 20_000, 32
#: Dimensions of a subspace, and code words of each.
WIDTH, WORDS = 4, 256
#: Lists probed per query: those nearest to the centroid of its own list.
PROBES = 24
#: Members that a block of a list has at most about; queries of a block reranked in one task.
BLOCK, CHUNK = 4096, 8192
#: Queries scored at a time.
SLICE = 256
#: Bytes that the models (centroids and codebooks of all spaces) may have, being broadcast; spaces at most.
MOST_BYTES, MOST_SPACES = 1 << 30, 1000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        held = np.flatnonzero(n)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])[held]
        c[held] = (np.add.reduceat(x[order], starts, axis=0, dtype=np.float64) / n[held, None]).astype(np.float32)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest rows of ``c``, nearest first, in slices of bounded size."""
    k = min(k, len(c))
    norm = (c * c).sum(1) / 2
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 2048):
        d = norm - x[a : a + 2048] @ c.T
        if k == 1:
            out[a : a + 2048, 0] = d.argmin(1)
        else:
            part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(k), (len(d), 1))
            out[a : a + 2048] = np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)
    return out


class Index:
    """Centroids of one provider, and the codebooks of residuals scaled to length 1."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.cuts = np.linspace(0, centroids.shape[1], max(1, centroids.shape[1] // WIDTH) + 1).astype(int)
        self.books: list[np.ndarray] = []

    def _residuals(self, x: np.ndarray):
        home = _nearest(x, self.centroids, 1)[:, 0]
        rest = x - self.centroids[home]
        gain = np.linalg.norm(rest, axis=1)
        return home, rest / np.maximum(gain, 1e-12)[:, None], gain

    def fit_books(self, x: np.ndarray, seed: int = 7) -> list[np.ndarray]:
        rest = self._residuals(x)[1]
        return [_kmeans(np.ascontiguousarray(rest[:, a:b]), WORDS, 6, seed + a) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray):
        """Per row: its list, its code, and (gain / length, 1 / length, cosine) of what the code stands for."""
        home, rest, gain = self._residuals(x)
        parts = list(zip(self.cuts, self.cuts[1:], self.books))
        code = np.stack([_nearest(np.ascontiguousarray(rest[:, a:b]), book, 1)[:, 0].astype(np.uint8) for a, b, book in parts], axis=1)
        back = self.centroids[home] + gain[:, None] * np.hstack([book[code[:, i]] for i, (_, _, book) in enumerate(parts)])
        length = np.maximum(np.linalg.norm(back, axis=1), 1e-12)
        return home, code, np.stack([gain / length, 1 / length, (back * x).sum(1) / length], axis=1).astype(np.float32)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Asymmetric tables: per subspace the products of all code words with all queries."""
        return [book @ q[:, a:b].T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]


def valid_vectors(df: DataFrame) -> DataFrame:
    """``(space, unit_id, vector)`` rows that take part: exactly ``dimensions`` finite values, not all zero; ids not null.

    A space is the vectors of one provider and length (``dimensions|provider``).
    """
    v, inf = F.col("vector"), float("inf")
    rows = df.where("unit_id is not null and provider is not null and vector is not null and size(vector) = dimensions and dimensions > 0")
    # NaN is the largest value; array_contains is null, not false, where an element is
    finite = ~F.isnan(F.array_max(v)) & ~F.array_contains(v, F.lit(inf).cast("float")) & (F.array_min(v) > -inf)
    return rows.where(finite & ((F.array_max(v) != 0) | (F.array_min(v) != 0))).select(F.concat_ws("|", "dimensions", "provider").alias("space"), "unit_id", "vector")


def _matrices(batches, names: tuple):
    """(space, matrix of floats, pandas of the columns ``names``) of each space in Arrow batches of ``(space, vector, ...)``."""
    for batch in batches:
        spaces = np.array(batch.column("space").to_pylist(), object)
        flat = batch.column("vector")
        starts = np.asarray(flat.offsets)[:-1] - flat.offsets[0].as_py()
        values = np.asarray(flat.flatten(), np.float32)
        rest = batch.select(list(names)).to_pandas()
        for s in dict.fromkeys(spaces):
            rows = np.flatnonzero(spaces == s)
            d = int(s.split("|", 1)[0])
            yield s, values[starts[rows][:, None] + np.arange(d)] + np.float32(0), rest.iloc[rows]  # -0 is 0


def _arrow(frames, schema: list[str]):
    import pyarrow as pa

    for f in frames:
        yield pa.RecordBatch.from_pandas(f[schema], preserve_index=False)


def _lists(n: int) -> int:
    return max(1, round(LISTS * n**0.5))


def _fit(rows: DataFrame, sizes: dict[str, int], sample: int) -> dict[str, Index]:
    """Two-level centroids and codebooks of each space of so many rows.

    The sample has about max(``sample``, PER_LIST x lists) rows per space,
    chosen by a hash of the id.  Coarse cells come from ``sample`` of them; each
    cell's lists, as many as its share of the sample, are fitted in a group of
    their own; codebooks are fitted on ``sample`` rows.
    """
    if not sizes:
        return {}
    whole = {s: min(n, max(sample, PER_LIST * _lists(n))) for s, n in sizes.items()}
    share, part = F.lit(0.0), F.lit(0.0)
    for s, n in sizes.items():
        share = F.when(F.col("space") == s, F.lit(whole[s] / n)).otherwise(share)
        part = F.when(F.col("space") == s, F.lit(min(1.0, sample / n))).otherwise(part)
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("unit_id"), F.lit(1_000_000)) / 1_000_000)

    def units(batches):
        return _arrow((f.assign(space=s, raw=[r.tobytes() for r in _unit(x).astype(np.float32)]) for s, x, f in _matrices(batches, ("unit_id", "first"))), ["space", "unit_id", "first", "raw"])

    taken = hashed.where(F.col("h") < share).select("space", "unit_id", "vector", (F.col("h") < part).alias("first"))
    taken = stage(taken.mapInArrow(units, "space string, unit_id string, first boolean, raw binary"), "sample")

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        return _vectors(pdf.sort_values("unit_id")["raw"].to_numpy(dtype=object))

    def coarse(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"space": [key[0]], "model": [pickle.dumps(_kmeans(matrix(pdf), max(1, round(_lists(sizes[key[0]]) ** 0.5)), 6, 7))]})

    first = taken.where("first")
    cells = {r.space: pickle.loads(r.model) for r in first.groupBy("space").applyInPandas(coarse, "space string, model binary").collect()}
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def split(frames):
        for pdf in frames:
            for s, g in pdf.groupby("space", sort=False):
                yield g.assign(cell=_nearest(_vectors(g["raw"].to_numpy(dtype=object)), held.value[s], 1)[:, 0])

    def fine(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n = _lists(sizes[key[0]]) * len(pdf) / whole[key[0]]
        return pd.DataFrame({"space": [key[0]], "cell": [key[1]], "model": [pickle.dumps(_kmeans(matrix(pdf), max(1, round(n)), 6, 7))]})

    spread = taken.select("space", "unit_id", "raw").mapInPandas(split, "space string, unit_id string, raw binary, cell int")
    got = spread.groupBy("space", "cell").applyInPandas(fine, "space string, cell int, model binary").collect()
    models = {s: Index(np.vstack([pickle.loads(r.model) for r in sorted(got, key=lambda r: r.cell) if r.space == s])) for s in cells}
    bare = rows.sparkSession.sparkContext.broadcast(models)

    def books(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"space": [key[0]], "model": [pickle.dumps(bare.value[key[0]].fit_books(matrix(pdf)))]})

    for r in first.groupBy("space").applyInPandas(books, "space string, model binary").collect():
        models[r.space].books = pickle.loads(r.model)
    return models


def indexed(df: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, object]:
    """(classes, members, broadcast models) of a table of vectors.

    Classes ``(space, cell, digest, rep, copies, raw, code, scale)``: a row per
    distinct vector with its list, code and smallest id; members ``(space, cell, digest, unit_id)``: a
    row per id.  Of differing vectors of one id that of the smallest digest
    holds.  Raw vectors are shuffled once, by list, which also brings copies together.
    """
    rows, spark = valid_vectors(df), df.sparkSession
    sizes = rows.groupBy("space").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SPACES + 1).collect()
    sizes = {r.space: r.n for r in sizes}
    weight = sum((_lists(n) + WORDS) * 4 * int(s.split("|", 1)[0]) for s, n in sizes.items())
    if len(sizes) > MOST_SPACES or weight > MOST_BYTES:
        raise ValueError(f"models of {len(sizes)} spaces and {weight} bytes exceed the bound of a broadcast")
    models = spark.sparkContext.broadcast(_fit(rows, sizes, sample))

    def encode(batches):
        def frames():
            for s, x, f in _matrices(batches, ("unit_id",)):
                cell, code, scale = models.value[s].encode(_unit(x).astype(np.float32))
                yield f.assign(space=s, cell=cell, raw=[r.tobytes() for r in x], code=[r.tobytes() for r in code], scale=[r.tobytes() for r in scale])

        return _arrow(frames(), ["space", "unit_id", "cell", "raw", "code", "scale"])

    kind = "space string, unit_id string, cell int, raw binary, code binary, scale binary"
    coded = stage(rows.mapInArrow(encode, kind).withColumn("digest", F.unhex(F.md5("raw"))), "coded")
    key = ["space", "cell", "digest"]
    members = coded.groupBy("space", "unit_id").agg(F.min(F.struct("digest", "cell")).alias("v")).select("space", "v.cell", "v.digest", "unit_id")
    members = stage(members, "members")
    reps = members.groupBy(*key).agg(F.min("unit_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    one = coded.groupBy(*key).agg(*(F.any_value(c).alias(c) for c in ("raw", "code", "scale")))
    return stage(one.join(reps, key), "classes"), members, models


def nearest_classes(classes: DataFrame, models, k: int, min_similarity: float | None = None, *, probes: int = PROBES, shortlist: int | None = None) -> DataFrame:
    """``(space, rep, other, similarity)``: up to ``k`` most similar distinct vectors of each vector.

    Two rounds over blocks of inverted lists.  First a block's vectors, as queries,
    meet each other (exactly) and the codes of the ``probes`` nearest lists:
    asymmetric tables give the cosine with what a code stands for, and the angle
    between that and the member, stored with the code, bounds the true cosine.
    A list block goes on to the second round if one of its members may, by that bound, be
    among the query's ``k`` best and reach ``min_similarity``; with
    ``shortlist``, only if one is also among the query's so many best
    estimates (approximate, for searches without a floor).  Then queries and members of those blocks are scored exactly.

    Queries travel once, codes once per probing list, and raw vectors again only
    to lists that hold a candidate.  A hot list is several blocks, the queries to
    a block several chunks, so no group grows with the data.
    """
    spark = classes.sparkSession
    count = classes.groupBy("space", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    count = stage(count, "blocks")  # a row per list: some square roots of the number of vectors, like all plans below
    placed = classes.join(F.broadcast(count), ["space", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def around(frames):
        for pdf in frames:
            for p, g in pdf.groupby("space", sort=False):
                c = models.value[p].centroids
                near = _nearest(c[g["target"].to_numpy()], c, probes)
                yield pd.DataFrame({"space": p, "target": np.repeat(g["target"].to_numpy(), near.shape[1]), "cell": near.ravel()})

    near = count.select("space", F.col("cell").alias("target")).mapInPandas(around, "space string, target int, cell int")
    targets = count.select("space", F.col("cell").alias("target"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("tblock"))
    near = near.join(F.broadcast(targets), ["space", "target"])

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"space": [key[0]], "cell": [key[1]], "block": [key[2]], "codes": [b"".join(pdf["code"])], "scales": [b"".join(pdf["scale"])]})

    packed = placed.select("space", "cell", "block", "code", "scale").groupBy("space", "cell", "block").applyInPandas(pack, "space string, cell int, block int, codes binary, scales binary")
    packs = stage(packed, "packed").join(near, ["space", "cell"]).where("cell <> target or block <> tblock").select(
        F.col("space").alias("p_space"), "target", "tblock", F.col("cell").alias("p_cell"), F.col("block").alias("p_block"), "codes", "scales")
    floor = -2.0 if min_similarity is None else float(min_similarity)

    def probe(key, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        p, model, out = key[0], models.value[key[0]], []
        if not len(q):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("space", str), ("rep", str), ("other", str), ("similarity", float), ("cell", "Int32"), ("block", "Int32"), ("raw", object))})
        q = q.sort_values("rep")
        reps, raws = q["rep"].to_numpy(dtype=object), q["raw"].to_numpy(dtype=object)
        x = _unit(_vectors(raws))
        x32 = x.astype(np.float32)
        width = len(model.cuts) - 1
        lists = [(c, b, np.frombuffer(codes, np.uint8).reshape(-1, width), np.frombuffer(scales, np.float32).reshape(-1, 3))
                 for c, b, codes, scales in zip(m["p_cell"], m["p_block"], m["codes"], m["scales"])]
        for a in range(0, len(x), SLICE):
            z = x[a : a + SLICE]
            sim = z @ x.T
            sim[np.arange(len(z)), np.arange(a, a + len(z))] = -np.inf
            i, j, s = _top(sim, reps, k, floor)
            out.append(pd.DataFrame({"space": p, "rep": reps[a + i], "other": reps[j], "similarity": s}))
            least = np.partition(sim, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(z), -2.0)
            need = np.maximum(least, floor)[None, :].astype(np.float32)
            side = np.sqrt(np.maximum(0, 1 - need * need))
            tables, estimates = model.tables(x32[a : a + SLICE]), []
            for c, b, code, scale in lists:
                got = np.zeros((len(code), len(z)), np.float32)
                for t in range(width):
                    got += tables[t][code[:, t]]
                got *= scale[:, :1]
                got += scale[:, 1:2] * (x32[a : a + SLICE] @ model.centroids[c])[None, :]
                cos = np.clip(scale[:, 2:3], -1, 1)
                reach = need * cos - side * np.sqrt(1 - cos * cos)  # cosine of the sum of both angles
                may = (got >= reach - 1e-4) | (need <= -cos)
                estimates.append(np.where(may, got, -np.inf) if shortlist else may.any(0))
            if not lists:
                continue
            if shortlist:
                every = np.concatenate(estimates)
                cut = np.partition(every, len(every) - shortlist, axis=0)[len(every) - shortlist] if len(every) > shortlist else np.full(len(z), -np.inf)
                go = np.stack([((e >= cut) & (e > -np.inf)).any(0) for e in estimates])
            else:
                go = np.stack(estimates)
            number, i = np.nonzero(go)
            names = np.array([(c, b) for c, b, *_ in lists], np.int64).reshape(-1, 2)[number]
            out.append(pd.DataFrame({"space": p, "rep": reps[a + i], "cell": names[:, 0], "block": names[:, 1], "raw": raws[a + i]}))
        return pd.concat(out).reindex(columns=["space", "rep", "other", "similarity", "cell", "block", "raw"]).astype({"cell": "Int32", "block": "Int32"})

    queries = placed.select("space", F.col("cell").alias("target"), F.col("block").alias("tblock"), "rep", "raw")
    schema = "space string, rep string, other string, similarity double, cell int, block int, raw binary"
    first = stage(queries.groupBy("space", "target", "tblock").cogroup(packs.groupBy("p_space", "target", "tblock")).applyInPandas(probe, schema), "probed")
    asked = first.where("raw is not null").select("space", "cell", "block", "rep", "raw")
    chunks = asked.groupBy("space", "cell", "block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    chunks = F.broadcast(stage(chunks, "chunks"))
    asked = asked.join(chunks, ["space", "cell", "block"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).drop("chunks")
    members = placed.select("space", "cell", "block", "rep", "raw").join(chunks, ["space", "cell", "block"])
    members = members.select("space", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "rep", "raw")
    members = members.toDF(*(f"m_{c}" for c in members.columns))  # both sides stem from one table

    def rerank(key, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({c: pd.Series(dtype=str) for c in ("space", "rep", "other")} | {"similarity": pd.Series(dtype=float)})
        m = m.sort_values("m_rep")
        x, names, reps, out = _unit(_vectors(m["m_raw"].to_numpy(dtype=object))), m["m_rep"].to_numpy(dtype=object), q["rep"].to_numpy(dtype=object), []
        for a in range(0, len(q), SLICE):
            i, j, s = _top(_unit(_vectors(q["raw"].to_numpy(dtype=object)[a : a + SLICE])) @ x.T, names, k, floor)
            out.append(pd.DataFrame({"space": key[0], "rep": reps[a + i], "other": names[j], "similarity": s}))
        return pd.concat(out)

    keys = ["space", "cell", "block", "chunk"]
    second = asked.groupBy(*keys).cogroup(members.groupBy(*(f"m_{c}" for c in keys))).applyInPandas(rerank, "space string, rep string, other string, similarity double")
    found = first.where("raw is null").select(*second.columns).unionByName(second)
    order = Window.partitionBy("space", "rep").orderBy(F.round("similarity", 12).desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _top(sim: np.ndarray, names: np.ndarray, k: int, floor: float):
    """(row, column, similarity) of each row's ``k`` best at or above the floor; columns stand in order of their names, which decide ties."""
    keep = min(k, sim.shape[1])
    least = np.partition(sim, sim.shape[1] - keep, axis=1)[:, sim.shape[1] - keep]
    i, j = np.nonzero((sim >= np.maximum(least - 1e-11, floor - 1e-12)[:, None]) & (sim > -np.inf))  # with all ties of the k-th best
    s = sim[i, j]
    order = np.lexsort((j, -np.round(s, 12), i))
    i, j, s = i[order], j[order], s[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], s[best]


def most_similar(df: DataFrame, k: int = 5, min_similarity: float | None = None, *, sample: int = SAMPLE, **options) -> DataFrame:
    """``(provider, unit_id, other_id, rank, similarity)``: the ``k`` most similar units of each unit.

    Cosine within a provider (and length, should it differ), ties by other_id.  A vector takes part if it has
    exactly ``dimensions`` finite values, not all zero; repeated rows count
    once.  Exact copies of a vector form a class that is indexed once; the
    nearest of a member are the other members of its class, then those of the
    nearest classes in order.  A class gives at most ``k + 1`` of its members
    (the smallest ids) to any list, which is all that the first ``k`` places can
    show, so a hot class isn't expanded into pairs.  Approximate: the places are
    those among the lists probed, exact with ``probes`` of all lists and no ``shortlist``.
    """
    classes, members, models = indexed(df, sample)
    near = nearest_classes(classes, models, k, min_similarity, **options)
    member = members.join(classes.select("space", "cell", "digest", "rep"), ["space", "cell", "digest"]).select("space", "rep", "unit_id")
    member = stage(member, "members")
    first = Window.partitionBy("space", "rep").orderBy("unit_id")
    few = member.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    own = classes.where("copies > 1").select("space", "rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity"))
    listed = near.unionByName(own).join(few.select("space", F.col("rep").alias("other"), F.col("unit_id").alias("other_id")), ["space", "other"])
    top = Window.partitionBy("space", "rep").orderBy(F.round("similarity", 12).desc(), "other_id")
    listed = listed.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1).select("space", "rep", "other_id", "similarity")
    out = member.join(listed, ["space", "rep"]).where("unit_id <> other_id")
    rank = Window.partitionBy("space", "unit_id").orderBy(F.round("similarity", 12).desc(), "other_id")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(F.regexp_replace("space", r"^[0-9]+\|", "").alias("provider"), "unit_id", "other_id", "rank", "similarity")


def similar_pairs(df: DataFrame, k: int = 5, min_similarity: float = 0.8, **options) -> DataFrame:
    """``(provider, unit_id_a, unit_id_b, similarity)``, a < b: one is among the other's ``k`` most similar, at or above the floor."""
    found = most_similar(df, k, min_similarity, **options).where(F.col("similarity") >= min_similarity)
    pairs = found.select("provider", F.least("unit_id", "other_id").alias("unit_id_a"), F.greatest("unit_id", "other_id").alias("unit_id_b"), "similarity")
    return pairs.groupBy("provider", "unit_id_a", "unit_id_b").agg(F.max("similarity").alias("similarity"))
