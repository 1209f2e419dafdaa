"""Most similar vectors for every vector, by learned partitions.

A bounded sample gives a neighbour graph, the graph is cut into balanced parts, and a small
classifier learns which part a vector belongs to. Every vector of the collection is stored in its
most probable part; every query visits its most probable parts and is ranked exactly there. Equal
vectors are one point of the index, so a vector that a third of all rows share costs as much as any
other; its rows come back through the members kept with the point.

Parts grow in number with the collection, not in size. Beyond :data:`ONE_LEVEL` parts they are learned
on two levels: the first classifier chooses among the square root of all parts, and within each of
those another one, fitted by a task of its own on a bounded sample of its points, chooses further. A
query ranks the parts of both levels by the product of their probabilities. Parts are also cut into
blocks of bounded size on both sides, so no task ever holds an unbounded part.

A collection of at most ``part_points`` points has one part, which every query meets whole: that is
the exact search, which ``part_points=None`` asks for whatever the size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.session import materialise

#: Vectors one classifier is fitted on, at most; chosen by hash, whatever the size of the collection.
FIT_ROWS = 6_000
#: Points one part should hold, parts that are learned on one level, and most classes of one classifier:
#: parts keep their size up to the square of that many, some 5 * 10^8 points.
PART_POINTS, ONE_LEVEL, MOST_CLASSES = 2_000, 32, 512
#: Parts a query visits, and parts of the first level it may find them in.
PROBES, FIRST_PROBES = 5, 4
#: Points and queries of one block.
BLOCK = 4_096
QUERY_BLOCK = 8_192


def fit_partitions(sample: np.ndarray, parts: int, neighbours: int = 10, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Weights ``(w1, b1, w2, b2)`` of a classifier that routes unit vectors to balanced parts."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    label = balanced_cut(neighbour_graph(x, neighbours), len(x), parts, seed)
    return train_router(x, label, parts, seed)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Undirected edges (i, j), i < j, between every vector and its k most similar ones."""
    k = min(k, len(x) - 1)
    if k < 1:
        return np.empty((0, 2), dtype=np.int64)
    edges = []
    for at in range(0, len(x), 1024):
        sim = x[at : at + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -np.inf
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        edges.append(np.stack([np.repeat(np.arange(at, at + len(sim)), k), near.ravel()], axis=1))
    e = np.sort(np.concatenate(edges), axis=1)
    return np.unique(e, axis=0)


def balanced_cut(edges: np.ndarray, n: int, parts: int, seed: int) -> np.ndarray:
    """Part of every vertex: recursive bisection at the median of a smooth graph signal, so parts
    differ by a few vertices at most while few edges are cut."""
    rng, label = np.random.default_rng(seed), np.zeros(n, dtype=np.int64)
    work = [(np.arange(n), 0, parts)]
    while work:
        at, first, count = work.pop()
        if count == 1 or len(at) < 2:
            label[at] = first
            continue
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        e = place[edges]
        e = e[(e >= 0).all(axis=1)]
        signal = smooth_signal(e, len(at), rng)
        left = count // 2
        cut = len(at) * left // count
        order = np.argsort(signal, kind="stable")
        work += [(at[order[:cut]], first, left), (at[order[cut:]], first + left, count - left)]
    return label


def smooth_signal(e: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """Approximate second eigenvector of the normalised adjacency, by power iteration."""
    degree = np.bincount(e.ravel(), minlength=n) + 1.0
    root = np.sqrt(degree)
    first = root / np.linalg.norm(root)
    v = rng.standard_normal(n)
    for _ in range(rounds):
        v -= first * (first @ v)
        u = v / root
        moved = np.bincount(e[:, 0], weights=u[e[:, 1]], minlength=n) + np.bincount(e[:, 1], weights=u[e[:, 0]], minlength=n) + u
        v = v + moved / root
        v /= max(np.linalg.norm(v), 1e-300)
    return v / root


def train_router(x: np.ndarray, label: np.ndarray, parts: int, seed: int, hidden: int = 64, epochs: int = 30) -> tuple[np.ndarray, ...]:
    """One hidden layer, trained by Adam on the parts of the sample."""
    rng = np.random.default_rng(seed)
    w = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            p = softmax(h @ w[2] + w[3])
            p[np.arange(len(i)), label[i]] -= 1
            p /= len(i)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[i].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


Router = tuple[np.ndarray, ...]


def log_shares(x: np.ndarray, w: Router) -> np.ndarray:
    """Logarithm of the probability of every class."""
    z = np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def best_columns(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest scores of every row, best first."""
    k = min(k, score.shape[1])
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)


def route(x: np.ndarray, first: Router, second: dict[int, Router] | None, classes: int, probes: int) -> np.ndarray:
    """The most probable parts of every vector, best first; part ``a * classes + b`` on two levels."""
    upper = log_shares(x, first)
    if second is None:
        return best_columns(upper, probes)
    top = best_columns(upper, FIRST_PROBES)
    score = np.full((len(x), top.shape[1] * classes), -np.inf)
    for a in np.unique(top):
        i, j = np.nonzero(top == a)
        lower = log_shares(x[i], second[a]) if a in second else np.zeros((len(i), 1))
        for c in range(lower.shape[1]):
            score[i, j * classes + c] = upper[i, a] + lower[:, c]
    best = best_columns(score, probes)
    return np.take_along_axis(top, best // classes, axis=1) * classes + best % classes


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec, point``: rows that have a direction, with a key shared by equal vectors.

    Null ids and null, empty and all-zero vectors and vectors with a null or non-finite entry are
    left out. Minus zero counts as zero.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(F.col(id_col).alias("id"), v.alias("vec")).where("id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("vec", lambda x: x != 0)).withColumn("point", F.xxhash64("vec"))


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """``point, vec, members``: one row per distinct vector with its ``keep`` smallest ids.

    The rank limit is applied before the shuffle as well, so of the rows that share a vector only
    ``keep`` per task travel.
    """
    w = Window.partitionBy("point").orderBy("id")
    few = rows.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= keep)
    return few.groupBy("point").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("members"))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _thin(points: DataFrame, rows: float, n: int) -> DataFrame:
    """About ``rows`` of ``n`` points, or all, chosen by hash."""
    share = int(min(1.0, rows / max(n, 1)) * (1 << 20))
    return points.where(F.pmod(F.xxhash64(F.lit(13), "point"), F.lit(1 << 20)) < share)


def _second_level(points: DataFrame, first: Router, tops: int, classes: int, fit_rows: int, n: int) -> dict[int, Router]:
    """A router of ``classes`` parts for every part of the first level; each is fitted by one task."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(b["vec"])
                yield pd.DataFrame({"top": best_columns(log_shares(x.astype(np.float32), first), 1)[:, 0], "point": b["point"], "x": [r.tobytes() for r in x]})

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = unpack(rows["x"])
        if len(x) < 2:
            return pd.DataFrame({"top": [], "weights": []})
        w = [a.astype(np.float32) for a in fit_partitions(x, min(classes, len(x)))]
        return pd.DataFrame({"top": [key[0]], "weights": [pickle.dumps(w)]})

    spread = _thin(points, 1.5 * fit_rows * tops, n).select("point", "vec").mapInPandas(assign, "top int, point long, x binary")
    few = spread.withColumn("rank", F.row_number().over(Window.partitionBy("top").orderBy(F.xxhash64(F.lit(11), "point")))).where(F.col("rank") <= fit_rows).drop("rank")
    fitted = few.groupBy("top").applyInPandas(fit, "top int, weights binary").collect()  # bounded: classes of either level times the hidden width
    return {r["top"]: tuple(pickle.loads(r["weights"])) for r in fitted}


def build_index(points: DataFrame, probes: int = PROBES, fit_rows: int = FIT_ROWS, part_points: int | None = PART_POINTS, one_level: int = ONE_LEVEL) -> tuple[DataFrame, int]:
    """``point, x, parts`` (unit vector as bytes, most probable parts best first) and the number of points.

    Only a sample (at most ``fit_rows`` vectors) and the fitted weights reach the driver; both are
    bounded by parameters.
    """
    n = points.count()
    parts = 1 if part_points is None else max(1, -(-n // part_points))
    tops = parts if parts <= one_level else min(MOST_CLASSES, int(np.ceil(np.sqrt(parts))))
    classes = 1 if parts <= one_level else min(MOST_CLASSES, -(-parts // tops))
    first = second = None
    if parts > 1:
        # A hash filter thins the rows first, so that the tasks together offer little more than the sample.
        order = F.xxhash64(F.lit(11), "point")
        sample = _thin(points, 1.1 * fit_rows, n).orderBy(order, "point").limit(fit_rows).select("vec").toPandas()["vec"]
        x = np.array(sample.tolist(), dtype=np.float64)
        first = tuple(a.astype(np.float32) for a in fit_partitions(x, min(tops, len(x))))
        if classes > 1:
            second = _second_level(points, first, tops, classes, fit_rows, n)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(b["vec"])
                where = route(x.astype(np.float32), first, second, classes, probes) if first else np.zeros((len(x), 1), dtype=np.int64)
                yield pd.DataFrame({"point": b["point"], "x": [r.tobytes() for r in x], "parts": where.tolist()})

    return points.select("point", "vec").mapInPandas(assign, "point long, x binary, parts array<int>"), n


def search(index: DataFrame, queries: DataFrame, k: int, min_cos: float = -1.0) -> DataFrame:
    """``q, point, cos``: the ``k`` most similar other points of every query found in its parts.

    ``queries`` has the columns of the index with ``point`` as the query key. Parts are split into
    blocks of bounded size on both sides; every query meets every block of its parts, so splitting
    changes no result. Equal cosines are ordered by point.
    """
    # One row per part, so at most the square of MOST_CLASSES short rows.
    sizes = F.broadcast(materialise(_part_sizes(index, queries)))
    last = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    stored = index.select("point", "x", F.element_at("parts", 1).alias("part")).join(sizes, "part")
    stored = stored.withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks").cast("long")).cast("int")).withColumn("q_block", F.explode(last("q_blocks")))
    asked = queries.select(F.col("point").alias("q"), F.col("x").alias("y"), F.explode("parts").alias("part")).join(sizes, "part")
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("q"), F.col("q_blocks").cast("long")).cast("int")).withColumn("block", F.explode(last("blocks")))

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return rank_block(a["point"].to_numpy(), unpack(a["x"]), b["q"].to_numpy(), unpack(b["y"]), k, min_cos)

    keys = ["part", "block", "q_block"]
    found = stored.select("point", "x", *keys).groupBy(*keys).cogroup(asked.select("q", "y", *keys).groupBy(*keys)).applyInPandas(compare, "q long, point long, cos double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "point"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).drop("rank")


def _part_sizes(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``part, blocks, q_blocks``: into how many blocks each part is cut on either side."""
    n = index.select(F.element_at("parts", 1).alias("part"), F.lit(1).alias("n"), F.lit(0).alias("m"))
    m = queries.select(F.explode("parts").alias("part"), F.lit(0).alias("n"), F.lit(1).alias("m"))
    blocks = lambda c, size: F.greatest(F.ceil(F.sum(c) / size), F.lit(1)).cast("int")
    return n.unionByName(m).groupBy("part").agg(blocks("n", BLOCK).alias("blocks"), blocks("m", QUERY_BLOCK).alias("q_blocks"))


def unpack(col: pd.Series) -> np.ndarray:
    if not len(col):
        return np.empty((0, 0))
    return np.frombuffer(b"".join(col), dtype=np.float64).reshape(len(col), -1)


def rank_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, min_cos: float) -> pd.DataFrame:
    """Best ``k`` of one block for each of its queries: single precision finds, double precision ranks."""
    out_q, out_p, out_c = [], [], []
    if len(ids) and len(q_ids):
        small = x.astype(np.float32).T.copy()
        for at in range(0, len(q_ids), 1024):
            sim = q[at : at + 1024].astype(np.float32) @ small
            if min_cos > -1:
                i, j = np.nonzero(sim >= min_cos - 1e-5)
            elif len(ids) > k + 4:
                j = np.argpartition(-sim, k + 3, axis=1)[:, : k + 4].ravel()
                i = np.repeat(np.arange(len(sim)), k + 4)
            else:
                i, j = (a.ravel() for a in np.indices(sim.shape))
            cos = np.round(np.einsum("ij,ij->i", q[at + i], x[j]), 12)
            keep = (ids[j] != q_ids[at + i]) & (cos >= min_cos)
            i, j, cos = i[keep], j[keep], cos[keep]
            order = np.lexsort((ids[j], -cos, i))
            i, j, cos = i[order], j[order], cos[order]
            start = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, dtype=bool)
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) if len(i) else np.empty(0, dtype=np.int64)
            top = rank < k
            out_q.append(q_ids[at + i[top]])
            out_p.append(ids[j[top]])
            out_c.append(cos[top])
    cat = lambda a, t: np.concatenate(a) if a else np.empty(0, dtype=t)
    return pd.DataFrame({"q": cat(out_q, np.int64), "point": cat(out_p, np.int64), "cos": cat(out_c, np.float64)})


def most_similar(df: DataFrame, id_col: str, vec_col: str, k: int = 5, min_cos: float = -1.0, queries: Column | None = None, probes: int = PROBES, part_points: int | None = PART_POINTS) -> DataFrame:
    """``id, other, cos``: the ``k`` most similar other rows of every row (of ``queries``, if given).

    Equal cosines are ordered by the smaller id. Rows without a direction neither ask nor answer.
    An empty table gives an empty result. ``queries`` is a condition on ``id``; without ``part_points``
    the search is exact.
    """
    rows = materialise(usable_vectors(df, id_col, vec_col))
    points = materialise(distinct_points(rows, k + 1))
    index, _ = build_index(points, probes, part_points=part_points)
    index = materialise(index)
    asking = rows.select("id", "point") if queries is None else rows.where(queries).select("id", "point")
    asked = index if queries is None else index.join(asking.select("point").distinct(), "point", "left_semi")
    near = search(index, asked, k, min_cos)
    named = near.join(points.select("point", "members"), "point").groupBy("q").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("cos")).alias("c"), m.alias("id"))))).alias("others"))
    own = points.select("point", F.transform("members", lambda m: F.struct(F.lit(-1.0).alias("c"), m.alias("id"))).alias("same"))
    both = own.join(named.withColumnRenamed("q", "point"), "point", "left")
    both = both.select("point", F.slice(F.array_sort(F.concat("same", F.coalesce("others", F.slice("same", 1, 0)))), 1, k + 1).alias("near"))
    mine = asking.join(both, "point").select("id", F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k).alias("near"))
    return mine.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("other"), (-F.col("n.c")).alias("cos")).where(F.col("cos") >= min_cos).distinct()


def own_taste(gold: DataFrame) -> DataFrame:
    """Products whose vector is their own: the source is given and is not the style."""
    source = F.trim(F.get_json_object("record", "$.sensory.source"))
    return gold.where("entity_type = 'product'").where(F.col("sensory").isNotNull()).where((source != "") & (F.lower(source) != "style_prior")).select("id", "sensory")


def taste_pairs(gold: DataFrame, k: int = 5, min_cos: float = 0.999) -> DataFrame:
    """``id_a, id_b`` (smaller id first) where one is among the other's ``k`` most similar."""
    near = most_similar(own_taste(gold), "id", "sensory", k, min_cos)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
