"""Filling containers of fixed capacity with items of varying length.

The bin packing problem is solved on the histogram of lengths, which has at most as many entries as
the capacity has tokens, whatever the number of items. Its configuration linear program (how many
containers of each composition) is solved by multiplicative weights: every length has a price that
falls as its items are covered, the dearest composition of items that are still uncovered is found
by a bounded knapsack over the capacity, and it is used as often as its lengths allow. Each round
prices the lengths that lag behind most, so a round costs the same for any histogram, and every
composition covers at least one of its lengths to the end: there are no more rounds than lengths.

Compositions are used whole numbers of times, so rounding only decides how much of the solution is
kept: the containers of the first rounds stay, what the last ones would hold is packed best fit,
longest first, also into the space the kept ones have left. Of a few such cuts, keeping nothing
among them, the one with the fewest containers is taken, so the result is never worse than best fit
alone. :func:`least_containers` bounds any packing from below.

The plan, a few compositions with multiplicities, goes to the tasks, which place their items by rank
within their length; ranks come from counts per length and salt, so a length that a third of all
items share is numbered by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellarium.session import materialise

#: Lengths priced in one round, how fast prices fall with coverage, and how much dearer a token of a long item is.
PRICED, FALL, LONG = 48, 0.3, 2.0
#: Shares of the tokens that rounding leaves to best fit; 1 leaves everything.
LEFT = (0.05, 0.1, 0.2, 0.35, 1.0)
#: Items of one length and salt, about: they are numbered by one task.
PER_SALT = 200_000

Plan = list[tuple[dict[int, int], int]]


def best_composition(sizes: np.ndarray, prices: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per size, at most ``limits``, of the dearest composition within the capacity.

    Bounded knapsack by dynamic programming: every size is offered in bundles of 1, 2, 4, ... items,
    each at most once.
    """
    bundles = []
    for i, size in enumerate(sizes.tolist()):
        left, n = min(int(limits[i]), capacity // size), 1
        while left > 0:
            bundles.append((i, min(n, left)))
            left, n = left - n, 2 * n
    value, took = np.zeros(capacity + 1), np.zeros((len(bundles), capacity + 1), dtype=bool)
    for b, (i, n) in enumerate(bundles):
        room = int(sizes[i]) * n
        offer = value[: capacity + 1 - room] + prices[i] * n
        took[b, room:] = offer > value[room:]
        np.maximum(value[room:], offer, out=value[room:])
    out, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for b in range(len(bundles) - 1, -1, -1):
        if took[b, c]:
            i, n = bundles[b]
            out[i] += n
            c -= int(sizes[i]) * n
    return out


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 5) -> Plan:
    """Compositions and how often each is used, which together cover every item but the last few, once.

    Multiplicative weights: the weight of a length is exponential in its uncovered share. Stops when
    at most the smallest share of :data:`LEFT` of all tokens is uncovered.
    """
    rng, need, left, plan = np.random.default_rng(seed), counts.astype(float), counts.astype(np.int64).copy(), []
    uncovered, stop = int((lengths * counts).sum()), min(LEFT) * float((lengths * counts).sum())
    while uncovered > stop:
        live = np.flatnonzero(left)
        weight = np.exp(FALL * left[live] / need[live])
        if len(live) > PRICED:
            drawn = weight * (0.5 + rng.random(len(live))) * np.sqrt(lengths[live])
            live = np.sort(live[np.argpartition(-drawn, PRICED)[:PRICED]])
            weight = np.exp(FALL * left[live] / need[live])
        sizes = lengths[live]
        a = best_composition(sizes, sizes * weight * (1 + LONG * sizes / capacity), left[live], capacity)
        used = a > 0
        times = int((left[live][used] // a[used]).min())
        left[live] -= times * a
        uncovered -= times * int((a * sizes).sum())
        plan.append((dict(zip(sizes[used].tolist(), a[used].tolist())), times))
    return plan


def best_fit(left: dict[int, int], kept: Plan, capacity: int) -> Plan:
    """The kept containers and what else is needed: longest first into the fullest container that still
    takes it; equal containers are handled as one."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for parts, n in kept:
        open_.setdefault(capacity - sum(m * k for m, k in parts.items()), []).append((tuple(parts.items()), n))
    spaces = sorted(open_)
    for m in sorted(left, reverse=True):
        n = left[m]
        while n:
            at = bisect_left(spaces, m)
            space = spaces[at] if at < len(spaces) else capacity
            parts, there = open_[space].pop() if at < len(spaces) else ((), n)
            each = min(space // m, n)
            run = min(there, n // each)
            if at < len(spaces):
                if there > run:
                    open_[space].append((parts, there - run))
                elif not open_[space]:
                    del open_[space]
                    spaces.pop(at)
            rest = space - m * each
            if rest not in open_:
                open_[rest] = []
                insort(spaces, rest)
            open_[rest].append(((*parts, (m, each)), run))
            n -= run * each
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for same in open_.values():
        for parts, run in same:
            total: dict[int, int] = {}
            for m, k in parts:
                total[m] = total.get(m, 0) + k
            key = tuple(sorted(total.items()))
            out[key] = out.get(key, 0) + run
    return [(dict(parts), run) for parts, run in out.items()]


def plan_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Compositions ``{length: items}`` with multiplicities that hold every item exactly once."""
    solved = solve_configurations(lengths, counts, capacity)
    tokens, best = float((lengths * counts).sum()), None
    for share in LEFT:
        left, kept, over = dict(zip(lengths.tolist(), counts.tolist())), [], tokens
        for parts, n in solved:
            if over <= share * tokens:
                break
            kept.append((parts, n))
            over -= n * sum(m * k for m, k in parts.items())
            for m, k in parts.items():
                left[m] -= n * k
        found = best_fit(left, kept, capacity)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
    return best


def least_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: items above half a container lie apart, and those of at least
    a threshold fill the space beside them first (the greatest such bound over all thresholds)."""
    best = 0
    for k in np.unique(np.r_[0, lengths[2 * lengths <= capacity]]):
        alone, apart, small = lengths > capacity - k, (lengths <= capacity - k) & (2 * lengths > capacity), (lengths >= k) & (2 * lengths <= capacity)
        beside = counts[apart].sum() * capacity - (counts[apart] * lengths[apart]).sum()
        more = max(0, int((counts[small] * lengths[small]).sum() - beside))
        best = max(best, int(counts[alone].sum() + counts[apart].sum()) + -(-more // capacity))
    return best


def _slots(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), first rank, items per container and first container of every run."""
    rows, used, bins = [], {}, 0
    for parts, run in plan:
        for m, k in parts.items():
            at = used.get(m, 0)
            rows.append((m, at, k, bins))
            used[m] = at + k * run
        bins += run
    rows.sort()
    m, first, per, container = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((), (), (), ())))
    return (m << 40) + first, first, per, container


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, part, tokens, container`` for items ``doc_id, tokens``.

    Items above the capacity are cut into full parts, each a container of its own, and a rest that is
    packed like any other item; nothing else is cut. Items of no tokens and null sizes need no place
    and are left out. Repeated rows are packed each.
    """
    sized = items.where(F.col("tokens") > 0).select("doc_id", F.col("tokens").cast("long").alias("tokens"))
    full = F.floor(F.col("tokens") / capacity).cast("int")
    whole = sized.where(F.col("tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("part"), F.lit(capacity).cast("int").alias("len"))
    rest = sized.select("doc_id", full.alias("part"), (F.col("tokens") % capacity).cast("int").alias("len")).where("len > 0")
    parts = materialise(whole.unionByName(rest))
    salts = max(1, -(-parts.count() // PER_SALT))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    per_salt = parts.groupBy("len", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(per_salt.withColumn("offset", before))
    histogram = offsets.groupBy("len").agg(F.sum("n").alias("n")).orderBy("len").collect()  # at most `capacity` rows
    keys, first, per, container = _slots(plan_containers(np.array([r["len"] for r in histogram], dtype=np.int64), np.array([r["n"] for r in histogram], dtype=np.int64), capacity))

    @F.pandas_udf("long")
    def place(length: pd.Series, rank: pd.Series) -> pd.Series:
        r = rank.to_numpy(dtype=np.int64)
        at = np.searchsorted(keys, (length.to_numpy(dtype=np.int64) << 40) + r, side="right") - 1
        return pd.Series(container[at] + (r - first[at]) // per[at])

    rank = F.row_number().over(Window.partitionBy("len", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "part")) - 1
    ranked = parts.withColumn("in_salt", rank).join(offsets.select("len", "salt", "offset"), ["len", "salt"]).withColumn("rank", F.col("in_salt") + F.col("offset"))
    return ranked.select("doc_id", F.col("part").cast("int").alias("part"), F.col("len").cast("long").alias("tokens"), place("len", "rank").alias("container"))


def pack_all(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """``pack_id, capacity_tokens, doc_id, part, tokens, container`` for every pack size of a small table."""
    sizes, out = materialise(sizes), None
    for r in packs.where("pack_id is not null and capacity_tokens > 0").distinct().orderBy("pack_id").collect():
        one = pack(sizes, r["capacity_tokens"]).select(F.lit(r["pack_id"]).alias("pack_id"), F.lit(r["capacity_tokens"]).alias("capacity_tokens"), "doc_id", "part", "tokens", "container")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return sizes.limit(0).select(F.lit(0).alias("pack_id"), F.lit(0).alias("capacity_tokens"), "doc_id", F.lit(0).alias("part"), F.col("tokens").cast("long").alias("tokens"), F.lit(0).cast("long").alias("container"))
    return out


def fill_report(packed: DataFrame) -> DataFrame:
    """``pack_id, capacity_tokens, containers, tokens, at_least, fill``: how full the containers are, and
    how many hold all tokens if none had any space left."""
    per = packed.groupBy("pack_id", "capacity_tokens").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.withColumn("at_least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def broken_rules(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """``pack_id, capacity_tokens, documents, overfull, cut, lost``: documents placed, containers above
    their capacity, documents cut though they fit, and documents with text that were not placed."""
    per_bin = packed.groupBy("pack_id", "capacity_tokens", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_id", "capacity_tokens").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    per_doc = packed.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("parts"))
    cut = F.count_if(F.col("parts") > F.ceil(F.col("t") / F.col("capacity_tokens")))
    judged = per_doc.groupBy("pack_id", "capacity_tokens").agg(F.count("*").alias("documents"), cut.alias("cut"))
    written = documents.where("text <> ''").agg(F.count_distinct("doc_id")).scalar()
    return judged.join(per_bin, ["pack_id", "capacity_tokens"]).withColumn("lost", written - F.col("documents"))
