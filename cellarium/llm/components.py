"""Consolidating pairwise matches into groups by randomly contracting the graph.

Every round each vertex hooks to the neighbour (or itself) that comes first in a fresh hash order;
edges are relabelled to the representatives, loops and repeats fall away, and the round's mapping is
kept. A constant share of the vertices disappears per round in expectation, whatever the shape of
the graph, so chains and stars both need a logarithmic number of rounds. At the end the mappings
are expanded from the last round to the first. Everything stays in tables: no link and no component
ever reaches the driver, only one count per round does.

Every step is written to Parquet below the shared checkpoint folder and read back. A checkpoint would
carry on the estimated size of its plan, which is the product of a join's sides and so has three times
the digits after every round, until the number alone fills the driver; a file has the size it has. The
expansion is written step by step too, so that no plan grows with the number of rounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.session import ensure_checkpoint_dir

MAX_ROUNDS = 200


def _order(v: Column, round_: int) -> Column:
    """Fresh pseudo-random order of the vertices; the vertex itself breaks ties."""
    return F.struct(F.xxhash64(F.lit(round_), v).alias("h"), v.alias("v"))


def _stored(df: DataFrame) -> DataFrame:
    """The table, written to a folder of its own and read back."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/files-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def contract(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex, root`` for every vertex of ``edges``; equal roots mean connected.

    Null sides and loops are ignored; repeated edges and both directions count once. An empty
    table gives an empty result. Skew: the hook is a partially aggregated minimum, and relabelling
    joins the edges with one row per vertex, so that a hub's edges may be split at will (AQE).
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = _stored(e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    maps: list[DataFrame] = []
    for round_ in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        sides = e.select("x", "y").unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = sides.groupBy("x").agg(F.min(_order(F.col("y"), round_)).alias("m"))
        hook = _stored(hook.select(F.col("x").alias("v"), F.least("m", _order(F.col("x"), round_))["v"].alias("r")))
        maps.append(hook)
        left = e.join(hook.select(F.col("v").alias("x"), F.col("r").alias("rx")), "x")
        both = left.join(hook.select(F.col("v").alias("y"), F.col("r").alias("ry")), "y").where("rx <> ry")
        e = _stored(both.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct())
    else:
        raise RuntimeError("the graph did not contract")
    if not maps:
        return e.select(F.col("x").alias("vertex"), F.col("x").alias("root"))
    # Expand from the last round to the first: a representative of round k has its root in round k + 1, if it lived on.
    roots = maps[-1]
    for i, hook in enumerate(reversed(maps[:-1])):
        roots = _stored(roots) if i else roots
        later = roots.select(F.col("v").alias("r"), F.col("r").alias("rr"))
        roots = hook.join(later, "r", "left").select("v", F.coalesce("rr", "r").alias("r"))
    return roots.select(F.col("v").alias("vertex"), F.col("r").alias("root"))


def match_groups(pairs: DataFrame, a: str = "id_a", b: str = "id_b", match: str = "is_match") -> DataFrame:
    """``gold_id, group_id`` of every record linked to another one by an accepted pair.

    ``group_id`` is the smallest id of the group. Refused and undecided pairs, pairs with a null
    side and pairs of an id with itself link nothing.
    """
    linked = contract(pairs.where(F.col(match)), a, b)
    names = linked.groupBy("root").agg(F.min("vertex").alias("group_id"))
    return linked.join(names, "root").select(F.col("vertex").alias("gold_id"), "group_id")
