"""Connected components of an edge table, spanning forests of small ones, and the units in which the candidate
pairs of a self-join are verified."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Tables, merged


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with nodes 0..n-1 (minimum labels, halved step by step)."""
    if not len(left):
        return []
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not (new == (jump := new[new])).all():
            new = jump
        new = new[label]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return list(zip(label[at].tolist(), at.tolist(), strict=True))


#: Neighbours of one node that a task joins, about.
HUB = 500


def _to_least(rows: DataFrame, least: DataFrame, salts: int) -> DataFrame:
    """rows (u, v) with the m of their u; where a node has very many neighbours, its rows are dealt by salt."""
    if salts > 1:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        return rows.join(merged(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))), ["u", "salt"]).drop("salt")
    return rows.join(merged(least), "u")


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b), by alternating large and small
    stars. A node's neighbours are aggregated to their minimum on the map side, and a hub's rows are salted
    for the join with it, in proportion to the largest hub, so no node's edges meet in one task.
    """
    table = Tables(edges.sparkSession)
    stars = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    for _ in range(most):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = both.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        salts = min(256, -(-hub // HUB))
        # large star: larger neighbours of a node go to its smallest neighbour
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _to_least(both.filter("v > u"), low, salts).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _to_least(large, low, salts).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        stars = table(small.distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        table.drop_but(stars)
        if now == before or not now["n"]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


#: Bits of a mask of places.
PLACES = 64


def place(node: str) -> Column:
    """Where a node stands in the blocks of whatever group it is in: its block of 2**k is the place modulo 2**k."""
    return F.pmod(F.xxhash64(F.col(node), F.lit("place")), F.lit(1 << 30)).cast("int")


def met_places(n: int, i: np.ndarray, j: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of n rows the mask of the places, modulo PLACES, of the rows that it is paired with in (i, j)."""
    met = np.zeros((n, PLACES), bool)
    met[i, places[j] % PLACES] = True
    met[j, places[i] % PLACES] = True
    return np.packbits(met, axis=1, bitorder="little").view("<u8")[:, 0].view(np.int64)


def units(found: DataFrame, weights: DataFrame, members: int, weight: float, table: Tables) -> DataFrame:
    """node, component, lo, hi, own: the units in which the candidate pairs of a join are verified.

    found: rows (a, b, null), whose edges connect all candidates, and rows (a, null, mask) with the places of the
    candidates that a was met with. weights: node, weight. A component is dealt into 2**k blocks of about
    `members` nodes and `weight` weight at most, each pair of blocks (lo, hi) is a unit, and a node comes to
    those units alone in whose other block a candidate of its own is, so a chain of pairs makes as many rows as
    pairs. (Beyond PLACES blocks, places that are equal modulo PLACES are not told apart.)
    """
    reached = connected(found.filter("b is not null").select("a", "b"))
    masks = found.filter("mask is not null").groupBy(F.col("a").alias("node")).agg(F.bit_or("mask").alias("mask"))
    nodes = table(reached.join(merged(masks), "node").join(merged(weights.select("node", "weight")), "node"), "nodes")
    size = nodes.groupBy("component").agg(F.greatest(F.count(F.lit(1)) / members, F.sum("weight") / weight, F.lit(1)).alias("x"))
    size = table(size.select("component", F.pow(F.lit(2), F.ceil(F.log2("x") - 1e-9)).cast("int").alias("blocks")), "sizes")
    bits = F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.getbit("mask", i) == 1)
    more = F.flatten(F.transform(bits, lambda i: F.sequence(i, F.col("blocks") - 1, F.lit(PLACES))))
    other = F.when(F.col("blocks") > PLACES, more).otherwise(F.array_distinct(F.transform(bits, lambda i: i % F.col("blocks"))))
    out = nodes.join(merged(size), "component").withColumn("own", F.pmod(place("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(other))
    return out.select("node", "component", F.least("own", "other").cast("int").alias("lo"), F.greatest("own", "other").cast("int").alias("hi"), "own")
