"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Unit vectors are projected on many random lines, and each line is sorted. A vector stands on a line only where
its projection is far out (beyond `cut` on either side), as there near vectors meet often and others seldom: a
vector stands on a few dozen lines, whatever their number. Two vectors collide on a line if both stand on it and
either lies in the window that is centred on the other. The projections of a pair of a given cosine are normal
with that correlation, so the number of its collisions is binomial with a known rate: `calibrated` chooses the cut
such that a pair at the threshold fails the least count with a probability of `tolerance` (closer pairs collide
more often), the least count such that few other pairs reach it, and the number of lines in proportion to the
largest label, so that a line holds a few vectors at any size. Pairs that reach the count are verified by their
cosine in double precision.

A pair is counted once, on the first line that it collides on, from the lines that each vector carries. Pairs are
never listed: candidates leave a line as a spanning forest and masks, their groups are dealt into units of
bounded size (`components.units`), and links leave a unit as sums and a spanning forest. Lines on which a hot
label or a group of near copies stands are dealt into blocks, and each pair of blocks is searched on its own.

Only vectors with equal labels meet. Equal vectors of a label are one row with a count. Vectors that are null,
zero or hold null or non-finite components, rows with a null label and rows with a null id link with nothing;
each comes back with 0 links as its own component (a null id with a null component, kept). Rows that repeat an id
get that id's result, which its smallest linkable row makes. Vectors of different lengths do not link. Empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, erf, exp, log2, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Tables, arrow_schema, batch, grouped_arrow, merged, starts_of, whole_groups
from lodestone.llm.components import connected, forest, place, units
from lodestone.llm.jaccard import met_rows
from lodestone.llm.vectors import blocked, cleaned, matrix

#: Vectors of one block of a line, and of one block of a group.
LINE_BLOCK, BLOCK = 512, 256
#: Vectors that stand on one side of a line of the largest label, about; bounds of the number of lines.
TAIL, LEAST_LINES, MOST_LINES = 8, 1024, 32_768
#: A mark is a side of a line, and in its low bits how far beyond the cut the projection is.
BITS = 15
SCALE = 4096


@dataclass(frozen=True)
class Plan:
    lines: int
    cut: float
    window: float
    least: int


def _normal(x: float) -> float:
    return (1 + erf(x / sqrt(2))) / 2


def collision_rate(cosine: float, cut: float, window: float) -> float:
    """Probability that a pair of this cosine collides on a line: the integral over the one's projection x beyond
    the cut, on both sides, of the probability that the other is beyond it and within the window around x."""
    s, total, step = sqrt(max(1e-12, 1 - cosine * cosine)), 0.0, 0.01
    for k in range(int(7 / step)):
        x = cut + (k + 0.5) * step
        most, least = x + window, max(cut, x - window)
        total += exp(-x * x / 2) / sqrt(2 * pi) * step * (_normal((most - cosine * x) / s) - _normal((least - cosine * x) / s))
    return 2 * total


def _fewer(n: int, p: float, least: int) -> float:
    """Probability of fewer than `least` of n."""
    return sum(comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(least))


def calibrated(size: int, threshold: float, width: float, tolerance: float) -> Plan:
    """The plan for labels of up to `size` vectors."""
    window, strays = width * sqrt(2 - 2 * threshold), 0.0
    lines = LEAST_LINES
    while True:
        for least in range(2, 12):
            low, high = 0.0, 6.0
            for _ in range(30):  # the outermost cut at which a pair at the threshold still fails seldom enough
                cut = (low + high) / 2
                low, high = (cut, high) if _fewer(lines, collision_rate(threshold, cut, window), least) <= tolerance else (low, cut)
            cut, tail = low, 1 - _normal(low)
            # of all others, about as far apart as two random vectors, that reach the count with one vector
            strays = size * (1 - _fewer(lines, collision_rate(0.0, cut, window), least))
            if strays < 0.1:
                break
        if lines >= MOST_LINES or size * tail <= 2 * TAIL:
            return Plan(lines, cut, window, least)
        lines = min(MOST_LINES, max(2 * lines, 1 << round(log2(lines * size * tail / TAIL))))


def marks_of(x: np.ndarray, axes: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """For each unit vector the sorted marks of the lines that it stands on."""
    out = []
    some = max(1, (1 << 21) // plan.lines)
    for lo in range(0, len(x), some):
        p = x[lo : lo + some].astype(np.float32) @ axes
        far = np.abs(p) - np.float32(plan.cut)
        row, line = np.nonzero(far >= 0)
        depth = np.minimum((far[row, line] * SCALE).astype(np.int64), (1 << BITS) - 1)
        code = (line * 2 + (p[row, line] < 0)) << BITS | depth
        ends = np.searchsorted(row, np.arange(len(p) + 1))
        out += [code[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return out


def padded(column) -> np.ndarray:
    """Lists of marks as rows of a matrix, filled up with -1."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes, flat = np.diff(ends), column.values.to_numpy().astype(np.int64)
    out = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), -1, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0] : ends[-1]]
    return out


def colliding(marks: np.ndarray, i: np.ndarray, j: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows: whether they collide often enough, and the side of a line where they do so first."""
    window = int(plan.window * SCALE)
    enough, first = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
    for lo in range(0, len(i), 8192):
        both = np.concatenate((marks[i[lo : lo + 8192]], marks[j[lo : lo + 8192]]), axis=1)
        both.sort(axis=1)
        hits = (both[:, 1:] - both[:, :-1] <= window) & (both[:, 1:] >> BITS == both[:, :-1] >> BITS) & (both[:, :-1] >= 0)
        enough[lo : lo + 8192] = hits.sum(1) >= plan.least
        first[lo : lo + 8192] = both[np.arange(len(both)), hits.argmax(1)] >> BITS
    return enough, first


def in_windows(group: np.ndarray, depth: np.ndarray, window: int):
    """Index pairs (i, j) of rows of one group whose depths, sorted within it, are at most a window apart; some at a time."""
    i = np.arange(len(group) - 1)
    left, right, held, off = [], [], 0, 1
    while len(i):
        i = i[i + off < len(group)]
        i = i[(group[i] == group[i + off]) & (depth[i + off] - depth[i] <= window)]
        left.append(i)
        right.append(i + off)
        held += len(i)
        off += 1
        if held > 1 << 17:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def near_duplicates(df: DataFrame, threshold: float = 0.93, width: float = 1.5, tolerance: float = 1e-4, seed: int = 5, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (see the module)."""
    table = Tables(df.sparkSession)
    rows = cleaned(df.filter(F.col(label).isNotNull()), vec_id, vector, F.col(label).alias("label"))
    rows = table(rows.withColumn("length", F.size("embedding")), "vectors")
    classes = rows.groupBy("label", "length", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = table(classes, "classes")
    largest = classes.groupBy("label", "length").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    plan = calibrated(largest or 0, threshold, width, tolerance)
    marked = table(_marked(classes.select("label", "length", "node", "embedding"), plan, seed).drop("embedding"), "marked")
    found = table(_found(marked, plan, table), "found")
    verified = table(_verified(classes, marked, found, plan, threshold, table), "links")
    sums = verified.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    reached = connected(verified.filter("b is not null").select("a", "b"))
    info = classes.join(merged(sums), "node", "left").join(merged(reached), "node", "left")
    info = info.select("label", "length", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    info = table(info, "info")  # so that AQE may split a vector of very many copies
    table.drop_but(rows, info)
    linked = rows.join(merged(info), ["label", "length", "embedding"]).select(F.col("vec_id").alias("id"), "n_links", "component_id")
    every = df.select(F.col(vec_id).alias("vec_id"))
    out = every.join(merged(linked), every["vec_id"] == linked["id"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def _unit(column) -> np.ndarray:
    x = matrix(column)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components must not leave the doubles
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _marked(classes: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """classes with the marks of each."""

    def run(batches):
        axes: dict[int, np.ndarray] = {}
        for b in batches:
            length = b.column("length").to_numpy()
            marks: list = [None] * b.num_rows
            for n in np.unique(length).tolist():
                if n not in axes:
                    axes.clear()
                    axes[n] = np.random.default_rng([seed, n]).standard_normal((n, plan.lines), np.float32)
                at = np.flatnonzero(length == n)
                for lo in range(0, len(at), 1024):
                    some = at[lo : lo + 1024]
                    for k, m in zip(some.tolist(), marks_of(_unit(b.column("embedding").take(some)), axes[n], plan), strict=True):
                        marks[k] = m
            yield batch(arrow_schema(schema), **dict(zip(b.schema.names, b.columns, strict=True)), marks=marks)

    schema = classes.withColumn("marks", F.array().cast("array<int>")).schema
    return classes.mapInArrow(run, schema)


def _found(marked: DataFrame, plan: Plan, table: Tables) -> DataFrame:
    """Candidates: edges (a, b) of a spanning forest, and masks of the places that each (a) was met with."""
    side, depth = F.shiftright("mark", BITS).alias("side"), F.col("mark").bitwiseAND((1 << BITS) - 1).alias("depth")
    stand = marked.withColumn("mark", F.explode("marks")).select("label", "length", side, depth, "node", place("node").alias("place"), "marks")
    size = stand.groupBy("label", "length", "side").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    size = table(size.select("label", "length", "side", F.ceil(F.col("n") / LINE_BLOCK).cast("int").alias("blocks")), "lines")
    met = blocked(stand.join(merged(size), ["label", "length", "side"]), "blocks", "node")
    keys = ["label", "length", "side", "lo", "hi"]
    met = met.select(*keys, "depth", "own", "node", "place", "marks")
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, *keys).sortWithinPartitions(*keys, "depth", "node")
    window = int(plan.window * SCALE)

    def search(batches):
        for part in whole_groups(batches, keys):
            starts = starts_of(part, keys)
            group = np.repeat(np.arange(len(starts)), np.diff([*starts, part.num_rows]))
            side, lo, hi, own, depth, node, places = (part.column(c).to_numpy() for c in ("side", "lo", "hi", "own", "depth", "node", "place"))
            marks = padded(part.column("marks"))
            left, right = [], []
            for i, j in in_windows(group, depth, window):
                apart = (lo[i] == hi[i]) | (own[i] != own[j])
                i, j = i[apart], j[apart]
                enough, first = colliding(marks, i, j, plan)
                go = enough & (first == side[i])
                left.append(i[go])
                right.append(j[go])
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            if len(i):
                # a vector has many rows here: the rows of one node are one
                names, inverse = np.unique(node, return_inverse=True)
                at = np.zeros(len(names), places.dtype)
                at[inverse] = places
                yield met_rows(names.tolist(), at, inverse[i], inverse[j], "bigint")

    return met.mapInArrow(search, "a bigint, b bigint, mask bigint")


def _verified(classes: DataFrame, marked: DataFrame, found: DataFrame, plan: Plan, threshold: float, table: Tables) -> DataFrame:
    """Rows (a, null, links) with links of the class a, summed elsewhere, and edges (a, b, null) of a forest."""
    dealt = units(found, classes.select("node", F.lit(1).alias("weight")), BLOCK, 1 << 30, table)
    held = classes.select("node", "copies", "embedding").join(merged(marked.select("node", "marks")), "node")
    met = dealt.join(merged(held), "node").select("component", "lo", "hi", "own", "node", "copies", "embedding", "marks")
    result = "a bigint, b bigint, links bigint"

    def verify(key, group):
        _, lo, hi = key
        own, node, copies = (group.column(c).to_numpy() for c in ("own", "node", "copies"))
        marks, x = padded(group.column("marks")), _unit(group.column("embedding"))
        if lo == hi:
            i, j = np.triu_indices(len(node), 1)
        else:
            u, v = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            i, j = np.repeat(u, len(v)), np.tile(v, len(u))
        if not len(i):
            return
        go, _ = colliding(marks, i, j, plan)
        i, j = i[go], j[go]
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 16384):
            keep[s : s + 16384] = (x[i[s : s + 16384]] * x[j[s : s + 16384]]).sum(1) >= threshold
        i, j = i[keep], j[keep]
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        some, tree = np.flatnonzero(links), forest(len(x), i, j)
        yield batch(arrow_schema(result), a=node[some].tolist() + [int(node[s]) for s, _ in tree], b=[None] * len(some) + [int(node[t]) for _, t in tree], links=links[some].astype(np.int64).tolist() + [None] * len(tree))

    return grouped_arrow(met, ["component", "lo", "hi"], verify, result)
