"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are fitted on a bounded sample: each split projects the points of a node on the line between the
centres of two random groups of them and cuts at the median. All vectors are routed to their leaves.
A query walks all trees through one shared priority queue: each branch has the logarithm of the probability that
a neighbour is in it, summed over the splits above, as a neighbour's projection is taken to be normal around the
query's, shrunk by `kinship`. The likeliest leaves of all trees are visited until they hold `share` of the
forest's sample, and the vectors in these are ranked by exact distance in double precision.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an
id; of rows that repeat an id the smallest vector counts; vectors of another length than the most
frequent one take no part. Equal vectors are indexed once, with as many of their smallest ids as can be
returned. Ties go to the smaller id, however many there are. Fewer candidates than k give fewer rows, an empty
table none.

Leaves grow with the table, as the trees do not: a leaf's members and its visitors are dealt into blocks
of bounded size, and each pair of blocks is ranked on its own. A task keeps the best of a query over its blocks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Tables, arrow_schema, batch, keyed_groups
from lodestone.llm.vectors import cleaned, matrix

#: Vectors that the trees are fitted on, at most: those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: Members of a leaf, and visitors, of one block; candidates that a task gathers before it keeps the best.
BLOCK, GATHERED = 2048, 200_000


@dataclass
class Tree:
    """Split nodes as arrays; a child below 0 is leaf ~child. sizes: of the leaves, in the sample."""

    normals: np.ndarray
    cuts: np.ndarray
    spreads: np.ndarray
    low: list[int]
    high: list[int]
    sizes: list[int]

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0 if len(self.cuts) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            below = x[rows] @ self.normals[node] <= self.cuts[node]
            todo += [(self.low[node], rows[below]), (self.high[node], rows[~below])]
        return out


def grow(sample: np.ndarray, rng: np.random.Generator, leaf: int) -> Tree:
    normals, cuts, spreads, low, high, sizes = [], [], [], [], [], []

    def node(rows: np.ndarray) -> int:
        for _ in range(3 if len(rows) > leaf else 0):
            x = sample[rows]
            a, b = x[rng.choice(len(rows), 2, replace=False)]
            for _ in range(4):
                near = ((x - a) ** 2).sum(1) < ((x - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = x[near].mean(0), x[~near].mean(0)
            w = a - b
            size = np.linalg.norm(w)
            w = w / size if size > 1e-12 else rng.normal(size=x.shape[1]) / np.sqrt(x.shape[1])
            p = x @ w
            cut = float(np.median(p))
            below = p <= cut
            if below.all():  # many equal ones at the median
                cut = float(p[p < cut].max()) if (p < cut).any() else cut
                below = p <= cut
            if not below.all() and below.any():
                me = len(cuts)
                normals.append(w)
                cuts.append(cut)
                spreads.append(max(float(p.std()), 1e-300))
                low.append(0)
                high.append(0)
                low[me] = node(rows[below])
                high[me] = node(rows[~below])
                return me
        sizes.append(len(rows))
        return -len(sizes)  # ~(len(sizes) - 1)

    node(np.arange(len(sample)))
    return Tree(np.array(normals).reshape(len(cuts), sample.shape[1]), np.array(cuts), np.array(spreads), low, high, sizes)


#: log P(N(0, 1) <= z) at z = -8, -7.99, ..., 8, by its integral.
_Z = np.arange(-800, 801) / 100
_LOG = np.log(np.cumsum(np.exp(-(_Z**2) / 2)) * 0.01 / np.sqrt(2 * np.pi))


def visit(forest: list[Tree], x: np.ndarray, members: float, kinship: float) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves that one query visits, likeliest first, until they hold so many of the sample."""
    odds = []
    for t in forest:
        z = kinship / np.sqrt(1 - kinship**2) * (t.normals @ x - t.cuts) / t.spreads
        at = np.clip((z * 100).astype(np.int64) + 800, 0, 1600)
        odds.append((_LOG[1600 - at].tolist(), _LOG[at].tolist()))
    queue = [(0.0, k, 0 if len(t.cuts) else -1) for k, t in enumerate(forest)]
    out: list[tuple[int, int]] = []
    held = 0
    while queue and held < members:
        cost, k, node = heapq.heappop(queue)
        if node < 0:
            out.append((k, ~node))
            held += forest[k].sizes[~node]
            continue
        below, above = odds[k][0][node], odds[k][1][node]
        heapq.heappush(queue, (cost - below, k, forest[k].low[node]))
        heapq.heappush(queue, (cost - above, k, forest[k].high[node]))
    return out


def closest(a: np.ndarray, b: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest of b to each of a, ties to the smaller `first`. Products
    choose what may be among them, with a bound on their rounding; distances are of the differences."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    rough = aa[:, None] + bb[None] - 2 * (a @ b.T)
    slack = 4 * (a.shape[1] + 8) * np.finfo(float).eps * (aa + bb.max())
    most = min(k, len(b)) - 1
    limit = np.partition(rough, most, axis=1)[:, most] + 2 * slack
    i, j = np.nonzero(rough <= limit[:, None])
    d = np.empty(len(i))
    for lo in range(0, len(i), 1 << 14):
        s = slice(lo, lo + (1 << 14))
        d[s] = np.sqrt(((a[i[s]] - b[j[s]]) ** 2).sum(1))
    return best_of(i, j, d, first[j], k)


def best_of(i: np.ndarray, j: np.ndarray, d: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (i, j, d) the k of each i with the smallest d, ties to the smaller `first`."""
    order = np.lexsort((first, d, i))
    i, j, d = i[order], j[order], d[order]
    new = np.diff(i, prepend=i[:1] - 1) != 0
    rank = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(i) else np.zeros(0, np.int64)
    return i[rank < k], j[rank < k], d[rank < k]


def nearest(df: DataFrame, every: int = 100, k: int = 10, trees: int = 12, leaf: int = 16, share: float = 0.032, kinship: float = 0.45, sample_rows: int = SAMPLE_ROWS, seed: int = 11, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`,
    among all other rows. share: of the forest (the samples of all
    trees together) that the leaves hold which a query visits."""
    spark = df.sparkSession
    table = Tables(spark)
    rows = cleaned(df, vec_id, vector)
    rows = rows.withColumn("length", F.size("embedding"))
    top = rows.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    rows = rows.filter(F.col("length") == F.lit(top["length"] if top else 0)).drop("length")
    # equal vectors are one: each keeps its k + 1 smallest ids, limited before they are brought together
    window = Window.partitionBy("embedding").orderBy("vec_id")
    ids = rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= k + 1)
    classes = table(ids.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("class_id", F.col("ids")[0]), "classes")
    sample = classes.select("embedding", F.xxhash64("embedding").alias("h"), "class_id").orderBy("h", "class_id").limit(sample_rows).toArrow()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    points = matrix(sample.column("embedding")).astype(float)
    rng = np.random.default_rng(seed)
    forest = [grow(points, rng, leaf) for _ in range(trees)]
    model = spark.sparkContext.broadcast(forest)  # at most 2 * sample_rows / leaf splits a tree, whatever the table
    most = share * trees * len(points)
    # vectors travel as they are stored, as floats where they are floats
    kind = df.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"

    def members(batches):
        out = arrow_schema(f"tree int, leaf int, class_id bigint, embedding {kind}")
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = matrix(part.column(1)).astype(float)
                for n, t in enumerate(model.value):
                    yield batch(out, tree=np.full(len(x), n, "i4"), leaf=t.route(x), class_id=part.column(0), embedding=part.column(1))

    def visits(batches):
        out = arrow_schema(f"tree int, leaf int, query_id bigint, embedding {kind}")
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                met = [(i, n, f) for i, x in enumerate(matrix(part.column(1)).astype(float)) for n, f in visit(model.value, x, most, kinship)]
                i = np.array([m[0] for m in met], np.int64)
                yield batch(out, tree=[m[1] for m in met], leaf=[m[2] for m in met], query_id=part.column(0).take(i), embedding=part.column(1).take(i))

    is_asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    # queries with equal vectors are asked once, under their smallest id
    asked = table(rows.filter(is_asked).groupBy("embedding").agg(F.min("vec_id").alias("asked_id")), "asked")
    stored = F.col("embedding").cast(kind).alias("embedding")
    index = table(classes.select("class_id", stored).mapInArrow(members, f"tree int, leaf int, class_id bigint, embedding {kind}"), "index")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seeks = table(asked.select("asked_id", stored).repartition(n, "asked_id").mapInArrow(visits, f"tree int, leaf int, query_id bigint, embedding {kind}"), "visits")
    # one row for each leaf of the model on either side: bounded by the model's size
    here = index.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m_blocks"))
    there = seeks.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks"))
    sizes = F.broadcast(table(here.join(there, ["tree", "leaf"]), "leaves"))
    range_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, ["tree", "leaf"]).withColumn("m", F.pmod(F.xxhash64("class_id"), "m_blocks").cast("int")).withColumn("q", range_of("q_blocks"))
    right = seeks.join(sizes, ["tree", "leaf"]).withColumn("q", F.pmod(F.xxhash64("query_id"), "q_blocks").cast("int")).withColumn("m", range_of("m_blocks"))
    keys = ["tree", "leaf", "m", "q"]
    both = left.select(*keys, F.lit(False).alias("asks"), F.col("class_id").alias("id"), "embedding").unionByName(right.select(*keys, F.lit(True).alias("asks"), F.col("query_id").alias("id"), "embedding"))
    found = "asked_id bigint, class_id bigint, score double"

    def rank(batches):
        """A task's best k + 1 classes of each query: those of its blocks, brought together time and again."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def together():
            q, c, d = (np.concatenate(x) for x in zip(*best, strict=True))
            twice = np.lexsort((c, q))  # a class is met in several trees
            q, c, d = q[twice], c[twice], d[twice]
            new = (np.diff(q, prepend=q[:1] - 1) != 0) | (np.diff(c, prepend=c[:1] - 1) != 0)
            q, c, d = q[new], c[new], d[new]
            return best_of(q, c, d, c, k + 1)

        gathered = 0
        for _, group in keyed_groups(batches, keys):
            asks = group.column("asks").to_numpy()
            x, name = matrix(group.column("embedding")).astype(float), group.column("id").to_numpy()
            qi, mi = np.flatnonzero(asks), np.flatnonzero(~asks)
            for lo in range(0, len(qi) if len(mi) else 0, 256):
                some = qi[lo : lo + 256]
                i, j, d = closest(x[some], x[mi], name[mi], k + 1)
                best.append((name[some[i]], name[mi[j]], d))
                gathered += len(i)
                if gathered > GATHERED:
                    best[:] = [together()]
                    gathered = len(best[0][0])
                    if gathered > GATHERED // 2:  # so many queries that none of them is done here
                        yield batch(arrow_schema(found), asked_id=best[0][0], class_id=best[0][1], score=best[0][2])
                        best[:], gathered = [tuple(a[:0] for a in best[0])], 0
        q, c, d = together()
        yield batch(arrow_schema(found), asked_id=q, class_id=c, score=d)

    ranked = both.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(rank, found)
    # k + 1 classes a query, each with its k + 1 smallest ids: rows in proportion to the queries from here on
    merged = ranked.groupBy("asked_id", "class_id").agg(F.min("score").alias("score"))
    first = Window.partitionBy("asked_id").orderBy("score", "class_id")
    merged = merged.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).select("asked_id", "class_id", "score")
    merged = table(merged.join(classes.select("class_id", "ids"), "class_id").select("asked_id", "score", F.explode("ids").alias("vec_id")), "merged")
    first = Window.partitionBy("asked_id").orderBy("score", "vec_id")
    merged = table(merged.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1), "best")
    # every query with this vector: its own id goes, then the k first of the rest stay
    queries = rows.filter(is_asked).join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "asked_id")
    own = F.max(F.when(F.col("vec_id") == F.col("query_id"), F.col("place"))).over(Window.partitionBy("query_id"))
    got = queries.join(merged, "asked_id").withColumn("own", F.coalesce(own, F.lit(k + 2)))
    got = got.filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.col("place") - (F.col("place") > F.col("own")).cast("int"))
    return got.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").sortWithinPartitions("query_id", "rank")
