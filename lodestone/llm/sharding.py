"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions, racks and shards. A row descends it by its key: at each level every
child draws -ln(u) / weight, u a hash of the key and the child's name, and the smallest draw is taken. A child gets
rows in proportion to its weight, which is the sum of those of its shards. A draw depends on nothing but the key, the
child and its weight, so a changed weight moves rows only into or out of the subtree that holds it; all others keep
theirs. `Tree.grown` adds a shard as a region of its own, so what moves goes to that shard alone.

The key decides, and the tree: rows of one id share a shard, as do all rows without an id ('null' is their key). Sizes
are the UTF-8 bytes of the text plus 1 (null text: 1). Equal draws fall to the child named first. Any text, empty or
long, is a row; an empty table gives no rows. `assign` keeps all columns, and its own replace those of their names;
`slots` numbers the rows of each shard from 0 without gaps, in a keyed random order.

All of it is column expressions and DataFrame operations. No shard is sorted in one task: its order is cut into ranges
of the key's hash, ranges are counted first, and numbers within a range start at what lies before it. Rows that agree
in id, size and checksum are one row with a count until they are numbered, and come apart in runs of bounded length,
so copies of one row, however many, meet in no task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import free, table

#: Distinct rows of a range of the order, about, and copies that come from one row of a count.
RANGE_ROWS, RUN = 20_000, 4096


@dataclass(frozen=True)
class Tree:
    """(region, rack, shard, weight) of each shard; racks are named within their regions, shards by integers."""

    shards: tuple[tuple[str, str, int, float], ...]

    def __post_init__(self) -> None:
        if not self.shards or len({s[2] for s in self.shards}) < len(self.shards):
            raise ValueError("a tree has shards, each of them once")
        if any(not w > 0 for *_, w in self.shards):
            raise ValueError("weights are above 0")

    @staticmethod
    def even(regions: int = 2, racks: int = 2, shards: int = 2) -> Tree:
        """Shards 0, 1, ... of weight 1, so many a rack, racks a region and regions."""
        return Tree(tuple((f"r{i}", f"k{j}", (i * racks + j) * shards + k, 1.0) for i in range(regions) for j in range(racks) for k in range(shards)))

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own: it takes rows, and no other shard does."""
        regions, new = {r for r, *_ in self.shards}, max(s for _, _, s, _ in self.shards) + 1
        n = len(regions)
        while f"r{n}" in regions:
            n += 1
        return Tree((*self.shards, (f"r{n}", "k0", new, weight)))

    def weighted(self, shard: int, weight: float) -> Tree:
        """The tree with another weight for one shard."""
        return Tree(tuple((r, k, s, weight if s == shard else w) for r, k, s, w in self.shards))

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Name of each inner node -> (name, weight) of its children, in order; the root is ''."""
        out: dict[str, dict[str, float]] = {}
        for region, rack, shard, w in self.shards:
            for above, node in (("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", f"{region}/{rack}/{shard}")):
                kin = out.setdefault(above, {})
                kin[node] = kin.get(node, 0.0) + w
        return {above: list(kin.items()) for above, kin in out.items()}


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """-ln(u) / weight for u in (0, 1), of 52 bits."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("@"), node).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: three descents, each over the children of the node before. The tree is a literal of the
    plan, a few hundred bytes a rack."""
    kin = tree.children()
    of = lambda names: F.create_map(*[x for a in names for x in (F.lit(a), F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in kin[a]]))])
    at = F.lit("")
    for depth in range(3):
        level = of([a for a in kin if (a.count("/") + bool(a)) == depth])
        draws = F.transform(F.element_at(level, at), lambda c: F.struct(_draw(key, c["node"], c["weight"]).alias("draw"), c["node"].alias("node")))
        first = F.aggregate(draws, F.struct(F.lit(float("inf")).alias("draw"), F.lit("").alias("node")), lambda best, c: F.when(c["draw"] < best["draw"], c).otherwise(best))
        at = first["node"]
    return F.substring_index(at, "/", -1).cast("int")


def key_text(key: Column) -> Column:
    """A key as the text that is hashed; null is 'null'."""
    return F.coalesce(key.cast("string"), F.lit("null"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row: a projection."""
    return docs.withColumn(name, place(key_text(F.col(key)), tree))


def slots(rows: DataFrame, by: list[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """The columns `by` and shard of each row, and its slot: 0, 1, ... in each shard, in the order of a hash of `by`.
    Rows that agree in them all are interchangeable."""
    cols = [*by, shard]
    order, cell, n, start, run = (free(rows, x) for x in ("order", "cell", "n", "start", "run"))
    held = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    text = F.concat_ws(":", *[key_text(F.col(c)) for c in by])
    held = table(held.withColumn(order, F.md5(text.cast("binary"))), "sharded")
    ranges = max(16, held.count() // RANGE_ROWS)
    held = held.withColumn(cell, F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges).cast("int"))
    before = Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    cells = held.groupBy(shard, cell).agg(F.sum(n).alias("sum_")).withColumn("before_", F.coalesce(F.sum("sum_").over(before), F.lit(0)))
    cells = cells.select(F.col(shard).alias("shard_"), F.col(cell).alias("cell_"), "before_")
    within = Window.partitionBy(shard, cell).orderBy(order, *by).rowsBetween(Window.unboundedPreceding, -1)
    met = held.join(cells, F.col(shard).eqNullSafe(F.col("shard_")) & (F.col(cell) == F.col("cell_")))
    met = met.withColumn(start, F.col("before_") + F.coalesce(F.sum(n).over(within), F.lit(0)))
    seq = lambda to: F.explode(F.sequence(F.lit(0).cast("bigint"), to))
    once = met.filter(F.col(n) <= RUN).withColumn(run, seq(F.col(n) - 1)).withColumn(name, F.col(start) + F.col(run))
    # copies beyond one run: the runs are dealt out before they come apart
    runs = met.filter(F.col(n) > RUN).withColumn(run, seq(F.floor((F.col(n) - 1) / RUN))).repartition(*cols, run)
    many = runs.withColumn(name, seq(F.least(F.lit(RUN).cast("bigint"), F.col(n) - F.col(run) * RUN) - 1)).withColumn(name, F.col(start) + F.col(run) * RUN + F.col(name))
    return once.select(*cols, name).unionByName(many.select(*cols, name))


def shard(docs: DataFrame, tree: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    tree = tree or Tree.even()
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(key).alias("doc_id"), size_of(F.col(text)).alias("size"), crc.alias("text_crc32"))
    by = ["doc_id", "size", "text_crc32"]
    out = assign(slots(assign(rows, tree), by), tree.grown(), name="grown_shard")
    return out.select(*by, F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_level(depth: int, tree: Tree, source: str) -> str:
    kin = {a: k for a, k in tree.children().items() if (a.count("/") + bool(a)) == depth}
    rows = ", ".join(f"('{a}', '{n}', {i}, {w}::DOUBLE)" for a, k in kin.items() for i, (n, w) in enumerate(k))
    return f"""(SELECT key, arg_min(node, (draw, i)) AS here FROM (
      SELECT s.key, c.node, c.i, -ln((('0x' || substr(md5(s.key || '@' || c.node), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / c.weight AS draw
      FROM {source} s JOIN (VALUES {rows}) c(above, node, i, weight) ON c.above = s.here) GROUP BY key)"""


def _sql_place(tree: Tree) -> str:
    source = "(SELECT DISTINCT key, '' AS here FROM d)"
    for depth in range(3):
        source = _sql_level(depth, tree, source)
    return f"SELECT key, split_part(here, '/', 3)::INT AS shard FROM {source}"


#: The same for DuckDB. The checksum is folded byte by byte over a table of its 256 remainders.
SQL = f"""
WITH t AS (SELECT list(v ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(b))),
d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, coalesce(doc_id::VARCHAR, 'null') AS key,
         (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda a, b: xor(a // 256, t.crcs[(xor(a % 256, b) + 1)::BIGINT]))) AS text_crc32
  FROM documents, t),
o AS ({_sql_place(Tree.even())}),
g AS ({_sql_place(Tree.even().grown())})
SELECT d.doc_id, d.size, d.text_crc32::BIGINT AS text_crc32, 'key' AS law, o.shard,
       row_number() OVER (PARTITION BY o.shard ORDER BY md5(d.key || ':' || d.size || ':' || d.text_crc32), d.doc_id, d.size, d.text_crc32) - 1 AS slot,
       g.shard AS grown_shard
FROM d JOIN o USING (key) JOIN g USING (key)
"""
