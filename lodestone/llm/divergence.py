"""Source divergence audit: how far the word shares of the sources of a language lie apart.

Terms are runs of letters: `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, of which only A-Z are lower-cased. A language keeps the
V terms that stand in at least `least` of its documents. A group (lang, source), or a whole language, of N kept terms
gives a term that it holds `count` times the share p = 1 + floor(1000000000 * (count + 5) / (N + 5 * V)). The audit
gives, for each group, the sum of |p - q| over all kept terms against each other source of its language (part `pair`),
and the kept terms of the group whose p is furthest above the language's q (part `term`, the first `top`).

No table of all terms by all groups is made. With z the share of a term that a group does not hold, a pair (a, b) is
    sum over a's terms of |p_a - z_b| + sum over b's terms of |z_a - p_b|               one-sided: histograms of counts
    + sum over common terms of |p_a - p_b| - |p_a - z_b| - |z_a - p_b|                  overlap: postings of a term
    + (V - |a| - |b| + common) * |z_a - z_b|                                            in neither: a constant
and all of it is exact in 64 bits while N + 5 V stays below 9.2e15.

Null text, lang and source are ''. Every document counts, repeated ones too. A group without kept terms is a group: its
shares are all z; where a language keeps no term, its pairs have the value 0 and there is no term. Ranks run by value,
highest first, ties by the UTF-8 of the item. Texts of any length are read in pieces; an empty table gives no rows;
other columns are not read.

Documents are counted where they are read and only sums are shuffled, so a hot source or word costs no more than others;
postings of a term are at most as many as its language has sources, and their pairs are summed in the task that reads
them, never written out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_schema, batch, slices, starts_of, table, whole_groups

#: Entries and bytes of terms that a task counts before it passes them on; bytes of a text that are read at a time.
ENTRIES, ENTRY_BYTES, PIECE = 200_000, 16 << 20, 1 << 20
#: Pairs of postings that are priced at a time.
PAIRS = 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        part = text[at:end].translate(_LETTERS)
        while end < len(text) and (cut := part.rfind(b" ")) < 0:  # a term of over PIECE bytes
            end = min(end + len(part), len(text))
            part = text[at:end].translate(_LETTERS)
        if end < len(text):
            part = part[: cut + 1]
        at += len(part)
        yield part.split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of what the task reads, some terms more than once."""
    schema = arrow_schema("lang string, source string, term string, n bigint, docs bigint")
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for lo in range(0, len(terms), 10_000):
                some = terms[lo : lo + 10_000]
                yield batch(schema, lang=[lang] * len(some), source=[source] * len(some), term=pa.array(some, pa.binary()), n=[n[t] for t in some], docs=[docs[t] for t in some])
        held.clear()

    for b in batches:
        text = b.column(b.schema.get_field_index("text"))
        lang, source = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lang", "source"))
        for lo, hi in slices(text):
            for i, t in enumerate(text.slice(lo, hi - lo).cast(pa.binary()).to_pylist(), lo):
                if not t:
                    continue
                n, docs = held.setdefault((lang[i], source[i]), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in pieces(t):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                new = len(n) - before
                entries += new
                size += new * (sum(map(len, seen)) // max(1, len(seen)))
            if entries >= ENTRIES or size >= ENTRY_BYTES:
                yield from emit()
                entries = size = 0
    yield from emit()


def _share(count: str, total: str, kept: str) -> str:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)) by long division, three digits at a time."""
    d, rest, terms = f"({total} + 5L * {kept})", f"({count} + 5L)", []
    for scale in (1_000_000_000, 1_000_000, 1_000, 1):
        terms.append(f"({rest} div {d}) * {scale}L")
        rest = f"(({rest} % {d}) * 1000L)"
    return f"case when {d} > 0 then 1L + {' + '.join(terms)} end"


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, common, excess of each pair of groups, summed over the terms of a task: the input is sorted by term and
    group, and holds group, p and z of each posting."""
    schema = arrow_schema("a bigint, b bigint, common bigint, excess bigint")
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, common, excess = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(code, kind="stable")
        code = code[order]
        at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return code[at], np.add.reduceat(common[order], at), np.add.reduceat(excess[order], at)

    def out() -> pa.RecordBatch:
        code, common, excess = summed()
        return batch(schema, a=code >> 32, b=code & 0xFFFFFFFF, common=common, excess=excess)

    for t in whole_groups(batches, ["lang", "term"]):
        group, p, z = (t.column(c).to_numpy() for c in ("grp", "p", "z"))
        at = starts_of(t.combine_chunks(), ["lang", "term"])
        end = np.repeat(np.r_[at[1:], t.num_rows], np.diff(np.r_[at, t.num_rows]))
        right_of = end - np.arange(t.num_rows) - 1  # postings of the same term that follow
        through = np.cumsum(right_of)
        lo = 0
        while lo < t.num_rows:
            hi = max(lo + 1, int(np.searchsorted(through, (through[lo - 1] if lo else 0) + PAIRS, "right")))
            n = right_of[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            lo = hi
            if not len(left):
                continue
            code = group[left] << 32 | group[right]
            held.append((code, np.ones(len(code), np.int64), abs(p[left] - p[right]) - abs(p[left] - z[right]) - abs(z[left] - p[right])))
            if sum(len(c) for c, *_ in held) >= 2 * PAIRS:
                held = [summed()]
                if len(held[0][0]) >= PAIRS:
                    yield out()
                    held = []
    if held:
        yield out()


def audit(docs: DataFrame, least: int = 30, top: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank (see the module)."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(own(lang).alias("lang"), own(source).alias("source"), F.col(text).alias("text"))
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # the exchange above serves it too
    postings = counted.withColumns({"term_docs": F.sum("docs").over(of_term), "term_n": F.sum("n").over(of_term), "lead": F.min("source").over(of_term) == F.col("source")})
    postings = table(postings.filter(F.col("term_docs") >= least).select("lang", "source", "term", "n", "term_n", "lead"), "postings")
    # one row a group, one a language
    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("lead").cast("bigint")).alias("v"))
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(held, ["lang", "source"], "left").fillna(0, ["lang_n", "v", "total", "terms"])
    groups = groups.withColumn("z", F.coalesce(F.expr(_share("0L", "total", "v")), F.lit(0).cast("bigint")))
    groups = groups.withColumns({"grp": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lang", "source")).cast("bigint"), "z_top": F.max("z").over(Window.partitionBy("lang"))})
    groups = table(groups, "groups")

    of_group = groups.select("lang", "source", "grp", "total", "lang_n", "v", "z", "z_top")
    scored = postings.join(of_group, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "v")))
    above = scored.withColumn("value", F.col("p") - F.expr(_share("term_n", "lang_n", "v"))).filter("value > 0")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)

    # shares of at least every z of the language need no comparison: such bars of a histogram fold into one
    bars = postings.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k")).join(of_group, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "v")))
    bars = bars.groupBy("lang", F.col("grp").alias("a"), F.least("p", "z_top").alias("bar")).agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("p")).alias("p_sum"), F.max("z_top").alias("z_top"))
    others = groups.select("lang", F.col("grp").alias("b"), F.col("z").alias("z_b"))
    one_sided = bars.join(others, "lang").filter("a <> b").groupBy("a", "b").agg(F.sum(F.when(F.col("bar") < F.col("z_top"), F.col("k") * F.abs(F.col("bar") - F.col("z_b"))).otherwise(F.col("p_sum") - F.col("k") * F.col("z_b"))).alias("sum"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = scored.select("lang", "term", "grp", "p", "z").repartition(n, "lang", "term").sortWithinPartitions("lang", "term", "grp")
    common = met.mapInArrow(_overlaps, "a bigint, b bigint, common bigint, excess bigint")

    zero = F.lit(0).cast("bigint")
    both = lambda df, *cols: df.select("a", "b", *cols).unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), *cols))
    ends = groups.select("lang", F.col("grp").alias("a"), F.col("source").alias("source"), F.col("terms").alias("t_a"), F.col("z").alias("z_a"), "v")
    ends = ends.join(groups.select("lang", F.col("grp").alias("b"), F.col("source").alias("item"), F.col("terms").alias("t_b"), F.col("z").alias("z_b")), "lang").filter("a <> b")
    sums = both(one_sided, F.col("sum"), zero.alias("common")).unionByName(both(common, F.col("excess").alias("sum"), F.col("common")))
    sums = sums.groupBy("a", "b").agg(F.sum("sum").alias("sum"), F.sum("common").alias("common"))
    value = F.coalesce("sum", zero) + (F.col("v") - F.col("t_a") - F.col("t_b") + F.coalesce("common", zero)) * F.abs(F.col("z_a") - F.col("z_b"))
    pairs = ends.join(sums, ["a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(first)).unionByName(terms)


#: The same for DuckDB, over all kept terms by all groups.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
x AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM x GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
h AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
      FROM g LEFT JOIN (SELECT c.* FROM c SEMI JOIN k ON c.lang = k.lang AND c.term = k.term) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
s AS (SELECT h.lang, h.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (h.total + 5 * l.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
      FROM h JOIN l ON l.lang = h.lang JOIN k ON k.lang = h.lang LEFT JOIN c ON c.lang = h.lang AND c.source = h.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
