"""Quality classifier: a sparse rule ensemble.

Shallow boosted trees over text statistics are fitted to a bounded sample of labelled rows; every path
from a root to a node is a conjunctive rule; lasso logistic regression keeps the few rules that matter;
these are compiled into one Spark column expression, and scoring is a projection inside the JVM.

A null text counts as empty. Statistics are defined for every text: shares of an empty text are 0.
Labels of 0 and 1 teach; others and null labels do not, nor do ids whose labels disagree. Repeated label
rows teach once. Without rows of both labels every score is the share of ones learned (0.5 if none).
Only the columns named are read, so extra columns with any names are harmless.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import free

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, all of them doubles."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    share = lambda pattern: (F.length(t) - without(pattern)) / n
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda w: w != "")
    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
        "upper": share(r"\p{Lu}+"),
        "symbols": share(r"[#$%&*+<=>@^~`\\{}\[\]_|]+"),
        "pipes": (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))) / n,
        "exclaims": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) / n,
        "stops": (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))) / n,
        "commas": (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))) / n,
        "digits": share(r"[0-9]+"),
        "spaces": share(r"[\x20\x09-\x0D]+"),
    }


def derive(s) -> dict:
    """Statistics from the counted ones; s maps names to columns or arrays."""
    one = (lambda x: F.greatest(x, F.lit(1.0))) if isinstance(s["chars"], Column) else (lambda x: np.maximum(x, 1.0))
    out = dict(s)
    out["word_length"] = s["chars"] / one(s["words"])
    out["distinct_word_share"] = s["distinct_words"] / one(s["words"])
    out["distinct_line_share"] = s["distinct_lines"] / one(s["lines"])
    out["line_words"] = s["words"] / one(s["lines"])
    out["stops_a_word"] = s["stops"] * s["chars"] / one(s["words"])
    out["commas_a_word"] = s["commas"] * s["chars"] / one(s["words"])
    out["marks_a_word"] = (s["symbols"] + s["exclaims"]) * s["chars"] / one(s["words"])
    return out


Rule = tuple[tuple[str, bool, float], ...]  # of (statistic, above, threshold)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a Spark expression over columns of statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = None
            for name, above, threshold in rule:
                c = stats[name] > threshold if above else stats[name] <= threshold
                holds = c if holds is None else holds & c
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(stats["chars"]), self.intercept)
        for rule, weight in self.rules:
            z += weight * _holds(rule, stats)
        return 1 / (1 + np.exp(-z))


def _holds(rule: Rule, stats: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(stats["chars"]), bool)
    for name, above, threshold in rule:
        out &= (stats[name] > threshold) if above else (stats[name] <= threshold)
    return out


def _grow(stats: dict[str, np.ndarray], cuts: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], step: np.ndarray, least: int) -> None:
    """One boosted tree: adds the path of each node to rules and each leaf's value to step."""
    G, H = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if depth:
        for name, at in cuts.items():
            if not len(at):
                continue
            b = np.searchsorted(at, stats[name][rows], side="left")  # x <= at[b]
            n = np.bincount(b, minlength=len(at) + 1).cumsum()[:-1]
            gl = np.bincount(b, g[rows], len(at) + 1).cumsum()[:-1]
            hl = np.bincount(b, h[rows], len(at) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (name, at[i]))
    if best[1] is None:
        step[rows] = G / (H + 1)
        return
    name, threshold = best[1]
    low = stats[name][rows] <= threshold
    for side, above in ((rows[low], False), (rows[~low], True)):
        to = (*path, (name, above, float(threshold)))
        rules.append(to)
        _grow(stats, cuts, g, h, side, depth - 1, to, rules, step, least)


def _tight(rule: Rule) -> Rule:
    """The rule with one bound a statistic and side."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, above, threshold in rule:
        old = bounds.get((name, above), threshold)
        bounds[name, above] = max(old, threshold) if above else min(old, threshold)
    return tuple((name, above, threshold) for (name, above), threshold in bounds.items())


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, k = x.shape
    u = np.ones(k)
    for _ in range(20):
        u = x.T @ (x @ u)
        u /= np.linalg.norm(u) + 1e-12
    rate = 4 * n / (np.linalg.norm(x @ u) ** 2 + n)
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-(x @ v + c))) - y) / n
        w2 = v - rate * (x.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = c - rate * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def fit(stats: dict[str, np.ndarray], y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 48, most_rules: int = 300, penalties: tuple[float, ...] = (0.02, 0.005, 0.002, 0.0007)) -> RuleEnsemble:
    """A rule ensemble for labels y; the penalty is the one that does best on a held-back fifth of the rows."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 0.001), 0.999) if len(y) else 0.5
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    stats = {k: np.asarray(v, float) for k, v in stats.items()}
    cuts = {k: (u[:-1] + u[1:]) / 2 if len(u := np.unique(np.quantile(v, np.linspace(0, 1, bins), method="nearest"))) > 1 else np.zeros(0) for k, v in stats.items()}
    f, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        _grow(stats, cuts, y - p, p * (1 - p), np.arange(len(y)), depth, (), rules, step, max(3, len(y) // 500))
        f += 0.3 * step
    seen, unique, x = set(), [], []
    for rule in rules:
        if len(unique) < most_rules and (mark := (col := _holds(rule, stats)).tobytes()) not in seen:
            seen.add(mark)
            unique.append(_tight(rule))
            x.append(col)
    if not unique:
        p = float(y.mean())
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    x = np.array(x, float).T
    back = np.arange(len(y)) % 5 == 4
    best = (np.inf, penalties[-1])
    for penalty in penalties if 0 < y[~back].mean() < 1 and back.any() else ():
        b, w = _lasso(x[~back], y[~back], penalty)
        z = x[back] @ w + b
        loss = float(np.mean(np.logaddexp(0, z) - y[back] * z))
        if loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = _lasso(x, y, best[1])
    return RuleEnsemble(float(b), tuple((unique[i], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-6)))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from learning: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """The ensemble of labels' rows outside the held-out fold; labels has doc_id and the label. Of documents that
    share an id, the smallest text teaches."""
    known = labels.select("doc_id", F.col(label).alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").select("doc_id", "y")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded, so it may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    stats = statistics(F.col("text"))
    got = found.select(F.col("doc_id").alias("id_"), F.col("y").cast("double").alias("y_"), *[c.alias(k) for k, c in stats.items()]).toPandas().sort_values("id_")  # sample_rows at most
    return fit(derive({k: got[k].to_numpy(float) for k in stats}), got["y_"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1. The statistics pass through a generator, so that no
    filter on the score is pushed below them and each is computed once."""
    stats = statistics(F.col(text))
    at = free(docs, "stats")
    held = docs.withColumn(at, F.explode(F.array(F.struct(*[c.alias(k) for k, c in stats.items()]))))
    return held.withColumn(name, model.column(derive({k: F.col(f"`{at}`.{k}") for k in stats}))).drop(at)
