"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are values after an assignment, the parts of such values and of URLs between : @ = & and ?, long
runs of key characters, and every known form of a key. They may lie in each other. Each is described by its
length, its character transitions, how much of it a dictionary covers, marks of the path that its text
came from, and the words around it; a forest of randomised trees, trained from labelled findings, says
how likely it is a secret. The dictionary is counted from documents: the words that most of them hold, as many as
`MOST_WORDS`, so it has a bound and is sent to all tasks; the few fixed words that placeholders are made of are in it
always. Where no findings are labelled, `planted_findings` sets drawn values among the words of given documents.

The forest is fitted on a bounded set of findings (at most `MOST_FINDINGS`, those first in a fixed
order). Without labels of both kinds it gives every candidate the share of ones that it saw, or 0.5.
A null text has no candidates, nor has an empty one; a null path has no marks; texts are scanned whole
in linear time; rows are independent, so repeated rows and ids need no care. Other columns are kept;
result columns replace columns of their names. All candidates are scored; of overlapping
ones that reach the threshold the best scored stays, of equal scores the longest, then the first.
"""

from __future__ import annotations

import bisect
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import arrow_schema, batch, table

MOST_FINDINGS = 20_000
#: Words of a dictionary, at most, the documents that each is in, at least, and their lengths.
MOST_WORDS, LEAST_DOCS, SHORTEST, LONGEST = 50_000, 5, 4, 16
#: Words that made-up or descriptive values are put together from.
DICTIONARY = tuple("example sample test dummy placeholder changeme your password secret token key api value string user admin default none null true false insert here replace redacted hidden development production config local host server client access private public auth login name path file http https www com org net the and for with this that from into over under about table index version release build module package function return class import object number array list map set get put post delete update select where".split())
SECRET_WORDS = re.compile(r"token|secret|passw|pwd|api.?key|auth|credential|private|bearer|access.?key|signature", re.I)
BENIGN_WORDS = re.compile(r"example|sample|test|dummy|sha|md5|hash|checksum|commit|uuid|guid|digest|version|fixture|placeholder|isbn|doi|url", re.I)
PATH_TEST = re.compile(r"test|spec|example|fixture|mock|doc|sample|vendor", re.I)
PATH_CONFIG = re.compile(r"\.(?:env|ya?ml|json|ini|cfg|conf|toml|properties|pem|key)$|config|secret|deploy", re.I)
KNOWN = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[opusr]_[A-Za-z0-9]{36}|xox[abprs]-|sk_live_|AIza[0-9A-Za-z_-]{35}$|eyJ[A-Za-z0-9_-]+")
_ASSIGNED = re.compile(r"(?<=[:=])[ \t]*([\"'`]?)([^\s\"'`,;<>{}()]{8,})")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_PART = re.compile(r"[^:@=&?]{8,}")
#: The forms of KNOWN, wherever they stand, with or without digits.
_FORM = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[opusr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]*|sk_live_[A-Za-z0-9]*|AIza[0-9A-Za-z_-]{35}(?![A-Za-z0-9_-])|eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*)")
AROUND = 40


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that could be secrets, in their order; they may overlap."""
    found = [m.span() for m in _FORM.finditer(text)]
    found += [m.span() for m in _RUN.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(2)
        found.append((start, end))
        for part in _PART.finditer(text, start, end):
            if part.span() != (start, end):
                found.append((part.start() + len(part[0]) - len(part[0].lstrip("/")), part.end()))
    out = set()
    for start, end in found:
        while end > start and text[end - 1] in "!#$%&*.?|":  # marks that follow the value
            end -= 1
        if end - start >= 8:
            out.add((start, end))
    return sorted(out, key=lambda s: (s[0], -s[1]))


def settled(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of overlapping spans (start, end, score) the best, apart from each other and in their order."""
    out: list[tuple[int, int, float]] = []
    for f in sorted(found, key=lambda f: (-f[2], f[0] - f[1], f[0])):
        at = bisect.bisect(out, f)
        if (at == 0 or out[at - 1][1] <= f[0]) and (at == len(out) or f[1] <= out[at][0]):
            out.insert(at, f)
    return out


_CLASS = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}
_VOWELS = frozenset("aeiouyAEIOUY")
FEATURES = ("length", "transitions", "longest_run", "digits", "upper", "lower", "other", "vowels", "hex", "distinct", "entropy", "pairs", "coverage", "known", "secret_before", "benign_before", "benign_after", "assigned", "quoted", "path_test", "path_config")


def dictionary(docs: DataFrame, text: str = "text") -> frozenset[str]:
    """The words of SHORTEST to LONGEST letters a-z that stand in most documents, in LEAST_DOCS at least: those in as many
    as the smallest number that no more than MOST_WORDS words reach. Every document counts, however long."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w).between(SHORTEST, LONGEST)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DOCS)
    counts = table(counts, "words")
    reach = F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n")))  # a row a count
    least = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("reach", reach).filter(F.col("reach") <= MOST_WORDS).agg(F.min("n")).first()[0]
    return frozenset(r["word"] for r in counts.filter(F.col("n") >= least).select("word").collect()) if least is not None else frozenset()


def coverage(low: str, words: frozenset[str]) -> np.ndarray:
    """Which characters of a value in lower case lie in a word of the dictionary."""
    covered = np.zeros(len(low), bool)
    for w in DICTIONARY:
        at = low.find(w) if len(w) >= 3 else -1
        while at >= 0:
            covered[at : at + len(w)] = True
            at = low.find(w, at + 1)
    if words:
        for n in range(SHORTEST, min(LONGEST, len(low)) + 1):
            for at in range(len(low) - n + 1):
                if low[at : at + n] in words:
                    covered[at : at + n] = True
    return covered


def features(text: str, start: int, end: int, path: str | None, words: frozenset[str] = frozenset()) -> list[float]:
    """FEATURES of one candidate."""
    s = text[start:end]
    n = len(s)
    kinds = [_CLASS.get(c, 3) for c in s]
    changes = [i for i in range(1, n) if kinds[i] != kinds[i - 1]]
    runs = np.diff([0, *changes, n])
    counts = np.bincount(kinds, minlength=4) / n
    letters = [c for c in s if c.isalpha()]
    freq = np.unique([ord(c) for c in s], return_counts=True)[1] / n
    # consonant-vowel alternation is what the transitions of words have and those of keys lack
    pairs = sum((a in _VOWELS) != (b in _VOWELS) for a, b in zip(s, s[1:], strict=False) if a.isalpha() and b.isalpha()) / max(n - 1, 1)
    low = s.lower()
    covered = coverage(low if len(low) == n else s, words)
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    head = before.rstrip(" \t\"'`")
    return [
        n, len(changes) / n, max(runs) / n, counts[2], counts[1], counts[0], counts[3],
        sum(c in _VOWELS for c in letters) / max(len(letters), 1), float(all(c in string.hexdigits for c in s)), len(freq) / n, float(-(freq * np.log2(freq)).sum()), pairs,
        covered.mean(), float(bool(KNOWN.match(s))),
        float(bool(SECRET_WORDS.search(before))), float(bool(BENIGN_WORDS.search(before))), float(bool(BENIGN_WORDS.search(after))), float(head[-1:] in ("=", ":")), float(before[-1:] in "\"'`" and before != ""),
        float(bool(path and PATH_TEST.search(path))), float(bool(path and PATH_CONFIG.search(path))),
    ]


@dataclass
class Forest:
    """Trees as arrays of (feature, cut, low, high, share of ones); feature -1 is a leaf. words is the dictionary that
    they were trained with."""

    trees: list[tuple[np.ndarray, ...]]
    words: frozenset[str] = frozenset()

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, low, high, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                i = np.flatnonzero(inner)
                at = node[i]
                node[i] = np.where(x[i, feature[at]] <= cut[at], low[at], high[at])
            out += share[node]
        return out / max(len(self.trees), 1)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 12, least: int = 3, seed: int = 3) -> Forest:
    """A random forest: bootstrap rows, a random third of the features and random cuts at each split, by Gini gain."""
    rng = np.random.default_rng(seed)
    base = float(y.mean()) if len(y) else 0.5
    if not len(y) or base in (0.0, 1.0):
        return Forest([(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.array([base]))])
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        nodes: list[list[float]] = []

        def grow(r: np.ndarray, left: int, nodes=nodes) -> int:
            me = len(nodes)
            p = y[r].mean()
            nodes.append([-1, 0.0, 0, 0, p])
            if not left or p in (0.0, 1.0) or len(r) < 2 * least:
                return me
            best = (1e-9, None)
            for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
                v = x[r, f]
                lo, hi = v.min(), v.max()
                if lo == hi:
                    continue
                for c in np.unique(np.append(rng.choice(v, 8), rng.uniform(lo, hi, 4))):
                    b = v <= c
                    n = int(b.sum())
                    if least <= n <= len(r) - least:
                        q1, q2 = y[r[b]].mean(), y[r[~b]].mean()
                        gain = p * (1 - p) - (n * q1 * (1 - q1) + (len(r) - n) * q2 * (1 - q2)) / len(r)
                        if gain > best[0]:
                            best = (gain, (int(f), float(c), b))
            if best[1] is None:
                return me
            f, c, b = best[1]
            nodes[me][:2] = [f, c]
            nodes[me][2] = grow(r[b], left - 1)
            nodes[me][3] = grow(r[~b], left - 1)
            return me

        grow(rows, depth)
        a = np.array(nodes, float)
        out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(out)


def train(findings: DataFrame, words: frozenset[str] = frozenset()) -> Forest:
    """A forest from labelled findings: text, start_at, end_at (of the value), path, label 0 or 1; words is a dictionary
    of `dictionary`."""
    rows = findings.select("text", "start_at", "end_at", "path", "label").filter("text is not null and label in (0, 1) and start_at >= 0 and end_at > start_at and end_at <= length(text)").distinct()
    got = rows.orderBy("text", "start_at", "end_at", "path", "label").limit(MOST_FINDINGS).collect()
    x = np.array([features(r["text"], r["start_at"], r["end_at"], r["path"], words) for r in got], float).reshape(len(got), len(FEATURES))
    forest = fit(x, np.array([r["label"] for r in got], float))
    forest.words = words
    return forest


def scan(df: DataFrame, forest: Forest, threshold: float = 0.5, text: str = "text", path: str | None = "source", secrets: str = "secrets", n_candidates: str = "n_candidates") -> DataFrame:
    """df with n_candidates, and secrets: array of (start, end, score) of those scored at the threshold or above."""
    kind = T._parse_datatype_string("array<struct<start:int,end:int,score:double>>")
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in (secrets, n_candidates)), T.StructField(n_candidates, T.IntegerType()), T.StructField(secrets, kind)])
    model = df.sparkSession.sparkContext.broadcast(forest)  # its size is set by the number and depth of trees, and MOST_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            paths = b.column(b.schema.get_field_index(path)).to_pylist() if path else [None] * len(texts)
            spans = [candidates(t) if t else [] for t in texts]
            x = np.array([features(t, s, e, p, model.value.words) for t, p, each in zip(texts, paths, spans, strict=True) for s, e in each], float).reshape(-1, len(FEATURES))
            scores = iter(model.value.predict(x).tolist())
            scored = [[(s, e, next(scores)) for s, e in each] for each in spans]
            found = [[{"start": s, "end": e, "score": v} for s, e, v in settled([x for x in each if x[2] >= threshold])] for each in scored]
            cols = {f.name: b.column(b.schema.get_field_index(f.name)) for f in schema if f.name not in (secrets, n_candidates)}
            yield batch(out, **cols, **{n_candidates: [len(s) for s in spans], secrets: found})

    return df.mapInArrow(run, schema)


def example_findings(n: int = 4000, seed: int = 17) -> list[tuple[str, int, int, str | None, int]]:
    """Labelled findings in the forms that scanners report, drawn at random: keys and passwords in assignments,
    and what is mistaken for them (digests, names, placeholders, paths, identifiers). An eighth as many are in
    addresses: the password or key alone is the secret, the address around it and its other parts are not."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda chars, k: "".join(pick(chars) for _ in range(int(k)))
    syllables = "an ou ti er re th st in on ed le de la que en au ver ung che men ta co".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 9))))
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    real = [lambda: draw(hexa, pick([32, 40, 64])), lambda: draw(alnum, rng.integers(24, 48)), lambda: draw(b64, 40), lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + draw(alnum, 36), lambda: draw(alnum + "!@#%^&*", rng.integers(10, 20)), lambda: draw(hexa, 40).upper()]
    placeholder = [lambda: "your-" + pick(DICTIONARY) + "-" + pick(DICTIONARY), lambda: "x" * int(rng.integers(8, 30)), lambda: "_".join(pick(DICTIONARY) for _ in range(4)), lambda: "changeme" + str(int(rng.integers(1000))), lambda: "https://www.example.com/" + word() + "/" + word(), lambda: word() + word() + word() + word() + str(int(rng.integers(99)))]
    benign = [lambda: draw(hexa, pick([32, 40, 64])), lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: word() + "/" + word() + "/" + word() + "-" + str(int(rng.integers(99))) + "/" + word(), lambda: "-".join(word() for _ in range(5)) + str(int(rng.integers(9))), lambda: "THE" + draw(string.ascii_uppercase, 20) + "1"]
    names = ["token", "secret", "api_key", "password", "auth_token", "SECRET_KEY", "access_key", "TOKEN", "client_secret", "credential"]
    other = ["sha256", "commit", "md5", "checksum", "uuid", "id", "digest", "version", "title", "build", "etag"]
    paths = [None, "src3", "src17", "app/config.yaml", "deploy/.env", "src/main.py", "tests/test_auth.py", "docs/example.md", "lib/util.js"]
    out = []
    for _ in range(n):
        kind = int(rng.integers(6))
        quote = pick(['"', "'", ""])
        gap = pick([" = ", "=", ": ", ":"])
        path = pick(paths)
        if kind <= 2:
            value, label, head = pick(real)(), 1, pick(names) + gap + quote
        elif kind == 3:
            value, label, head = pick(placeholder)(), 0, pick(names) + gap + quote
        elif kind == 4:
            value, label, head = pick(benign)(), 0, pick(other) + pick([gap, " "]) + quote
        else:
            value, label, head = pick([*benign[1:], *placeholder[2:]])(), 0, ""
            quote = ""
        before = prose() + pick([" ", "\n"]) + head
        out.append((before + value + quote + pick([" ", "\n", "### ", "!! "]) + prose(), len(before), len(before) + len(value), path, label))
    for _ in range(n // 8):
        host = word() + "." + word() + pick([".com", ".example.com", ".net", ".org"])
        value, path = pick(real)(), pick(paths)
        if rng.integers(2):
            user = word() + word()
            parts = [pick(["postgres", "mysql", "https", "redis", "amqp"]) + "://", user, ":", value, "@", host, "/" + word() + word()]
            plain = [parts[5] + parts[6], user]
        else:
            parts = ["https://", host, "/" + word() + "?" + pick(["id", "page", "q"]) + "=" + word() + "&", pick(names) + "=", value, "", ""]
            plain = [host + parts[2].partition("?")[0]]
        before = prose() + pick([" ", " url=", ": "])
        address = "".join(parts)
        text, at = before + address + pick([" ", "\n"]) + prose(), len(before)
        spans = [(address.index(value), value, 1), (0, address, 0), *((address.index(x), x, 0) for x in plain)]
        if "://" in address:
            rest = address[address.index("://") + 1 :]
            spans.append((address.index("://") + 1, rest, 0))
        out += [(text, at + i, at + i + len(x), path, label) for i, x, label in spans if len(x) >= 8]
    return out


def planted_findings(docs: DataFrame, n: int = 2000, seed: int = 5, text: str = "text", path: str | None = "source") -> DataFrame:
    """Labelled findings in the words of documents: of the n documents first by the hash of seed and text, each gets one
    of `example_findings`, value and what it is assigned to, between two of its words, and its own path. (Where very many
    documents are copies of few, it may be somewhat fewer.)"""
    drawn = example_findings(n, seed)
    made = [(k, t[max(0, t.rfind(" ", 0, s - 24), t.rfind("\n", 0, s)) + 1 : s], t[s:e], y) for k, (t, s, e, _, y) in enumerate(drawn[:n])]
    values = docs.sparkSession.createDataFrame(made, "k int, head string, value string, label int")
    own = F.col(path).cast("string") if path else F.lit(None).cast("string")
    some = docs.filter(F.length(text) > 0).select(F.col(text).alias("t"), own.alias("path"))
    at, order = F.pmod(F.xxhash64("t"), F.length("t")).cast("int"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("t")).cast("binary"))
    before = F.regexp_replace(F.substring("t", F.greatest(at - 80, F.lit(1)), F.lit(80)), r"\S*$", "")
    after = F.regexp_replace(F.substring("t", at + 1, F.lit(80)), r"^\S*", "")
    # a share of the hashes that holds about half as many again goes to the one place where the first n are told
    share = 1.5 * n / max(1, some.count())
    some = some.select(order.alias("order"), "path", before.alias("before"), after.alias("after")).filter(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") < share * float(1 << 32))
    some = some.orderBy("order", "path", "before").limit(n)
    some = some.withColumn("k", F.row_number().over(Window.orderBy("order", "path", "before")) - 1)  # n rows
    met = some.select("k", "path", "before", "after").join(values, "k")
    met = met.withColumn("start_at", F.length(F.concat("before", "head")))
    quote = F.regexp_extract("head", "([\"'])$", 1)
    return met.select(F.concat("before", "head", "value", quote, "after").alias("text"), "start_at", (F.col("start_at") + F.length("value")).alias("end_at"), "path", "label")
