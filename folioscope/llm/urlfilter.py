"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are fitted by second-order boosting of the logistic loss over histograms of a bounded sample of labelled
URLs; statistics of host suffixes are counted over all labelled URLs. The features describe the spelling only:
lengths, depth, shares of character kinds, entropy, parameters and suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_bytes

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    #: Labelled URLs that the trees are fitted on, chosen by a hash of the URL.
    fit_rows: int = 20_000
    trees: int = 40
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    least_weight: float = 5.0
    penalty: float = 1.0


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? or #, A-Z lower-cased; empty for null and where there is no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule whose host is the host or a parent of it and whose path begins the path; null without one."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


FEATURES = (
    "length", "host length", "path length", "query length", "labels", "depth", "longest segment", "digit ratio", "host digit ratio", "hyphens", "host hyphens", "upper ratio", "symbol ratio",
    "entropy", "host entropy", "parameters", "fragment", "secure", "suffix block rate", "suffix share", "wide suffix block rate", "wide suffix share", "file suffix length",
)


def counts(data: np.ndarray, offsets: np.ndarray, chars: str) -> np.ndarray:
    hit = np.isin(data, np.frombuffer(chars.encode(), np.uint8))
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets]).astype(float)


def entropy(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) if len(data) else np.zeros((n, 256))
    p = table / np.maximum(table.sum(1, keepdims=True), 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def features(url: pa.Array, host: pa.Array, path: pa.Array, narrow: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """narrow, wide: (block rate, share) of each host's suffix of one label and of two."""
    u, uo = text_bytes(url)
    h, ho = text_bytes(host)
    p, po = text_bytes(path)
    digits = "0123456789"
    lu, lh, lp = (np.diff(o).astype(float) for o in (uo, ho, po))
    paths, urls, hosts = path.to_pylist(), url.to_pylist(), host.to_pylist()
    longest = np.array([max(map(len, (x or "").split("/"))) for x in paths], float)
    tail = np.array([len(t) - t.rfind(".") if "." in (t := (x or "").rsplit("/", 1)[-1]) else 0 for x in paths], float)
    query = np.array([len(q) for x in urls for q in [(x or "").partition("#")[0].partition("?")[2]]], float)
    one = lambda x: np.maximum(x, 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return np.stack([
        lu, lh, lp, query, counts(h, ho, ".") + 1, counts(p, po, "/"), longest, counts(u, uo, digits) / one(lu), counts(h, ho, digits) / one(lh), counts(u, uo, "-"), counts(h, ho, "-"),
        counts(u, uo, upper) / one(lu), counts(u, uo, "%_=&;+~!$@") / one(lu), entropy(u, uo), entropy(h, ho), counts(u, uo, "&") + (query > 0), np.array(["#" in (x or "") for x in urls], float),
        np.array([(x or "").startswith("https") for x in urls], float), narrow[:, 0], narrow[:, 1], wide[:, 0], wide[:, 1], tail,
    ], 1)


@dataclass
class Trees:
    """Boosted trees as arrays: node k has children 2k + 1 and 2k + 2; a row goes left where its feature is at most the cut."""

    base: float
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - (len(v) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Trees:
    inner, leaves = 2**s.depth - 1, 2**s.depth
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    out = Trees(float(np.log(rate / (1 - rate))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), s.depth)
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, s.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)  # bin b: above edge b - 1, at most edge b
    total, n = np.full(len(y), out.base), x.shape[1]
    features_, cuts, values = [], [], []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(s.depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for f in range(n):
                if not len(edges[f]):
                    continue
                cell = (node - first) * s.bins + binned[:, f]
                gs = np.bincount(cell, g, width * s.bins).reshape(width, s.bins).cumsum(1)
                hs = np.bincount(cell, h, width * s.bins).reshape(width, s.bins).cumsum(1)
                gl, hl, gt, ht = gs[:, : len(edges[f])], hs[:, : len(edges[f])], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + s.penalty) + (gt - gl) ** 2 / (ht - hl + s.penalty) - gt**2 / (ht + s.penalty)
                gain[(hl < s.least_weight) | (ht - hl < s.least_weight)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -s.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + s.penalty)
        total = total + value[leaf]
        features_.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(out.base, np.array(features_), np.array(cuts), np.array(values), s.depth)


SUFFIX = ("narrow_rate", "narrow_share", "wide_rate", "wide_share")


def with_suffixes(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """rows with the statistics, over all labelled URLs, of their hosts' suffixes; the prior and 0 where none is labelled.

    They are joined to the distinct hosts first, so the URLs of a host meet one row.
    """
    total, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    prior = (blocked + 0.5) / (total + 1)
    hosts = rows.select("host").distinct()
    by_host = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("k"))
    for labels, name in ((1, "narrow"), (2, "wide")):
        known = by_host.groupBy(suffix_of(F.col("host"), labels).alias("suffix")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        rate, share = (F.col("k") + F.lit(10 * prior)) / (F.col("n") + 10), F.col("n") / F.lit(total)
        known = known.where("suffix <> ''").select("suffix", rate.alias(f"{name}_rate"), share.alias(f"{name}_share"))
        hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), labels)).join(known, "suffix", "left").drop("suffix")
    hosts = hosts.select("host", *(F.coalesce(c, F.lit(prior if c.endswith("rate") else 0.0)).alias(c) for c in SUFFIX))
    return rows.join(hosts, "host", "left")


def features_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    text = [pa.array(batch.column(c).to_pylist(), pa.string()) for c in ("url", "host", "path")]
    numbers = np.stack([np.asarray(batch.column(c), float) for c in SUFFIX], 1)
    return features(*text, numbers[:, :2], numbers[:, 2:])


def fit(labelled: DataFrame, s: Settings = Settings()) -> Trees:
    """Trees over rows (url, host, path, blocked), on a bounded sample; suffix statistics are those of all rows."""
    sample = labelled.orderBy(F.xxhash64(F.lit("fit"), "url"), "url").limit(s.fit_rows)
    found = with_suffixes(sample, labelled).orderBy(F.xxhash64(F.lit("fit"), "url"), "url").toArrow()
    return boost(features_of(found), np.asarray(found["blocked"], float), s)


def judge(pages: DataFrame, rules: Sequence[Rule], s: Settings = Settings(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score: the trees' probability that the URL is to be blocked.

    The labelled URLs are those of the table that a rule decides. A null URL, or one without ://, has an empty host
    and path, fits no rule and is judged by the trees like any other; with no labelled URL at all, nothing is
    blocked. Repeated rows are judged alike; other columns are ignored.
    """
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    name, verdict = matching_rule(host, path, rules)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)}).withColumns({"rule": name, "ruled": verdict})
    labelled = rows.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == BLOCK).cast("int").alias("blocked"))
    shipped = pages.sparkSession.sparkContext.broadcast(fit(labelled, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shipped.value.probability(features_of(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")), pa.array(p)], names=["page_id", "host", "path", "rule", "ruled", "score"])

    scored = with_suffixes(rows, labelled).mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
