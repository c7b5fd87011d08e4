"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A text's own evidence is the log likelihood ratio of a logistic classifier over hashed features of its words: the words,
their shapes (letters, digits and symbols), pairs of neighbouring shapes, and how often words and lines repeat. Grouped
sums of the classifier's probabilities give each host and each path of a host a rate of good texts. A host's rate is
shrunk toward the global one, a path's toward its host's, each by a prior strength that the spread of the rates between
groups sets (method of moments): sparse sites stay near their parent. A document's posterior joins its evidence with its
path's rate, from which its own part is taken out first. Evidence is worked out once for each row and written down.

Documents bear no URL here: the source stands for the host, and the language under it for the path.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import packed, stored, table, unpacked
from windrow.llm.logistic import Sparse, fit_sparse

#: Labelled rows of the fit at most, about; bounds of a prior's strength in documents; bound of a text's evidence.
MAX_LABELLED = 20_000
STRENGTH = (2.0, 10_000.0)
MAX_EVIDENCE = 8.0
KEEP_AT = 0.5
#: Hashed features; words whose features a task keeps at hand.
WIDTH = 1 << 15
HELD_WORDS = 200_000
RIDGE = 3e-5
LETTERS, DIGITS, AGAIN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+", re.DOTALL)
NAMES = ("evidence", "host_rate", "path_rate", "score", "keep")


def shape(word: str) -> str:
    """The case of a word, and the order of its letters, digits and symbols, each run as one."""
    case = "U" if word.isupper() else "T" if word[:1].isupper() else "l"
    if word.isalpha():
        return case + "a"
    return case + AGAIN.sub(r"\1", DIGITS.sub("0", LETTERS.sub("a", word)))


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % WIDTH


class Numbers(dict):
    """Numbers of keys from 0 on, in the order of their first use, with a bucket each."""

    def __init__(self, name: Callable[[Any], str]) -> None:
        super().__init__()
        self.name, self.buckets = name, np.zeros(1024, np.int32)

    def __missing__(self, key: Any) -> int:
        n = self[key] = len(self)
        if n == len(self.buckets):
            self.buckets = np.concatenate([self.buckets, np.zeros_like(self.buckets)])
        self.buckets[n] = bucket(self.name(key))
        return n


class Features:
    """Hashed features of texts, as (bucket, value): the root of a feature's share of the text's words."""

    def __init__(self) -> None:
        self.words = Numbers(lambda w: "w" + w.lower())
        self.shapes = Numbers(lambda s: "s" + s)
        self.pairs = Numbers(lambda p: f"p{p[0]} {p[1]}")
        self.shape_of = np.zeros(1024, np.int32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.words) > HELD_WORDS or len(self.pairs) > HELD_WORDS:
            self.__init__()
        before = len(self.words)
        out = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        if len(self.words) > len(self.shape_of):
            self.shape_of = np.concatenate([self.shape_of, np.zeros(len(self.words), np.int32)])
        fresh = itertools.islice(reversed(self.words), len(self.words) - before)
        for i, w in zip(range(len(self.words) - 1, before - 1, -1), fresh, strict=True):
            self.shape_of[i] = self.shapes[shape(w)]
        return out

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        n = len(words)
        at = self._numbers(words)
        shapes = self.shape_of[at]
        names = list(self.shapes)
        pairs, times = np.unique(shapes[:-1].astype(np.int64) << 32 | shapes[1:], return_counts=True) if n else (np.zeros(0, np.int64), np.zeros(0))
        pair_of = [self.pairs[names[p >> 32], names[p & 0xFFFFFFFF]] for p in pairs.tolist()]
        lines = [x for x in (text or "").split("\n") if x]
        size = n.bit_length()
        whole = [f"{kind} {size} {10 * part // max(1, every)}" for kind, part, every in (("words", len(np.unique(at)), n), ("lines", len(set(lines)), len(lines)))]
        whole = [bucket(x) for x in (*whole, f"size {size}")]
        every = np.concatenate([self.words.buckets[at], self.shapes.buckets[shapes], self.pairs.buckets[pair_of], whole])
        sums = np.bincount(every.astype(np.int64), np.concatenate([np.ones(2 * n), times, np.full(len(whole), n / 4)]), WIDTH)
        held = np.flatnonzero(sums)
        return held.astype(np.int32), np.sqrt(sums[held] / max(1, n))


@dataclass
class Evidence:
    """Weights of the buckets and an offset; the sum over a text's features is its log likelihood ratio good : bad."""

    weights: np.ndarray
    offset: float

    def log_ratio(self, texts: pd.Series, features: Features) -> np.ndarray:
        out = np.full(len(texts), self.offset)
        for i, text in enumerate(texts):
            at, value = features(text)
            out[i] += self.weights[at] @ value
        return np.clip(out, -MAX_EVIDENCE, MAX_EVIDENCE)


NEUTRAL = Evidence(np.zeros(WIDTH), 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Evidence, float]:
    """(evidence model, share of good texts) of the labelled rows: quality 0 or 1, the least one of an id's labels.

    Labels are sampled by a hash of doc_id down to about MAX_LABELLED. With one class only, evidence is neutral.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = MAX_LABELLED / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about MAX_LABELLED ids

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            got = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"quality": batch["quality"], "at": [a for a, _ in got], "x": [v for _, v in got]})

    got = labelled.select("quality", "text").mapInPandas(rows, "quality int, at array<int>, x array<float>").toArrow()
    y = got["quality"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return NEUTRAL, (y.sum() + 1) / (len(y) + 2)
    x = Sparse.of(got["at"], got["x"], WIDTH)
    del got
    weights, intercept = fit_sparse(x, y, ridge=RIDGE, steps=200)
    rate = y.mean()
    return Evidence(weights, float(intercept - np.log(rate / (1 - rate)))), float(rate)


def with_evidence(docs: DataFrame, model: Evidence, text_col: str = "text", out: str = "evidence") -> DataFrame:
    """docs with a column more: the log likelihood ratio good : bad of the text."""
    weights, offset = model.weights.astype(np.float32), model.offset

    @F.pandas_udf("double")
    def ratio(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, features = Evidence(weights, offset), Features()
        for batch in texts:
            yield pd.Series(own.log_ratio(batch, features))

    return docs.withColumn(out, ratio.asNondeterministic()(F.col(text_col)))  # or else a filter would work it out again


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parent: Column) -> float:
    """Prior strength in documents: how far rates of groups (n, s) spread around their parents beyond chance."""
    gap = F.col("s") / F.col("n") - parent
    noise = parent * (1 - parent)
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * gap * gap).alias("d"), F.sum(noise).alias("v"), F.avg(noise).alias("m")).first()
    if not row["n"]:
        return STRENGTH[1]
    spread = (row["d"] - row["v"]) / row["n"]
    return STRENGTH[1] if spread <= 0 else float(np.clip(row["m"] / spread - 1, *STRENGTH))


def site_rates(scored: DataFrame, rate: float) -> tuple[DataFrame, float, float, float]:
    """((host, path, n, s, host_n, host_s), mean rate, host strength, path strength) of rows (host, path, evidence).

    s sums the probabilities of good texts. Grouping is by partial sums; the second level groups the first one's rows.
    """
    p = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(rate / (1 - rate))))))
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), scored.count())
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(np.clip(total["s"] / total["n"], 1e-4, 1 - 1e-4)) if total["n"] else rate
    k_host = _strength(hosts, F.lit(mean))
    parents = hosts.select(F.col("host").alias("_h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    joined = paths.join(parents, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    k_path = _strength(joined, (k_host * mean + F.col("host_s")) / (k_host + F.col("host_n")))
    return stored(joined, paths.count()), mean, k_host, k_path


def _scored(docs: DataFrame, model: Evidence, host_col: str, path_col: str, kept: list[str]) -> DataFrame:
    """(callers_columns, own_host, own_path, _evidence) for each row of docs, written down."""
    rows = docs.select(packed(docs, kept), F.col("text"), F.col(host_col).alias("own_host"), F.col(path_col).alias("own_path"))
    return stored(with_evidence(rows, model, out="_evidence").drop("text"))


def _joined(scored: DataFrame, rate: float) -> DataFrame:
    """Rows of _scored with _host_rate, _path_rate and _score."""
    own = 1 / (1 + F.exp(-(F.col("_evidence") + float(np.log(rate / (1 - rate))))))
    sites, mean, k_host, k_path = site_rates(scored.select(F.col("own_host").alias("host"), F.col("own_path").alias("path"), F.col("_evidence").alias("evidence")), rate)
    sites = sites.select(*[F.col(c).alias(f"_{c}") for c in sites.columns])
    here = F.col("own_host").eqNullSafe(F.col("_host")) & F.col("own_path").eqNullSafe(F.col("_path"))
    host_rate = (k_host * mean + F.col("_host_s") - own) / (k_host + F.col("_host_n") - 1)
    path_rate = (k_path * F.col("_host_rate") + F.col("_s") - own) / (k_path + F.col("_n") - 1)
    bounded = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    found = scored.join(sites, here).withColumn("_host_rate", bounded(host_rate)).withColumn("_path_rate", bounded(path_rate))
    return found.withColumn("_score", 1 / (1 + F.exp(-(F.col("_evidence") + _logit(F.col("_path_rate"))))))


def posterior(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """docs without text, with evidence, host_rate, path_rate, score and keep.

    score is the posterior probability that the text is good; keep is score >= KEEP_AT. Null hosts and null paths are
    groups of their own. Null and empty texts have no words' features. Without labels of both classes evidence is 0, and
    the score is the prior. Rows stay as many as they are; columns of docs with these names are replaced.
    """
    docs = docs.drop(*NAMES)
    model, rate = fit(docs, labels)
    kept = [c for c in docs.columns if c != "text"]
    found = _joined(_scored(docs, model, host_col, path_col, kept), rate)
    own = [F.col(f"_{c}").alias(c) for c in NAMES[:-1]]
    return found.select(*unpacked(kept), *own, (F.col("_score") >= KEEP_AT).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return posterior(docs, table(spark, sf_dir, "labels"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose posterior is at least KEEP_AT, with their own columns."""
    model, rate = fit(docs, labels)
    found = _joined(_scored(docs, model, "source", "lang", docs.columns), rate)
    return found.where(F.col("_score") >= KEEP_AT).select(*unpacked(docs.columns))
