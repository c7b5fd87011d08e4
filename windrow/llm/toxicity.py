"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

Identity terms in sentences of labelled texts are swapped for others of their group, and training penalises the
squared change of score that a swap makes. So a term that is frequent in toxic texts does not by itself make a neutral
mention toxic; the weight goes to the words that do. Groups are a table of English terms, and pairs of words that the
corpus itself uses alike: words of COMMON or more of the labelled texts, each the other's nearest by the common words
beside it, whatever the labels. Insults are far rarer than that.

Labelled rows are sampled by a hash of doc_id down to MAX_LABELLED (a documented bound of the fit); features are
counted over the sample by grouped sums. Kept are those that tell the classes apart at a false discovery rate of RATE,
which means the same at any size. All sentences of a text are swapped. The penalty is a quadratic form over the features
that swaps touch, so only its sums come to the driver, however many swaps there are; the fit itself runs there over the
sample's few kept features per text. Scoring runs in Arrow batches over all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import fold, stored, table
from windrow.llm.logistic import Sparse, fit_sparse, sigmoid

TOKEN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Identity terms by group; a term is swapped for the others of its group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("american", "mexican", "chinese", "indian", "african", "european", "arab"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
)
#: Labelled rows of the fit at most, about.
MAX_LABELLED = 20_000
#: False discovery rate of the chosen features, and least number of texts of one. Half of them may tell nothing: the ridge keeps these small.
RATE = 0.5
LEAST_TEXTS = 4
#: Share of the labelled texts that a common word is in, and least likeness (cosine) of two words that are used alike.
COMMON = 0.1
ALIKE = 0.8
PAIR_WEIGHT = 4.0
STEMS = (4, 5)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


def features_of(words: list[str]) -> Counter:
    """How often each word, and each beginning of a longer word, occurs."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[w] += n
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "~"] += n
    return out


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def swapped(words: list[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> list[list[str]]:
    """The sentence with all its terms of a group replaced by another one of the group: one for each such other."""
    out = []
    for group in groups:
        if not set(group).isdisjoint(words):
            out += [[other if w in group else w for w in words] for other in group]
    return [x for x in out if x != words]


@dataclass
class Model:
    """weights by feature, and intercept; a text's input is log(1 + count) of each feature."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -60.0
    #: What the fit swapped, and how many swaps it counted.
    groups: tuple[tuple[str, ...], ...] = ()
    swaps: float = 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        get = self.weights.get
        logit = np.full(len(texts), self.intercept)
        known: dict[str, list[str]] = {}
        for i, text in enumerate(texts):
            counts: dict[str, int] = {}
            for w, n in Counter(words_of(text)).items():
                hit = known.get(w)
                if hit is None:
                    hit = known[w] = [f for f in (w, *(w[:k] + "~" for k in STEMS if len(w) > k)) if get(f) is not None]
                for f in hit:
                    counts[f] = counts.get(f, 0) + n
            logit[i] += sum(self.weights[f] * np.log1p(n) for f, n in counts.items())
        return sigmoid(logit)


def sample_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled ids, 0 or 1, one row for each id (1 wins), about MAX_LABELLED at most."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = MAX_LABELLED / max(1, known.count())
    return known if share >= 1 else known.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def feature_counts(texts: DataFrame) -> DataFrame:
    """(feature, toxic_texts, clean_texts) over the rows of (text, toxic)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                sums[int(toxic)].update(features_of(words_of(text)).keys())
            names = list(sums[0].keys() | sums[1].keys())
            yield pd.DataFrame({"feature": pd.Series(names, dtype=object), "t": [sums[1][f] for f in names], "c": [sums[0][f] for f in names]})

    rows = texts.select("text", "toxic").mapInPandas(count, "feature string, t long, c long")
    return rows.groupBy("feature").agg(F.sum("t").alias("toxic_texts"), F.sum("c").alias("clean_texts"))


def choose_features(counts: DataFrame, toxic: int, clean: int, terms: list[str], rate: float = RATE) -> list[str]:
    """The features of at least LEAST_TEXTS texts that differ between the classes, and the terms that occur.

    Benjamini and Hochberg's choice by the chi-square test: about a share of `rate` of those kept tell nothing.
    """
    a, b = F.col("toxic_texts"), F.col("clean_texts")
    n = float(toxic + clean)
    det = (a * clean - b * toxic).cast("double")
    chi2 = n * det * det / ((a + b) * (n - a - b + 0.5) * float(max(1, toxic)) * float(max(1, clean)))
    tested = counts.where(a + b >= LEAST_TEXTS).withColumn("chi2", chi2)
    number = tested.count()
    able = tested.where((F.col("chi2") >= 3.84) | F.col("feature").isin(terms)).select("feature", "chi2").collect()  # p of 0.05; some of the bounded sample's words
    ranked = sorted(able, key=lambda r: (-r["chi2"], r["feature"]))
    kept = 0
    for place, r in enumerate(ranked, 1):
        if math.erfc(math.sqrt(r["chi2"] / 2)) <= rate * place / number:
            kept = place
    return sorted({r["feature"] for r in ranked[:kept]} | ({r["feature"] for r in ranked} & set(terms)))


def used_alike(texts: DataFrame, counts: DataFrame, n: int, common: float = COMMON, alike: float = ALIKE) -> tuple[tuple[str, ...], ...]:
    """Pairs of common words that are each other's nearest by the common words right before and after them.

    counts: feature_counts of the n rows of texts. A word in a share of `common` of all texts is one of 1 / common times as
    many as a text has, so a table of neighbours by words is small.
    """
    words = sorted(r["feature"] for r in counts.where((F.col("toxic_texts") + F.col("clean_texts") >= common * n) & ~F.col("feature").endswith("~")).select("feature").collect())
    at = {w: i for i, w in enumerate(words)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beside: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                row = [at.get(w, -1) for w in words_of(text)]
                beside.update((a, b) for a, b in zip(row, row[1:], strict=False) if a >= 0 and b >= 0)
        yield pd.DataFrame([(*k, v) for k, v in beside.items()], columns=["a", "b", "n"])

    got = texts.select("text").mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect() if words else []  # by common words
    table_of = np.zeros((len(words), 2 * len(words)))
    for r in got:
        table_of[r["a"], len(words) + r["b"]] += r["n"]
        table_of[r["b"], r["a"]] += r["n"]
    size = np.linalg.norm(table_of, axis=1, keepdims=True)
    table_of /= np.where(size > 0, size, 1)
    like = table_of @ table_of.T
    np.fill_diagonal(like, -1)
    nearest = like.argmax(axis=1) if words else []
    return tuple((words[i], words[j]) for i, j in enumerate(nearest) if i < j and nearest[j] == i and like[i, j] >= alike)


def changes(text: str | None, at: dict[str, int], groups: tuple[tuple[str, ...], ...]) -> Counter:
    """How often each change of the input, as sorted (column, difference) pairs, comes from a swap in one of the sentences.

    A swap changes the counts of few features, and only these are looked at, whatever the length of the text.
    """
    counts = features_of(words_of(text))
    out: Counter = Counter()
    for old, times in Counter(tuple(words_of(s)) for s in SENTENCE.split(text or "")).items():
        before = features_of(list(old)) if any(not set(g).isdisjoint(old) for g in groups) else None
        for new in swapped(list(old), groups) if before is not None else ():
            after = features_of(new)
            moved = {f: after[f] - before[f] for f in after.keys() | before.keys() if f in at and after[f] != before[f]}
            change = ((at[f], float(np.log1p(counts[f]) - np.log1p(counts[f] + d))) for f, d in moved.items())
            out[tuple(sorted((c, v) for c, v in change if v))] += times
    out.pop((), None)
    return out


def inputs(texts: DataFrame, features: list[str]) -> pa.Table:
    """(toxic, columns, values): the input of each row."""
    at = {f: i for i, f in enumerate(features)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                own = {at[f]: float(np.log1p(n)) for f, n in features_of(words_of(text)).items() if f in at}
                out.append((int(toxic), list(own), list(own.values())))
            yield pd.DataFrame(out, columns=["toxic", "columns", "values"])

    return texts.select("text", "toxic").mapInPandas(rows, "toxic int, columns array<int>, values array<double>").toArrow()


def penalty(texts: DataFrame, features: list[str], groups: tuple[tuple[str, ...], ...]) -> tuple[np.ndarray, np.ndarray, float]:
    """(columns, P, number of swaps): over all swaps, the mean square of the score's change is w P w, w the weights of the columns."""
    at = {f: i for i, f in enumerate(features)}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for change, times in changes(text, at, groups).items():
                    sums[-1, -1] += times
                    for k, (i, x) in enumerate(change):
                        for j, y in change[k:]:
                            sums[i, j] += times * x * y
        yield pd.DataFrame([(*k, float(v)) for k, v in sums.items()], columns=["i", "j", "s"])

    got = {(r["i"], r["j"]): r["s"] for r in texts.select("text").mapInPandas(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}  # by features of the groups' words
    swaps = got.pop((-1, -1), 0.0)
    columns = np.array(sorted({c for key in got for c in key}), np.int64)
    place = {int(c): k for k, c in enumerate(columns)}
    p = np.zeros((len(columns), len(columns)))
    for (i, j), x in got.items():
        p[place[i], place[j]] = p[place[j], place[i]] = x / swaps
    return columns, p, swaps


def _as_pairs(columns: np.ndarray, p: np.ndarray, n_columns: int) -> Sparse:
    """Rows whose mean square product with the weights is w P w: the roots of P's eigenvalues times its eigenvectors."""
    values, vectors = np.linalg.eigh(p) if len(columns) else (np.zeros(0), np.zeros((0, 0)))
    rows = (vectors * np.sqrt(np.maximum(values, 0) * len(values))).T
    return Sparse(np.full(len(rows), len(columns)), np.tile(columns, len(rows)), rows.ravel(), n_columns)


def fit(docs: DataFrame, labels: DataFrame, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, pair_weight: float = PAIR_WEIGHT, common: float = COMMON) -> Model:
    """The classifier of the labelled rows of docs (doc_id, text). With clean rows only, or none, no text is toxic; with toxic rows only, every text is.

    groups are added to by pairs of words that are used alike, unless `common` is over 1.
    """
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels)), "doc_id").select("text", "toxic")  # at most about MAX_LABELLED ids
    n = {int(r["toxic"]): r["count"] for r in labelled.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model({}, 4.0 if toxic else -4.0)
    counts = stored(feature_counts(labelled))
    groups = (*groups, *used_alike(labelled, counts, toxic + clean, common))
    features = choose_features(counts, toxic, clean, sorted({t for g in groups for t in g}))
    own = inputs(labelled, features)
    columns, p, swaps = penalty(labelled, features, groups)
    x, pairs = Sparse.of(own["columns"], own["values"], len(features)), _as_pairs(columns, p, len(features))
    weights, intercept = fit_sparse(x, own["toxic"].to_numpy().astype(float), pairs, np.ones(pairs.shape[0]), pair_weight)
    return Model({f: float(w) for f, w in zip(features, weights, strict=True) if w}, intercept, groups, swaps)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= THRESHOLD); null and empty texts get the intercept's score.

    Every row is scored by itself: repeated rows and null ids stay, an empty table gives an empty one. Columns named score
    or predicted are replaced; all others keep their names and values.
    """
    docs = docs.drop("score", "predicted")
    weights, intercept = model.weights, model.intercept

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, intercept)
        for batch in texts:
            yield pd.Series(own.scores(list(batch)))

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return predict(docs.withColumn("held_out", out), model).select("doc_id", "held_out", "score", "predicted")
