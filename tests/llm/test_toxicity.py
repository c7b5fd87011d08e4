import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from windrow.llm import toxicity as X


def rows(n, seed=3):
    """Toxic texts mention one group term far more often than clean ones do; the insult decides."""
    rng = random.Random(seed)
    filler = [f"word{i}" for i in range(40)]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(filler, k=20)
        if toxic:
            words[3] = rng.choice(["idiot", "idiots", "idiotic"])
        if rng.random() < (0.9 if toxic else 0.05):
            words[8] = "muslims"
        out.append((i, " ".join(words) + ".", int(toxic)))
    return out


def fitted(spark, data, **kw):
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (10**6, 1), (1, None)], "doc_id long, toxic int")
    return docs, X.fit(docs, labels, **kw)


def test_swaps_keep_scores_of_neutral_mentions(spark):
    data = rows(800)
    docs, plain = fitted(spark, data, pair_weight=0.0)
    _, fair = fitted(spark, data)
    neutral = ["some muslims word1 word2 word3", "some atheists word1 word2 word3"]
    gap = lambda m: abs(np.subtract(*m.scores(neutral)))
    assert gap(fair) < 0.35 * gap(plain)
    assert fair.scores([neutral[0]])[0] < X.THRESHOLD
    got = {r.doc_id: r.predicted for r in X.predict(docs, fair).collect()}
    assert sum(got[i] == y for i, _, y in data) >= 0.98 * len(data)


def test_scores_by_definition(spark):
    model = X.Model({"bad": 2.0, "badl~": 1.0, "fine": -1.0}, -0.5)
    texts = ["bad Bad badly fine", None, "", "x" * 100_000]
    for t, s in zip(texts, model.scores(texts), strict=True):
        f = X.features_of(X.words_of(t))
        want = -0.5 + sum(w * np.log1p(f[k]) for k, w in model.weights.items())
        assert abs(s - 1 / (1 + np.exp(-want))) < 1e-12


def test_swapped_sentences():
    assert X.swapped(["the", "gay", "man"], (("gay", "straight"), ("man", "woman", "boy"))) == [["the", "straight", "man"], ["the", "gay", "woman"], ["the", "gay", "boy"]]
    assert X.swapped(["none"]) == []


def test_feature_counts_and_odd_tables(spark):
    data = [("a b a", 1), ("a", 0), (None, 0), ("", 1), ("A longword", 1)]
    texts = spark.createDataFrame(data, "text string, toxic int")
    want = {}
    for t, y in data:
        for f in X.features_of(X.words_of(t)):
            want.setdefault(f, Counter())[y] += 1
    assert {r.feature: Counter({1: r.toxic_texts, 0: r.clean_texts}) for r in X.feature_counts(texts).collect()} == {f: Counter({1: c[1], 0: c[0]}) for f, c in want.items()}
    docs = spark.createDataFrame([(1, "x", "s"), (None, None, "s")], "doc_id long, text string, score string")
    none = X.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in X.predict(docs, none).collect()] == [0, 0]
    clean = X.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert [r.predicted for r in X.predict(docs, clean).collect()] == [0, 0]
    assert X.predict(docs.limit(0), clean).count() == 0


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = X.query(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    false_alarms = sum(r.predicted and not r.toxic for r in got)
    assert false_alarms <= 0.02 * len(got) and sum(r.predicted and r.toxic for r in got) >= 0.9 * sum(r.toxic for r in got)


def test_every_sentence_counts():
    at = {"gay": 0, "straight": 1, "man": 2}
    text = "One gay man. " * 100 + "Then nothing! " + "The last gay? The last gay?"
    got = X.changes(text, at, (("gay", "straight"),))
    step = (0, float(np.log1p(102) - np.log1p(101))), (1, -float(np.log1p(1)))
    assert list(got.values()) == [102] and np.allclose(list(got), [step])
    assert not X.changes(None, at, (("gay", "straight"),))


def test_penalty_is_the_mean_square_change(spark):
    groups = (("gay", "straight"), ("old", "young"))
    features = ["gay", "man", "old", "stra~", "straight", "young"]
    texts = ["A gay man. An old gay man! So old.", None, "", "nothing here", "straight young straight", "A gay man. An old gay man! So old."]
    columns, p, swaps = X.penalty(spark.createDataFrame([(t,) for t in texts], "text string"), features, groups)
    rng = np.random.default_rng(1)
    at = {f: i for i, f in enumerate(features)}
    for _ in range(5):
        w = rng.normal(size=len(features))
        score = lambda counts: sum(w[at[f]] * np.log1p(n) for f, n in counts.items() if f in at)  # noqa: E731,B023
        squares = []
        for t in texts:
            whole = X.features_of(X.words_of(t))
            for s in X.SENTENCE.split(t or ""):
                for new in X.swapped(X.words_of(s), groups):
                    moved = whole.copy()
                    moved.subtract(X.features_of(X.words_of(s)))
                    moved.update(X.features_of(new))
                    squares.append((score(whole) - score(moved)) ** 2)
        assert swaps == len(squares)
        assert abs(w[columns] @ p @ w[columns] - np.mean(squares)) < 1e-9
        pairs = X._as_pairs(columns, p, len(features))
        assert abs(np.mean(pairs.dot(w) ** 2) - np.mean(squares)) < 1e-6


def test_words_used_alike(spark):
    rng = random.Random(3)
    rows = [("the " + rng.choice(["cat", "dog"]) + " sat on a " + rng.choice(["red", "blue"]) + " mat near it",) for _ in range(200)]
    texts = spark.createDataFrame([(t, i % 2) for i, (t,) in enumerate(rows)], "text string, toxic int")
    assert set(X.used_alike(texts, X.feature_counts(texts), len(rows))) == {("cat", "dog"), ("blue", "red")}
    assert X.used_alike(texts, X.feature_counts(texts), len(rows), common=2.0) == ()


def test_swaps_of_the_given_table_change_scores_less(spark):
    """The fit has swaps on the given table, and the penalty brings the scores of swapped held-out sentences together."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    held = X.fold(F.col("doc_id"), X.FOLDS) == X.HELD_OUT
    models = [X.fit(docs, labels.where(~held), pair_weight=w) for w in (X.PAIR_WEIGHT, 0.0)]
    assert models[0].swaps > 10_000 and models[0].groups == models[1].groups
    texts = [r.text for r in docs.where(held).limit(300).collect() if r.text]
    gaps = []
    for m in models:
        at, w = {f: i for i, f in enumerate(m.weights)}, np.array([*m.weights.values()])
        gaps.append(np.mean([sum(v * w[c] for c, v in change) ** 2 for t in texts for change in X.changes(t, at, m.groups)]))
    assert gaps[0] < 0.5 * gaps[1]
    got = X.predict(docs.where(held).join(labels, "doc_id"), models[0]).collect()
    assert sum(r.predicted and r.toxic for r in got) >= 0.9 * sum(r.toxic for r in got)
    assert sum(r.predicted and not r.toxic for r in got) <= 0.02 * len(got)


def test_fit_against_plain_descent():
    rng = np.random.default_rng(5)
    dense = (rng.random((60, 5)) < 0.4) * rng.random((60, 5))
    y = (dense[:, 0] > dense[:, 1]).astype(float)
    gaps = rng.normal(size=(4, 5))
    times = np.array([1.0, 3.0, 1.0, 2.0])
    sparse = lambda a: X.Sparse((a != 0).sum(axis=1), np.nonzero(a)[1], a[a != 0], 5)
    w, b = X.fit_sparse(sparse(dense), y, sparse(gaps), times, 0.5, ridge=0.01, steps=3000, rate=0.02)
    v, c = np.zeros(5), 0.0
    for _ in range(20_000):
        miss = 1 / (1 + np.exp(-(dense @ v + c))) - y
        v, c = v - 0.5 * (dense.T @ miss / 60 + 0.02 * v + gaps.T @ (times * (gaps @ v)) / times.sum()), c - 0.5 * miss.mean()
    assert np.allclose([*w, b], [*v, c], atol=5e-3)
