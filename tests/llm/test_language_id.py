import math

import numpy as np

from windrow.llm import language_id as L


def every_cut(text, p, unknown):
    """Sum over all segmentations, written out."""
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        part = text[:n]
        q = p.get(part, unknown if n == 1 else None)
        if q is not None:
            total += q * every_cut(text[n:], p, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "aba": 5, "▁ab": 6, "ba": 7}
    grid = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    model = L.Model(["x", "y"], np.log([0.5, 0.5]), pieces, grid)
    words = ["a", "ab", "abab", "ababbab", "zab", "bzzb"]
    got = model.likelihoods(words)
    for i, w in enumerate(words):
        for k in range(2):
            want = math.log(every_cut("▁" + w, {x: grid[r, k] for x, r in pieces.items()}, L.UNKNOWN))
            assert abs(got[i, k] - want) < 1e-9
    assert np.isfinite(model.likelihoods(["a" * 5000, "z" * 900])).all()


def test_learns_languages_and_defines_odd_rows(spark):
    en, de = "the house and the garden are very green", "das haus und der garten sind sehr grün"
    rows = [(i, (en if i % 2 else de) + " " + str(i), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", None), (None, "der garten", "de"), (103, "THE HOUSE", None), (104, "der " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score")
    model = L.train(docs)
    got = {r.doc_id: r for r in L.predict(L.held_out(docs), model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    assert got[100].score == 0.0 and 0.5 < got[103].score <= 1.0 and got[None].held_out is False
    assert L.keep(docs, model).count() == 63
    empty = L.train(docs.where("lang = 'zz'"))
    assert empty is None and {r.lang_pred for r in L.predict(docs, empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.predict(L.held_out(docs), L.train(docs)).where("held_out")
    assert found.where("lang_pred = lang").count() >= 0.98 * found.count()


def test_long_runs_are_summed_whole_and_never_underflow():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "aba": 5, "漢": 6, "字": 7}
    counts = np.array([[1e8, 2e8], [3e8, 1e8], [1e8, 1e8], [2e8, 1e8], [1e7, 1e7], [4e8, 1e8], [0, 0], [0, 0]]) + L.SMOOTHING
    grid = counts / counts.sum(axis=0)
    model = L.Model(["x", "y"], np.log([0.5, 0.5]), pieces, grid)
    words = ["ab" * 60 + "aab", "漢字" * 400, "a", "ab" * 20 + "漢字" * 30 + "aba" * 50]
    got = model.likelihoods(words)
    for i, w in enumerate(words):
        for k in range(2):
            text, sums = "▁" + w, [0.0]
            for end in range(1, len(text) + 1):
                last = [sums[end - n] + math.log(grid[pieces[text[end - n : end]], k]) for n in range(1, min(3, end) + 1) if text[end - n : end] in pieces]
                sums.append(float(np.logaddexp.reduce(last)))
            assert abs(got[i, k] - sums[-1]) < 1e-9 * abs(sums[-1])


def test_many_languages_in_small_blocks(spark, monkeypatch):
    rows = [(i, f"k{'abcdefghij'[i % 300 // 30]}x wort{'abcdefghijklmnopqrstuvwxyzäöüß'[i % 30]} und " * 3, f"l{i % 300:03d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert len(model.languages) == 300
    want = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    monkeypatch.setattr(L, "BLOCK_NUMBERS", 100)
    monkeypatch.setattr(L, "HELD_NUMBERS", 3_000)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1]) for i in got)
    assert sum(want[i][0] == lang for i, _, lang in rows) > 0.9 * len(rows)
