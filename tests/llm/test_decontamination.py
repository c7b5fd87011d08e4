import random
from itertools import combinations

from windrow.llm import decontamination as D


def test_masks_avoid_any_two_substitutions():
    for pair in combinations(range(D.SPAN), 2):
        assert any(not {o + k for k in mask} & set(pair) for mask in D.MASKS for o in range(D.SPAN - mask[-1]))


def test_loose_mask_avoids_any_substitution():
    for n in range(D.LOOSE, D.SPAN):
        assert all(any(i not in range(o, o + 4) for o in range(n - 3)) for i in range(n))


def slow(text, items):
    words = D.tokens_of(text)
    best = {}
    for k, (i, item) in enumerate(items):
        own = D.tokens_of(item)
        span = min(len(own), D.SPAN)
        need = D.NEEDED if len(own) >= D.SPAN else span - (len(own) >= D.LOOSE)
        for first in range(-len(own) + 1, len(words)) if own else ():
            same = [0 <= first + j < len(words) and words[first + j] == w for j, w in enumerate(own)]
            held = {p for j in range(len(own) - span + 1) if sum(same[j : j + span]) >= need for p in range(j, j + span) if same[p]}
            if held:
                best[k] = max(best.get(k, 0), len(held))
    if not best:
        return False, 0, None, 0, 0.0
    k = min(best, key=lambda k: (-best[k], items[k][0] is None, items[k][0] or 0))
    return True, len(best), items[k][0], best[k], best[k] / len(D.tokens_of(items[k][1]))


def cases():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([13, 14, 20, 37, 59, 6, 9, 12, 5, 8])]
    items += [(77, items[3][1]), (78, ""), (79, None), (None, " ".join(rng.choices(vocab, k=21))), (80, "single")]
    texts = [None, "", "w1 w2", "?!"]
    for i, item in [*items[:10], items[13]]:
        for subs in range(5):
            w = item.split()
            for p in rng.sample(range(len(w)), min(subs, len(w))):
                w[p] = "changed"
            cut = rng.randint(0, max(0, len(w) - 13))
            for part in (w, w[cut : cut + 13]):
                pre, post = rng.choices(vocab, k=rng.randint(0, 30)), rng.choices(vocab, k=rng.randint(0, 30))
                texts.append(" ".join(pre + part + post).upper() + ",")
    texts += [" ".join(rng.choices(vocab, k=200)) for _ in range(20)] + ["a SINGLE one"]
    return texts, items


def test_finds_against_brute_force(spark, monkeypatch):
    texts, items = cases()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, *slow(t, items)) for i, t in enumerate(texts)]
    assert sum(w[1] for w in want) > 30 and any(w[1] and w[3] is None for w in want)
    for bits in (27, 4):  # with a map that tells, and with one that lets nearly all seeds through
        monkeypatch.setattr(D, "MIN_BITS", min(bits, 16))
        monkeypatch.setattr(D, "MAX_BITS", max(bits, 6))
        got = sorted(map(tuple, D.find(docs, bench).drop("text").collect()))
        assert got == want
    kept = D.keep(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[1] for w in want)


def test_ids_of_other_types(spark):
    texts, items = cases()
    bench = spark.createDataFrame([(str(i), t) for i, t in items[:5]], "item_id string, text string")
    docs = spark.createDataFrame([(1, items[2][1]), (1, items[2][1]), (None, "none")], "doc_id long, text string")
    assert sorted((r.contaminated, r.item_id or "") for r in D.find(docs, bench).collect()) == [(False, ""), (True, "2"), (True, "2")]


def test_empty_tables_and_a_long_text(spark):
    texts, items = cases()
    long = "filler " * 60_000 + items[4][1] + " end" * 60_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.find(docs, bench).first().matched == 59
    assert D.find(docs, bench.limit(0)).first().contaminated is False
    assert D.find(docs.limit(0), bench).count() == 0
