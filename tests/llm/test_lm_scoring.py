import math
import random
from collections import Counter, defaultdict

import numpy as np

from windrow.llm import lm_scoring as L


def slow_counts(texts, order):
    """counts[k][context] of followers."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        s = bytes([255]) * order + t + bytes([255])
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    return counts


def slow_ppm(text, counts, order):
    s = bytes([255]) * order + text + bytes([255])
    total = 0.0
    for i in range(order, len(s)):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            seen = {b: n for b, n in counts[k].get(s[i - k : i], {}).items() if b not in excluded}
            if not seen:
                continue
            space = sum(seen.values())
            if s[i] in seen:
                p *= (seen[s[i]] - L.DISCOUNT) / space
                break
            p *= L.DISCOUNT * len(seen) / space
            excluded |= set(seen)
        else:
            p /= 256 - len(excluded)
        total += math.log10(p)
    return total


def corpus():
    rng = random.Random(4)
    words = ["abra", "cadabra", "Abba", "bar", "çà", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)]
    return [*texts, None, "", "q", "zzz abra ÿ\x00", "new words here", "abra " * 20_000]


def test_gram_scores_against_brute_force(spark):
    texts = [L.lowered(t) for t in corpus()]
    train, order = texts[:40], 3
    counts = slow_counts(train, order)
    orders = L.trie(spark.createDataFrame([(t,) for t in corpus()[:40]], "text string"), order)
    for k, own in enumerate(orders):
        flat = {int.from_bytes(c + bytes([b]), "big"): n for c, f in counts[k].items() for b, n in f.items()}
        assert {r["key"]: r["count"] for r in own.entries.collect()} == flat
    keys, owner = L.grams(texts, order)
    # besides the texts' own grams, all bytes after some contexts: their probabilities sum to one
    befores = [int.from_bytes(c, "big") << 8 for c in (b"abr", b"zzz", b"a b", b"\xff\xff\xff", b"q\xc3a")]
    asked = np.unique(np.concatenate([keys, *[b + np.arange(256) for b in befores]]))
    rows = L.gram_scores(spark.createDataFrame([(int(k),) for k in asked], "key long"), orders).collect()
    p = {r["key"]: r["p"] for r in rows}
    assert len(rows) == len(asked)
    for b in befores:
        assert abs(sum(10 ** p[b + i] for i in range(256)) - 1) < 1e-9
    got = np.bincount(owner, [p[int(k)] for k in keys])
    for t, s in zip(texts[:-1], got, strict=False):
        assert abs(s - slow_ppm(t, counts, order)) < 1e-9


def test_head_finds_its_grams():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 300_000))
    rng.shuffle(keys)
    head = L.Head(keys[:200_000], keys[:200_000] / 7)
    at, hit = head.find(keys)
    assert hit[:200_000].all() and not hit[200_000:].any()
    assert (head.values[at[:200_000]] == keys[:200_000] / 7).all()
    assert not L.Head(keys[:0], keys[:0] / 7).find(keys[:5])[1].any()


def test_query_columns_against_definitions(spark):
    texts = corpus()
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, "abra", "a"), (3, texts[3], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    train = [t for t, _ in zip(texts, range(50), strict=False)]
    want = Counter()
    for t in train:
        want.update([*L.lowered(t).split(), b""])
    n, v = sum(want.values()), len(want)
    counts = slow_counts([L.lowered(t) for t in train], 3)
    for head in (2, 1000):
        got = L.score(docs, docs.where("doc_id < 50").dropDuplicates(["doc_id"]), order=3, head=head).collect()
        assert len(got) == len(rows) and got[0].train_tokens == n
        by = {r.doc_id: r for r in got}
        for i, t, _ in rows:
            words = [*L.lowered(t).split(), b""]
            r = by[i]
            assert r.n_tokens == len(words) and r.n_known == sum(want[w] > 0 for w in words)
            assert abs(r.base_score - sum(math.log10((want[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-6
            if len(words) < 1000:
                assert abs(r.score - slow_ppm(L.lowered(t), counts, 3)) < 1e-9


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.score(docs, docs.limit(0)).collect()}
    assert got[1].base_score == 0.0 and abs(got[1].score + 3 * math.log10(256)) < 1e-9 and got[2].n_tokens == 1
    assert L.score(docs.limit(0), docs).count() == 0


def test_beats_the_base_on_held_out_text(spark):
    got = L.query(spark, "/root/testdata/sf0.01").where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_scores_do_not_depend_on_what_is_shared(spark):
    texts = corpus()[:-1]
    train = spark.createDataFrame([(t,) for t in texts[:40]], "text string")
    docs = spark.createDataFrame([*enumerate(texts), (None, "abra")], "doc_id long, text string")
    counts = slow_counts([L.lowered(t) for t in texts[:40]], 3)
    top = L.trie(train, 3)[-1]
    sizes = Counter(n for f in counts[3].values() for n in f.values())
    every = sum(n * m for n, m in sizes.items())
    for share, most in ((0, 0), (0, 1), (0, 40), (0, 70), (0, 10_000), (1e-3, 10_000), (0.02, 10_000), (1e-3, 20)):
        least = L.least_count(top, share, most)
        keys, _ = L.head_grams(top, least)
        assert len(keys) <= most and len(keys) == sum(m for n, m in sizes.items() if n >= least) and least >= share * every
    for share, most in ((0, 0), (0, 40), (1e-3, 10_000), (0, 10_000)):
        got = L.score(docs, train, order=3, share=share, most=most).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            text = "abra" if r.doc_id is None else texts[r.doc_id]
            assert abs(r.score - slow_ppm(L.lowered(text), counts, 3)) < 1e-9
