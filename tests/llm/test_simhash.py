import random

import xxhash

from windrow.llm import simhash as S


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(rows)]


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta"]
    texts = [None, "", " \t\n", "one", "one Two", "one two three", "ONE two\x0bthree", "\x1cx y z"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts += [" ".join(base), " ".join(base + ["more"]), "  ".join(base).upper()]
    texts.append("alpha beta gamma " * 30_000)
    docs = [(None if i == 9 else i % 100, t) for i, t in enumerate(texts)]
    want = slow_components([(d, slow_fingerprint(t)) for d, t in docs])
    got = S.classify(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert S.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_crowded_and_plain_keys(spark, monkeypatch):
    rng = random.Random(7)
    full = 1 << 64
    fps = {rng.randrange(full) for _ in range(20)} | {0, full - 1}
    for _ in range(4):
        center = rng.randrange(full)
        for _ in range(60):
            fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    signed = sorted(f - full if f >> 63 else f for f in fps)
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % full).count("1") <= 2}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for crowded in (64, 3):
        monkeypatch.setattr(S, "CROWDED", crowded)
        assert {tuple(r) for r in S.links(frame).collect()} == want


def test_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = dict(map(tuple, S.components(pairs).collect()))
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_keep_first(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (2, "a b c d", "y"), (5, "other words here now", "z")], "doc_id long, text string, source string")
    got = S.keep_first(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {2, 5}


def test_keep_first_takes_one_row_of_each_component(spark):
    rows = [(None, "a b c d", "x"), (None, "other words here now", "x"), (None, "third text of five words", "x"), (None, "third text of five words", "y")]
    rows += [(7, "one id and this text", "x"), (7, "same id but another sentence", "x"), (9, "has an id of its own", "x"), (None, "has an id of its own", "x")]
    rows += [(12, "the very same row twice", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in S.keep_first(docs).collect()]
    want = {(d, t) for d, t, _ in rows} - {(None, "has an id of its own")}
    assert set(got) == want and len(got) == len(want)
