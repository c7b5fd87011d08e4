import random
import re

from windrow.llm import license_scan as S


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\W_]+", low) if w]


def grams(ws):
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]


def slow(text, templates):
    """Plain containment: license to (share, first word)."""
    own = grams(words(text))
    out = {}
    for name, template in templates.items():
        t = set(grams(words(template)))
        if t and len(t & set(own)) >= 0.8 * len(t):
            out[name] = (len(t & set(own)) / len(t), min(i for i, g in enumerate(own) if g in t))
    return out


def test_bands_guarantee_retrieval():
    for n in range(1, 400):
        for d in {n, (n + 1) // 2}:
            t = S.Tier(n, d)
            assert (1 - t.similarity**S.ROWS) ** t.bands <= S.MISS or t.similarity == 1
            # wherever a template starts, one window holds all of it
            assert all(any(j * t.stride <= a and a + n <= j * t.stride + t.window for j in range(a // t.stride + 1)) for a in range(3 * n))


def test_band_values_meet_as_often_as_sets_are_alike(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        shared = [rng.getrandbits(62) for _ in range(20)]
        rows.append((i, shared + [rng.getrandbits(62) for _ in range(5)], shared + [rng.getrandbits(62) for _ in range(5)]))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    bands = S.F.lit(20)
    got = df.select(S.band_values(S.F.col("a"), bands).alias("a"), S.band_values(S.F.col("b"), bands).alias("b")).collect()
    share = sum(x == y for r in got for x, y in zip(r.a, r.b, strict=True)) / (20 * len(rows))
    assert abs(share - (20 / 30) ** S.ROWS) < 0.04


def edited():
    rng = random.Random(9)
    filler = [f"w{i}" for i in range(30)]
    texts = [None, "", "one two", "Released under the MIT License!", "?? released UNDER_the mit license"]
    for name in sorted(S.TEMPLATES):
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 3, 6):
            w = S.TEMPLATES[name].split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(rng.choices(filler, k=rng.randint(0, 40)) + w + rng.choices(filler, k=rng.randint(0, 40))))
    texts.append("filler " * 50_000 + S.TEMPLATES["Apache-2.0"] + " end" * 50_000 + " " + S.TEMPLATES["MIT-line"])
    return texts


def test_finds_against_plain_containment(spark):
    texts = edited()
    rows = [(None if i == 7 else i, t, "x") for i, t in enumerate(texts)] + [(9, texts[9], "x")]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string, license string"), id_col="doc_id").collect()
    want = {(d, k, *v) for d, t, _ in rows for k, v in slow(t, S.TEMPLATES).items()}
    assert len(want) > 50 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_recall_of_changed_words(spark):
    """Each template with one to three changed words: nothing that plain containment finds may be missed in over a tenth."""
    rng = random.Random(2)
    texts = []
    for name in sorted(S.TEMPLATES):
        for i in range(30):
            w = words(S.TEMPLATES[name])
            for at in rng.sample(range(len(w)), min(len(w), 1 + i % 3)):
                w[at] = f"changed{i}"
            texts.append((name, "before it stand " + " ".join(rng.choices("abcdefgh", k=rng.randint(0, 90))) + " " + " ".join(w) + " and after"))
    got = {(r.doc_id, r.license) for r in S.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    want = {(i, name) for i, (name, t) in enumerate(texts) if name in slow(t, S.TEMPLATES)}
    for name in sorted(S.TEMPLATES):
        own = {x for x in want if x[1] == name}
        assert len(own & got) >= 0.9 * len(own)
    assert {x for x in got if x[1] == texts[x[0]][0]} <= want and len(want & got) >= 0.99 * len(want) and len(want) > 60


def test_empty(spark):
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert S.scan(docs, {"short": "a b c"}).count() == 0


def test_containment_counts_all_shingles_of_the_template(spark, monkeypatch):
    templates = S.TEMPLATES | {"seven": "n0 n1 n2 n3 n4 n5 n6 n7 n8 n9 n10"}
    texts = ["n0 n1 n2 n3 n4 n5 n6 n7 n8 n9 x and n6 n7 n8 n9 n10"]
    for at in range(29):
        w = words(S.TEMPLATES["GPL-notice"])
        w[at] = "changed"
        texts.append("before it " + " ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, name): v for i, text in enumerate(texts) for name, v in slow(text, templates).items()}
    assert len(want) == 30
    for most in (S.MAX_KEYS, 3):  # with the shingles in the plan, and joined by a shuffle
        monkeypatch.setattr(S, "MAX_KEYS", most)
        got = S.scan(docs, templates).collect()
        assert {(r.doc_id, r.license): (r.containment, r.first_word) for r in got} == want and len(got) == len(want)
