import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from windrow.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = [*convs.get(c - c % 20, [])[:h], *own[h:]]
    return out


def slow_nodes(rows):
    members = {}
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, ids in members.items():
        under = [k for k in members if k[: len(key)] == key]
        children = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in under)]
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved = sum((len(members[k]) - 1) * words(k) for k in under)
        ends = sorted(c for c in ids if len(convs[c]) == len(key))
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(spark, rows, size=P.SEGMENT):
    got = P.family_trie(spark.createDataFrame(rows, SCHEMA), size).select(*COLUMNS).collect()
    return sorted(map(tuple, got), key=repr)


def made(rng, n, longest, letters):
    rows = []
    for c in rng.sample(range(3 * n), n):
        rows += [(c, k, rng.choice(["user", None, "bot"][:2]), rng.choice(letters)) for k in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = made(rng, 60, 12, ["one two", "a", "", None, "b c\td"])
    rows += [(7000 + i, k, "user", "same words here") for i in range(50) for k in range(5)]  # a large group of copies
    rows += [(9000, k, "user", "x") for k in range(90)] + [(9020, k, "user", "x") for k in range(95)]  # longer than many segments
    rows += [(None, 1, "user", "nobody"), (50, None, None, "first"), (50, 3, "user", "tie"), (50, 3, "user", "tie"), (50, 3, "bot", "tie")]
    rows = [r for r in rows if r[0] != 50 or r[3] in ("first", "tie")]
    want = slow_nodes(rows)
    assert nodes(spark, rows) == want
    assert nodes(spark, rows, size=4) == want  # segments that conversations span


def test_one_conversation_without_turns_left(spark):
    gone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)  # its base is absent and its own turns are the skipped ones
    rows = [(gone, 1, "user", "a")]
    assert nodes(spark, rows) == slow_nodes(rows) == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]


def test_empty_table_and_other_columns(spark):
    assert P.family_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, 1, "user", "a"), (3, 2, "bot", "b"), (3, 3, "bot", "b"), (3, 4, "bot", "b")]
    more = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("depth", "keys", "end", "low", "k", "part")})
    assert sorted(map(tuple, P.family_trie(more).select(*COLUMNS).collect()), key=repr) == slow_nodes(rows)


def test_two_fattest(spark):
    pairs = [(a, e) for a in range(40) for e in range(a + 1, 41)] + [(0, 2**40 + 5), (2**40, 2**40 + 7)]
    got = spark.createDataFrame(pairs, "a long, e long").select("a", "e", P.two_fattest(F.col("a"), F.col("e")).alias("f")).collect()
    for a, e, f in got:
        assert a < f <= e
        if e < 100:
            assert f == max(range(a + 1, e + 1), key=lambda x: x & -x)


def test_insert_adds_to_a_trie(spark):
    rng = random.Random(8)
    rows = made(rng, 40, 6, ["p", "q"])
    every, turns = P.families(P.turns_of(spark.createDataFrame(rows, SCHEMA)))
    parts = P.segments(turns, 3)
    whole = P.stored(P.strings(P.stored(parts)))
    first = P.insert(None, whole.where(F.xxhash64("end") % 2 == 0))
    both = P.insert(first, whole.where(F.xxhash64("end") % 2 != 0))
    cells = lambda df: sorted((r.a + i + 1, k.hi, k.lo) for r in df.collect() for i, k in enumerate(r["keys"]))
    assert cells(both) == cells(P.insert(None, whole))
    # every string ends in a node
    ends = {tuple(r["keys"][-1]) for r in both.collect()}
    assert {tuple(r.end) for r in whole.collect()} <= ends
    # strings that are in the trie are located at their very ends
    found = P.locate(both, whole.withColumn("low", F.col("d0")))
    assert found.where(F.col("low") != F.col("d0") + F.size("keys")).count() == 0
