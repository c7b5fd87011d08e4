import random
from collections import defaultdict

from windrow.llm import mixing as M


def slow_targets(sizes):
    """Reshares by weight until no target is above twice its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in over)
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    return sorted(map(tuple, M.mix(docs).collect()), key=repr)


def test_words_targets_and_bounds(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        source = rng.choice(["a", "a", "a", "b", "c", "é", "Z", None, "tiny"]) if i > 5 else "tiny"
        source = "b" if source == "tiny" and i > 5 else source
        n = rng.choice([0, 1, 5, 40, 200]) if i else 3000
        rows.append((i, " \n".join(["w"] * n) if n else rng.choice([None, "", " \t"]), source, "x"))
    rows.append((None, "no id", "a", "x"))
    rows += [(7777, "same row", "c", "x")] * 300
    got = run(spark, rows)
    assert len(got) == len(rows)
    sums, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for _, s, size, _, t, copies, took in got:
        sums[s] += size
        taken[s] += took
        target[s] = t
        longest[s] = max(longest[s], size)
        assert took == copies * size and 0 <= copies <= 2
    assert all(r[3] == sums[r[1]] for r in got)
    for s, t in slow_targets(dict(sums)).items():
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= longest[s]
    assert run(spark, rows[::-1]) == got


def test_many_levels_keep_words(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "BIN", 32)
    rows = [(i, "w " * (1 + i % 7), "s" if i % 3 else "t", "x") for i in range(1500)]
    got = run(spark, rows)
    assert sorted(r[0] for r in got) == list(range(1500))
    for s in "st":
        mine = [r for r in got if r[1] == s]
        assert abs(sum(r[6] for r in mine) - mine[0][4]) <= 7


def test_expected_copies(spark):
    """Over many alike groups, the share of documents taken once more is near the fraction."""
    rows = [(i, "w " * (1 + i % 5), f"s{i % 30:02d}", "x") for i in range(6000)]
    for size in range(1, 6):
        mine = [r for r in run(spark, rows) if r[2] == size]
        want = sum(r[4] / r[3] for r in mine)
        assert abs(sum(r[5] for r in mine) - want) < 4 * len(mine) ** 0.5


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, "x"), (2, "", "a", "x")]) == [(1, None, 0, 0, 0.0, 0, 0), (2, "a", 0, 0, 0.0, 0, 0)]
