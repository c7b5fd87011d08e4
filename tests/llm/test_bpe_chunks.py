import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windrow.llm import bpe_chunks as B

END = "<|endoftext|>"


@pytest.fixture(scope="module")
def codec():
    return B.Codec()


def texts(rng):
    words = ["the", "it's", "we'll", "año", "naïve", "straße", "слово", "日本語", "12", "3.14", "!!", "'", "'re", END, "\t", "  ", "\n\n", " ", " ", "🙂", "x" * 40]
    passage = " ".join(rng.choice(words) for _ in range(400))
    out = [None, "", " ", "a", END, END * 3, "a " + END + " b", "<|endof", "nospaces" * 3000, "日本語" * 3000, " " * 5000, "á" * 700]
    for _ in range(30):
        own = rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 900)))
        out += [own, own + passage, passage + own, own[: len(own) // 2] + passage + own[len(own) // 2 :]]
    return out + ["word " * 60_000, passage * 40]


def test_same_as_the_tokenizer(spark, codec):
    every = texts(random.Random(4))
    docs = spark.createDataFrame([(None if i == 5 else i % 50, t, "x", i) for i, t in enumerate(every)], "doc_id int, text string, row string, parts int").repartition(5)
    got = B.encode(docs)
    assert got.columns == ["doc_id", "row", "parts", "ids"]
    rows = B.decode(got).collect()
    assert len(rows) == len(every)
    for r in rows:
        text = every[r["parts"]] or ""
        want = codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert r["ids"] == want, text[:80]
        assert r["text"] == codec.tokenizer.decode(want, skip_special_tokens=False) == text
        assert r["row"] == "x"


def test_chunks_of_shared_passages_are_encoded_once(spark, monkeypatch):
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(20)]
    names = B.repeated(spark.createDataFrame(rows, "doc_id int, text string"), "text").collect()
    inside = [B.name_of(c) for c in B.chunks(passage.encode())]
    found = {tuple(r) for r in names}
    assert sum(n in found for n in inside) >= len(inside) - 4  # all but those at the passage's ends
    assert len(found) <= len(inside) + 2


def test_chunks(codec):
    rng = random.Random(2)
    for raw in (b"", b"abc", ("ä" * 50_000).encode(), bytes(rng.choices(b"abc d", k=300_000)), b"\xe2\x80\xa8" * 9_000):
        parts = B.chunks(raw)
        assert b"".join(parts) == raw
        assert all(len(p) <= B.MOST + 3 for p in parts)
        assert all(len(p) >= B.LEAST for p in parts[:-1])
        for p in parts:
            p.decode("utf-8")
    # slices of the rolling hash make no difference
    data = np.frombuffer(bytes(rng.choices(range(256), k=9_000)), np.uint8)
    whole = B._candidates(data)
    before, B.SLICE = B.SLICE, 1000
    try:
        assert np.array_equal(whole, B._candidates(data))
    finally:
        B.SLICE = before
    h = lambda i: sum(int(B.GEARS[data[i - k]]) << k for k in range(min(B.WINDOW, i + 1))) % 2**32
    assert whole.tolist() == [i + 1 for i in range(len(data)) if h(i) >> (32 - B.CUT_BITS) == 0]


def test_joins_at_any_place(codec):
    rng = random.Random(9)
    for text in texts(rng):
        text = (text or "")[:400]
        want = codec.tokenizer.encode(text, add_special_tokens=False).ids
        for _ in range(4):
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 9))))
            parts = [codec.encode(text[a:b].encode()) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            assert codec.joined(parts).tolist() == want, (text, cuts)


def test_plain_characters_agree(codec):
    plain = [chr(c) for c in range(0x250) if B.PLAIN.fullmatch(chr(c))]
    for c in plain:
        for text in (c, f"a{c}b", f" {c} ", f"1{c}{c}2", f"{c}'s {c}'t"):
            assert codec.plain.encode_ordinary(text) == codec.tokenizer.encode(text, add_special_tokens=False).ids


def test_decoding_broken_bytes(codec):
    rng = random.Random(6)
    for _ in range(200):
        ids = [rng.randrange(len(codec.bytes_of)) for _ in range(rng.randint(1, 20))]
        assert codec.decode(np.array(ids)) == codec.tokenizer.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert B.decode(B.encode(empty)).count() == 0
    assert B.decode(spark.createDataFrame([(None,)], "ids array<int>")).select(F.col("text")).first()[0] == ""


def test_one_python_pass_a_stage(spark, tmp_path):
    """Each Python operator costs a worker a running task: texts with and without repeated chunks have one each, however often results are used."""
    every = [t for t in texts(random.Random(6)) if t is None or len(t) < 20_000]
    spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = B.query(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    assert got.count() == len(every)


def test_decoded_text_in_the_same_pass(spark):
    every = [t for t in texts(random.Random(8)) if t is None or len(t) < 20_000]
    docs = spark.createDataFrame([(i, t, f"own {i}", "old") for i, t in enumerate(every)], "doc_id int, text string, out string, back string").repartition(3)
    got = B.encode(docs, decoded_col="back")
    assert got.columns == ["doc_id", "out", "ids", "back"]
    rows, want = got.collect(), {r["doc_id"]: r for r in B.decode(B.encode(docs)).collect()}
    assert len(rows) == len(every)
    for r in rows:
        assert r["ids"] == want[r["doc_id"]]["ids"]
        assert r["back"] == want[r["doc_id"]]["text"] == (every[r["doc_id"]] or "")
        assert r["out"] == f"own {r['doc_id']}"


def test_long_rows_are_handed_on_by_few():
    rows = ["a", None, "b" * (B.HANDED - 1), "c", "d" * (2 * B.HANDED), "", *["e"] * (B.ROWS + 1)]
    parts = [p.tolist() for p in B._slices(iter([pd.Series(rows, dtype=object), pd.Series([], dtype=object)]))]
    assert sum(parts, []) == rows
    assert all(len(p) == 1 or len(p) <= B.ROWS and sum(len(r or "") for r in p) <= B.HANDED for p in parts)
    assert len(parts) == 5
