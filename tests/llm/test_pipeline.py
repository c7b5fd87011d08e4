from collections import Counter

import corpus_pipeline as P
from windrow.llm import decontamination, mixing
from windrow.llm.simhash import fingerprint

D = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    steps = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, D).checkpoint()
        steps[name] = (before, docs)
        assert docs.columns[: len(columns)] == columns if k == 4 else docs.columns == columns
        assert docs.select("doc_id").distinct().count() == docs.count() > 0

    before, after = steps["language_id"]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) <= 0.02 * before.count()

    labels = spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "quality")
    before, after = steps["quality"]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    rows = before.join(labels, "doc_id").collect()
    assert sum((r.doc_id in kept) == bool(r.quality) for r in rows) >= 0.95 * len(rows)

    before, after = steps["simhash_dedup"]
    rows = [(r.doc_id, fingerprint(r.text)) for r in before.collect()]
    group = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for d, f in rows:
            least = min(group[e] for e, g in rows if bin(f ^ g).count("1") <= 2)
            if least < group[d]:
                group[d], changed = least, True
    assert {r.doc_id for r in after.collect()} == set(group.values())

    before, after = steps["decontamination"]
    items = [decontamination.tokens_of(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    assert all(len(x) >= 13 for x in items)
    for r in before.collect():
        text = decontamination.tokens_of(r.text)
        if len(text) < 120:
            spans = [(x, i, k) for x in items for i in range(len(x) - 12) for k in range(len(text) - 12) if x[i] == text[k] or x[i + 1] == text[k + 1] or x[i + 2] == text[k + 2]]
            leak = any(sum(map(str.__eq__, x[i : i + 13], text[k : k + 13])) >= 11 for x, i, k in spans)
            assert leak == (r.doc_id not in kept)

    before, after = steps["mixing"]
    sizes = Counter()
    for r in before.collect():
        sizes[r.source] += len(r.text.split())
    got = after.collect()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r.size and 1 <= r.copies <= mixing.MOST
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 20_000


def test_run_is_the_stages_in_a_row(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "text", "lang", "source", "n_chars", "taken"} <= set(got.columns)


def test_null_rows(spark, tmp_path):
    rows = [(i, t, lang, s, n) for i, (t, lang, s, n) in enumerate([(None, None, None, None), ("", "en", "a", 0), ("the words of one text here", "en", "a", 5), ("the words of one text here", None, None, 5)])]
    docs = spark.createDataFrame([*rows, (None, "other words in a text", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.doc_id, r.source) for r in P.run(spark, str(tmp_path)).collect()}
    assert (2, "a") in got and (3, None) not in got and not {(0, None), (1, "a")} & got


def test_mixing_keeps_rows_with_null_and_repeated_ids_apart(spark):
    rows = [(d, f"words of text number {i} in the corpus", "en", "a", 1) for i, d in enumerate([None, None, None, 4, 4, 5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.text for r in P.mixed(spark, docs, D).collect()]
    assert len(got) == len(set(got)) > 0


def test_run_with_repeated_and_null_ids(spark, tmp_path):
    texts = ["first words of some text here", "second text with other words", "a third one that is not alike", "numbers four and five of it", "yet another sentence of words", "the last of these texts is here"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5]), (9, texts[5]), (8, texts[5]), (None, texts[5])]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [(r.doc_id, r.text) for r in P.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([*rows[:5], (8, texts[5])], key=repr)
