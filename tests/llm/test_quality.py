import math

from windrow.llm import quality as Q


def rows(spark):
    good = "These are plain words of a text that says number {} to its reader and then some more of it."
    bad = "BUY!! NOW!! {}*** CHEAP&&& BUY!! NOW!! | | | ###"
    docs, labels = [], []
    for i in range(400):
        host = ("clean", "junk", None)[i % 3]
        is_good = i % 10 > 0 if host == "clean" else i % 10 > 6
        docs.append((i, (good if is_good else bad).format(i * 7), host, "p1" if i % 4 else None, 1.0))
        labels.append((i, int(is_good)))
    docs += [(1000, None, "clean", "p1", 1.0), (1001, "", "junk", "p9", 1.0), (1002, "zz", "new", "p1", 1.0), (1002, "zz", "new", "p1", 1.0), (None, "x " * 100_000, None, None, 1.0)]
    labels += [(None, 1), (1000, None), (1001, 5)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_posterior_against_the_definition(spark):
    docs, labels = rows(spark)
    got = Q.posterior(docs, labels).collect()
    assert len(got) == docs.count() and [c for c in got[0].asDict()] == [*[c for c in docs.columns if c not in ("score", "text")], "evidence", "host_rate", "path_rate", "score", "keep"]
    model, rate = Q.fit(docs, labels)
    off = math.log(rate / (1 - rate))
    p = [1 / (1 + math.exp(-(r.evidence + off))) for r in got]

    def strength(groups):
        n = sum(len(g) for g, _ in groups)
        d = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in groups)
        v = sum(m * (1 - m) for _, m in groups)
        spread = (d - v) / n
        return Q.STRENGTH[1] if spread <= 0 else min(max(v / len(groups) / spread - 1, Q.STRENGTH[0]), Q.STRENGTH[1])

    hosts, paths = {}, {}
    for r, x in zip(got, p, strict=True):
        hosts.setdefault(r.source, []).append(x)
        paths.setdefault((r.source, r.lang), []).append(x)
    mean = sum(p) / len(p)
    kh = strength([(g, mean) for g in hosts.values()])
    kp = strength([(g, (kh * mean + sum(hosts[h])) / (kh + len(hosts[h]))) for (h, _), g in paths.items()])
    for r, x in zip(got, p, strict=True):
        h, g = hosts[r.source], paths[r.source, r.lang]
        host = (kh * mean + sum(h) - x) / (kh + len(h) - 1)
        path = (kp * host + sum(g) - x) / (kp + len(g) - 1)
        z = r.evidence + math.log(path / (1 - path))
        assert abs(r.host_rate - host) < 1e-9 and abs(r.path_rate - path) < 1e-9 and abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
    by = {r.doc_id: r for r in got}
    assert all(by[i].keep == bool(y) for i, y in labels.where("quality in (0, 1) and doc_id < 1000").collect())
    assert by[1002].host_rate > by[1001].host_rate  # a sparse site stays near the global rate


def test_nothing_to_learn_and_empty(spark):
    docs, labels = rows(spark)
    assert Q.keep(docs, labels.limit(0)).count() == docs.count()
    assert Q.posterior(docs.limit(0), labels).count() == 0


def test_labels_of_the_tables(spark):
    d = "/root/testdata/sf0.01"
    got = Q.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in got) >= 0.95 * len(got)


def test_evidence_of_held_out_rows(spark):
    """Fitted on half of the labelled rows, the classifier tells the other half's good and bad texts apart."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    model, _ = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    got = Q.with_evidence(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    for quality in (0, 1):
        own = [r.evidence > 0 for r in got if r.quality == quality]
        assert len(own) > 30 and sum(x == bool(quality) for x in own) >= 0.9 * len(own)


def test_features_by_definition():
    assert [Q.shape(w) for w in ("Plain", "plain", "ABC!!", "a1b22", "...", "Ünï##")] == ["Ta", "la", "Ua!", "la0a0", "l.", "Ta#"]
    at, value = Q.Features()("one two\none two")
    got = dict(zip(at.tolist(), value.tolist(), strict=True))
    want = {"wone": 2, "wtwo": 2, "sla": 4, "pla la": 3, "words 3 5": 1, "lines 3 5": 1, "size 3": 1}
    assert got == {Q.bucket(k): math.sqrt(v / 4) for k, v in want.items()}
    assert not len(Q.Features()(None)[0])
    same = Q.Features()  # what a store has seen before changes nothing
    for text in ("b a!! c9", "Ünï ## ab one", "one two\none two", "", "one two\none two"):
        first, again = Q.Features()(text), same(text)
        assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()
