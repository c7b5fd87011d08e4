"""Operators on tables whose further columns bear the operators' inner names: the columns come back as they were."""

import math

import pytest
from pyspark.sql import functions as F

from windrow.llm import decontamination, language_id, lm_scoring, media_png, quality, simhash
from windrow.llm.url_filter import PATTERN_RULES, SITE_RULES, Rule, judge

INNER = (
    "_row", "_s", "_known", "_base", "_ppm", "token", "tokens", "times", "key", "n", "_hits", "row", "item", "top", "best", "seed", "_hash", "_d", "_h", "hash", "fp", "root", "first", "least", "_key",
    "_guess", "guess", "_read", "got", "_host", "_path", "_n", "_host_n", "_host_s", "_evidence", "_host_rate", "_path_rate", "_score", "own_host", "own_path", "host_n", "s", "_url", "target", "regex",
    "rule_id", "is_site", "length", "callers_columns", "a.b", "with `tick`",
)
TEXTS = ["the quick brown fox jumps over the lazy dog", "der schnelle braune Fuchs springt", "", None, "the quick brown fox jumps over the lazy dog", "one two three four five six seven eight nine ten " * 4]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 2}", f"http://x{i}.com/de/{i}") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string")
    return df.select("*", *[F.concat(F.lit(c + "-"), F.col("doc_id").cast("string")).alias(c) for c in INNER])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, TEXTS[5])], "item_id long, text string")


CASES = {
    "judge": lambda df, labels: judge(df, [*SITE_RULES, *PATTERN_RULES]),
    "predict": lambda df, labels: language_id.predict(df, language_id.train(df)),
    "predict_without_model": lambda df, labels: language_id.predict(df, None),
    "posterior": lambda df, labels: quality.posterior(df, labels),
    "find": lambda df, labels: decontamination.find(df, benchmark(df.sparkSession)),
    "score": lambda df, labels: lm_scoring.score(df, df.select("text"), order=2),
    "media": lambda df, labels: media_png.media_features(media_png.with_media(df)).drop("media"),
    "keep_first": lambda df, labels: simhash.keep_first(df),
    "keep_language": lambda df, labels: language_id.keep(df, language_id.train(df)),
    "keep_good": lambda df, labels: quality.keep(df, labels),
    "keep_clean": lambda df, labels: decontamination.keep(df, benchmark(df.sparkSession)),
}


@pytest.mark.parametrize("name", CASES)
def test_inner_names(docs, labels, name):
    got = CASES[name](docs, labels)
    assert len(set(got.columns)) == len(got.columns) and set(INNER) <= set(got.columns)
    rows = [r.asDict() for r in got.collect()]
    assert all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in INNER)
    plain = CASES[name](docs.select("doc_id", "text", "lang", "source", "url"), labels)
    mine = [c for c in plain.columns if c != "text"]
    value = lambda r: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in mine)
    assert sorted(map(value, rows), key=repr) == sorted((value(r.asDict()) for r in plain.collect()), key=repr)


def test_result_names_are_replaced(docs):
    df = docs.select("doc_id", "text", "url", F.lit("x").alias("feature"), F.lit("x").alias("tail_crc32"))
    got = media_png.media_features(media_png.with_media(df))
    assert sorted(got.columns) == sorted({*df.columns, "media", "payload_bytes", "payload_sha256"}) and got.where("feature = 'x'").count() == 0


def test_only_a_text_column(docs):
    assert lm_scoring.score(docs.select("text"), docs.select("text"), order=1).count() == len(TEXTS)


def test_long_tokens_are_joined(spark):
    """Tokens over the byte bound count as the others do, however frequent."""
    long = "x" * (lm_scoring.SHARED_BYTES + 1)
    df = spark.createDataFrame([(0, f"{long} {long} a"), (1, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(df, df.select("text"), order=1).collect()}
    assert (got[0].n_tokens, got[0].n_known, got[0].train_tokens) == (4, 4, 6)
    space = 6 + 0.1 * 4  # three distinct ones
    assert math.isclose(got[0].base_score, 3 * math.log10(2.1 / space) + math.log10(2.1 / space), rel_tol=1e-12)


def test_rules_without_a_token(spark):
    """They run on every URL; more than one block of them."""
    rules = [Rule("block", pattern="evil*"), Rule("allow", pattern="*evildoer"), *SITE_RULES]
    assert not rules[0].tokens and not rules[1].tokens
    urls = ["http://x.net/anevilthing", "http://x.net/evildoer", "http://x.net/a", "http://x.com/de/evil"]
    got = {r.url: (r.rule, r.pattern, r.verdict) for r in judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got == {urls[0]: (None, "evil*", "block"), urls[1]: (None, "*evildoer", "allow"), urls[2]: (None, None, "allow"), urls[3]: ("com/de/", None, "block")}


def test_crowded_keys_are_counted_whole(spark):
    """A half that thousands of fingerprints share, against all pairs of a part of them."""
    fps = [(7 << 32) | (i * 2654435761 % (1 << 32)) for i in range(3000)] + [(7 << 32) | 1, (7 << 32) | 3]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in set(fps)], "fp long")).collect()}
    own = sorted(set(fps))
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert got == want
