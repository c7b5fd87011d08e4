import re

from windrow.llm import url_filter
from windrow.llm.url_filter import PATTERN_RULES, SITE_RULES, Rule, judge

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1", "https://a.b.example.org/es", "http://example.org/en/12",
    "http://example.org/en/2?x=/es/", "http://example.org", "http://example.org?q=/", "http://notexample.org/es/",
    "http://x.com/fr/1", "http://x.com/de/1#top", "http://x.net/de/", "http://spam-farm.x.net/a", "http://my-spam-farm.net/a",
    "http://x.net/casino/", "http://x.net/a?u=http://y.org/", "http://x.net/WP-login.php?x", "http://x.net/" + "a" * 5000,
    "http://www.cheap-pills.net/a", "http://cheap-pills.net/b/leaflet/c", "http://x.net/crack/1/keygen", "http://x.net/a?affiliate_id=3", "http://casino-museum.net/a", "http://x.net/feed/?a",
    "http://x.org:80/a", "http://x.net/a/casino/b", "://x.org/z", "http://É.org/é",
]


def expected(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    after = rest[len(host) :]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", after)[0]
    fits = [r for r in rules if r.host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        r = max(fits, key=lambda r: (len(r.name), r.verdict == "block", r.name))
        return host, path, r.name, None, r.verdict
    fits = [r for r in rules if not r.host and rest and re.search(r.regex, host + after)]
    if fits:
        r = max(fits, key=lambda r: (len(r.name), r.verdict == "block", r.name))
        return host, path, None, r.name, r.verdict
    return host, path, None, None, "allow"


def test_matches_every_rule_against_every_url(spark):
    rules = [*SITE_RULES, *PATTERN_RULES, Rule("block", pattern="*q=*")]
    rows = [(i % 20, u, "old") for i, u in enumerate(URLS * 2)]
    got = judge(spark.createDataFrame(rows, "page_id int, url string, rule string"), rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "pattern", "verdict"]
    found = sorted(((r.page_id, r.url or "", r.host, r.path, r.rule, r.pattern, r.verdict) for r in got.collect()), key=repr)
    assert found == sorted(((i, u or "", *expected(u, rules)) for i, u, _ in rows), key=repr)


def test_rule_without_literal_token_and_empty_table(spark):
    assert Rule("block", pattern="*q=*").tokens == []
    assert Rule("block", host="example.org", path="/en/1").tokens == ["en", "example", "org"]
    assert Rule("block", pattern="||spam-farm.").tokens == ["farm", "spam"]
    assert judge(spark.createDataFrame([], "page_id int, url string"), list(SITE_RULES)).count() == 0


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", 5)
    rules = [*SITE_RULES, *PATTERN_RULES, *(Rule("block", pattern=f"/made-up-{i}/") for i in range(300)), Rule("block", pattern="*q=*")]
    rows = list(enumerate([*URLS, "http://x.net/made-up-77/"]))
    got = judge(spark.createDataFrame(rows, "page_id int, url string"), rules).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.pattern, r.verdict) for r in got} == {(i, *expected(u, rules)) for i, u in rows} and len(got) == len(rows)


def test_pattern_rules_decide_some_of_the_pages(spark):
    got = url_filter.query(spark, "/root/testdata/sf0.1").groupBy("pattern").count().where("pattern is not null").collect()
    assert len(got) >= 5 and sum(r["count"] for r in got) >= 50
    assert len([r for r in PATTERN_RULES if not r.tokens]) == 0
