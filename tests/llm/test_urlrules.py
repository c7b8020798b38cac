import re

import odd
from riskframe.llm import urlrules as U


def split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def given(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in U.GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_pages_against_brute_force(spark, data):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in U.query(spark, data).collect():
        host, path = split(url[r.page_id])
        rule, verdict = given(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ({verdict} if verdict else {"allow", "block"})


def test_given_rules(spark):
    urls = ["http://a.example.org/es/x", "http://example.org/en/12", "http://Example.ORG/en/2?x", "http://notexample.org/es/", "http://x.com/fr/", "http://com/de/1", "http://x.org", "http://x.net/a", None, "no scheme", "http://u@X.org:80/p#f", "", "://org/", "http://a.b/://c.org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    rules = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    for r in U.judge(pages, rules).collect():
        host, path = split(urls[r.page_id])
        rule, verdict = given(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def planted():
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        host = ("casino-%d.net" % (i % 7)) if bad else ("site%d.net" % (i % 11))
        rows.append((f"http://www.{host}/{'win' if i % 3 else 'fun'}/{i}.html?ref=x", bad))
        rows.append((f"http://shop.example.net/{'sale' if i % 2 else 'news'}/{'win' if i % 4 < 2 else 'fun'}/{i}", i % 2 == 1 and i % 4 < 2))
    return rows


def test_mined_combinations_and_index(spark, monkeypatch):
    rows = planted()
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = U.mine(labelled, min_support=0.01)
    found = {tuple(r.tokens) for r in rules.collect()}
    assert ("w:casino",) in found and ("p:sale", "p:win") in found and not any("w:casino" in t and len(t) > 1 for t in found)
    pages = labelled.select("url").union(spark.createDataFrame([(None,), ("http://casino-new.net/a",), ("http://casino-new.net/a",)], "url string"))
    want = {u: any(set(t) <= set(own) for t in found) for u, own in pages.where("url is not null").select("url", U.tokens_of(pages.url)).collect()}
    for bound in (U.BROADCAST_RULES, 0):
        monkeypatch.setattr(U, "BROADCAST_RULES", bound)
        got = U.judge(pages, rules).collect()
        assert len(got) == len(rows) + 3 and all((r.verdict == "block") == (r.url is not None and want[r.url]) for r in got)
    assert all((r.verdict == "block") == dict(rows)[r.url] for r in got if r.url in dict(rows))


def test_a_few_urls_are_no_rule(spark, data):
    """What few URLs show is chance: no rule from single pages, at any size of the table."""
    few = [(f"http://site.net/a/{i}?cheap=1", True) for i in range(19)] + [(f"http://site.net/b/{i}", False) for i in range(60)]
    assert U.mine(spark.createDataFrame(few, "url string, bad boolean")).count() == 0
    more = [(f"http://site.net/a/{i}?cheap=1", True) for i in range(40)] + [(f"http://site.net/b/{i}", i % 4 == 0) for i in range(60)]
    assert {tuple(r.tokens) for r in U.mine(spark.createDataFrame(more, "url string, bad boolean")).collect()} == {("p:a",), ("q:cheap",)}
    assert U.query(spark, data).where("rule IS NULL AND verdict = 'block'").count() == 0


def test_rules_against_brute_force(spark):
    """All subsets of tokens, counted one by one."""
    from itertools import combinations

    rows = planted()
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    own = {r.url: set(r.own) for r in labelled.select("url", U.tokens_of(labelled.url).alias("own")).collect()}
    counts = {}
    for url, bad in rows:
        for k in range(1, len(own[url]) + 1):
            for part in combinations(sorted(own[url]), k):
                n, right = counts.get(part, (0, 0))
                counts[part] = (n + 1, right + bad)
    z = U.DEVIATIONS

    def bound(n, right):
        p = right / n
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    good = {t: bound(n, right) for t, (n, right) in counts.items() if right >= max(U.MIN_URLS, 0.01 * len(rows)) and bound(n, right) >= U.MIN_CONFIDENCE}
    want = {t for t, c in good.items() if not any(good.get(tuple(x for x in t if x != y), -1) >= c for y in t)}
    assert {tuple(r.tokens) for r in U.mine(labelled, min_support=0.01).collect()} == want


def test_odd_rows(spark):
    pages = odd.docs(spark).withColumnsRenamed({"text": "url"})
    rules = U.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = U.judge(pages, rules).collect()
    assert len(got) == len(odd.ROWS) and {(r.host, r.verdict) for r in got} == {("", "allow")}
    assert U.judge(odd.none(spark).withColumnsRenamed({"text": "url"}), rules).count() == 0
    assert U.mine(spark.createDataFrame([("http://a.b/c", False), (None, True), ("http://a.b/c", None)], "url string, bad boolean")).count() == 0
