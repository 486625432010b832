import itertools
import random
import re

from pyspark.sql import functions as F

from docloom.llm import url_rules
from docloom.llm.queries import URL_RULES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def by_hand(host, path):
    fit = [(v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[1]), default=(None, None))


URLS = [None, "", "no scheme", "http://", "http://A.Net/x", "http://net/", "http://net", "http://xnet/", "https://www.Example.NET/en/1?q#f", "https://example.net/EN/1", "http://example.com/de/1", "http://example.com/de", "http://a.org/fr/x", "http://org?/fr/", "ftp://a.b#c://d/e", "http://é.ORG/fr/ü?x=://y", "http://u@h:80/de/", "a://b://c/d", "http://" + "x" * 30_000 + "/y"]


def test_parsing_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS + URLS[4:6])], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = sorted(tuple(r) for r in url_rules.judge(df, none, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    want = [(i, *parse(u), by_hand(*parse(u))[1], by_hand(*parse(u))[0] or "allow") for i, u in enumerate(URLS + URLS[4:6])]
    assert got == want
    assert url_rules.judge(df.limit(0), none, URL_RULES).count() == 0


def test_mined_rules_equal_all_subsets(spark):
    rng = random.Random(3)
    tokens, rows = list("abcdef"), []
    for i in range(400):
        own = sorted(t for t in tokens if rng.random() < 0.4)
        chance = 0.9 if {"a", "b"} <= set(own) else 0.7 if "f" in own and "c" in own else 0.1
        rows.append((i, [*own, *(["y", "z"] if "d" in own else [])], rng.random() < chance))
    rows.append((400, [], True))
    df = spark.createDataFrame(rows, "page_id long, tokens array<string>, bad boolean")
    got = {tuple(r.tokens): (round(r.confidence, 9), r.hits) for r in url_rules.mine_rules(df, 0.02, 10, 0.5, 1.5).collect()}
    least = max(10, 0.02 * len(rows))
    base = sum(b for _, _, b in rows) / len(rows)
    want = {}
    for n in range(1, 7):
        for some in itertools.combinations(tokens, n):
            hit = [b for _, t, b in rows if set(some) <= set(t)]
            if len(hit) >= least and sum(hit) / len(hit) >= max(0.5, 1.5 * base):
                c = sum(hit) / len(hit)
                if not any(set(w) < set(some) and v[0] >= round(c, 9) for w, v in want.items()):
                    want[some] = (round(c, 9), len(hit))
    assert got == want and ("a", "b") in got


def test_mined_rules_block_pages(spark):
    pages = [(i, f"http://{'ads' if i % 4 == 0 else 'www'}.site{i % 7}.example/{'promo?bad=zz' if i % 4 == 0 else 'news'}/{i}") for i in range(400)]
    pages += [(2000, "foo?bad=zz"), (2001, "://?bad=zz"), (2002, "?bad=zz"), (2003, None)]
    pages += [(1000, "http://ADS.other.example/promo/9"), (1001, "http://ads.net/promo/1")]
    labels = [(i, i % 4 == 0) for i in range(0, 300)] + [(5, None), (8, True), (5555, True)]
    p = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_rules.judge(p, spark.createDataFrame(labels, "page_id long, bad boolean"), URL_RULES).collect()}
    assert all(got[i].verdict == ("block" if i % 4 == 0 else "allow") for i in range(400))
    assert all(got[i].verdict == "allow" and got[i].confidence is None for i in range(2000, 2004))
    assert got[1000].verdict == "block" and got[1000].rule is None and got[1001].rule == "net/"
    assert url_rules.judge(p, spark.createDataFrame(labels, "page_id long, bad boolean").where(F.lit(False)), []).where("verdict = 'block'").count() == 0


def test_needed_share_can_be_reached_at_every_base_rate():
    for base in [i / 100 for i in range(1, 100)]:
        share = url_rules.needed_share(base, 2.0)
        assert base < share < 1 and (base > 1 / 3 or share == 2 * base)


def test_rules_are_mined_when_most_labels_are_bad(spark):
    for bad in (5, 7):  # of ten other pages
        rng = random.Random(bad)
        pages = [(i, f"http://{'spam' if i < 100 else 'good' if i < 200 else f'w{i}'}.example/{i}", i != 0 and (i < 100 or i >= 200 and rng.random() < bad / 10)) for i in range(1200)]
        pages += [(i, f"http://w{i}.example/{i}", True) for i in range(1200, 1200 + (0 if bad == 5 else 140))]
        df = spark.createDataFrame(pages, "page_id long, url string, bad boolean").repartition(3)
        share = sum(b for _, _, b in pages) / len(pages)
        assert abs(share - bad / 10) < 0.06
        got = {r.page_id: r.verdict for r in url_rules.judge(df.select("page_id", "url"), df.select("page_id", "bad"), []).collect()}
        assert all(got[i] == ("block" if i < 100 else "allow") for i, _, _ in pages)
