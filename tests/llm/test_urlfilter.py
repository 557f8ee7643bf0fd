import random
import re

from streetloom.llm import queries, urlfilter
from streetloom.llm.urlfilter import Rule

RULES = queries.URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(url):
    host, path = split(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_rules_and_parts(spark):
    rng = random.Random(2)
    hosts = ["a.example.org", "EXAMPLE.org", "badexample.org", "org", "x.com", "com", "É.com", "example.net", ""]
    paths = ["", "/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/x?y=/de/", "/de/#f", "?q", "#x/y", "/fr/a://b"]
    urls = [None, "", "no scheme", "http:/x.org/", "://org/"] + [f"{rng.choice(['http', 'HTTPS'])}://{h}{p}" for h in hosts for p in paths]
    pages = spark.createDataFrame([(i, u, "<p>x</p>", "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    for r in urlfilter.judge(pages, RULES).collect():
        assert (r.host, r.path) == split(urls[r.page_id])
        rule = rule_of(urls[r.page_id])
        assert (r.rule, r.verdict) == ((rule.name, rule.verdict) if rule else (None, "allow")), urls[r.page_id]


def test_aliases(spark):
    link = '<html><LINK href="{}" rel=canonical><p>'.format
    move = "<meta http-equiv='Refresh' content='3; URL=\"{}\"'>".format
    rows = [
        (1, "http://one.net/a", link("http://two.net/b?x&amp;y#top")),
        (2, "http://TWO.net/b?x&y#other", move("https://example.org/es/9")),
        (3, "http://three.net/", move("/home")),
        (4, "http://three.net/home", link("//v.org/ok")),
        (5, "http://v.org/no", move("http://three.net/")),
        (6, "http://three.net/home", link("https://example.org/es/77")),
        (7, "http://alone.net/", "canonical http-equiv <link rel='canonical'><meta content=5 http-equiv=refresh>"),
        (8, None, link("http://example.org/es/1")),
        (9, "http://x.com/de/", link("http://v.org/fine")),
        (10, "http://s.net/1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    moves = spark.createDataFrame([("http://s.net/1", "http://s.net/2"), ("http://s.net/2", "http://y.com/de/"), (None, "http://s.net/2")], "source string, target string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, RULES, redirects=moves).collect()}
    assert got[1] == got[2] == (None, "block")  # through two.net to a blocked path
    assert got[3] == got[4] == got[6] == (None, "allow")  # an allowed and a blocked alias
    assert got[5] == ("org/", "allow") and got[7] == got[8] == (None, "allow")
    assert got[9] == ("com/de/", "block") and got[10] == (None, "block")


def test_ties_empty_and_native(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = urlfilter.judge(pages, RULES)
    assert made.collect() == []
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    one = spark.createDataFrame([(1, "http://a.b/c", "")], "page_id long, url string, html string")
    both = [Rule("block", "a.b", "/c"), Rule("allow", "a.b", "/c"), Rule("block", "b", "/c")]
    assert urlfilter.judge(one, both).first().verdict == "allow"
    assert urlfilter.judge(one, [], html_col=None).first().rule is None
