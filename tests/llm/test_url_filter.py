import random

from compare import compare, duck_connect

from kontor.llm import url_filter as uf

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/x/", "allow"),
         ("b.example.org", "/es/", "allow"), ("com", "/fr/", "allow"), ("com", "", "block"), (None, "/", "block"),
         ("", "/", "block"), ("net", "/a", "allow"), ("net", "/a", "block"), ("net", None, "allow")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for h, p, _ in RULES:
        p = p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), h, p))
    if best is None:
        return host, path, None, "allow"
    verdicts = {v for h, p, v in RULES if h == best[2] and (p or "") == best[3]}
    return host, path, best[2] + best[3], "block" if "block" in verdicts else "allow"


def test_matches_brute_force(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "x://EXAMPLE.org", "http://a.b.example.ORG/es/?q", "http://org//",
            "http://x.com?a/fr/", "http://x.com/fr/#b", "a://net/a://net/b", "http://..com/fr/",
            "http://a.org/\U0010ffffx", "http://a.org/\U0010ffff", "http://example.org/es/\U0010ffff\U0010ffff", "http://b.net/\U0010ffff"]
    hosts = ["org", "example.org", "b.example.org", "c.b.example.org", "xorg", "com", "q.com", "net", "z.net", "de"]
    paths = ["", "/", "/es", "/es/", "/es/x/", "/es/x/y", "/es/w", "/fr/", "/fr/1", "/a", "/ab", "/b"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "block", "allow") for i, u in enumerate(urls)],
                                  "page_id long, url string, verdict string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.url_filter(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert uf.url_filter(pages.limit(0), rules).count() == 0
    row = uf.url_filter(pages, rules.limit(0)).first()
    assert (row["rule"], row["verdict"]) == (None, "allow")


def test_query_matches_sql(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    assert compare(E.queries()["op2_url_filter"](spark, sf), duck_connect(sf), E.oracle_sql()["op2_url_filter"])["match"]


def test_no_python_in_the_plan(spark):
    import __spark_entry__ as E

    plan = E.queries()["op2_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
