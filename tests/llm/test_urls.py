from opsweave.llm import urls

PAGES = "page_id long, url string, html string, host int, bound string"


def judged(spark, pages, labels=()):
    df = spark.createDataFrame([(i, u, None, 1, "x") for i, u in pages], PAGES)
    lab = spark.createDataFrame([(i, g, 1) for i, g in labels], "id long, good int, host int")
    return {r["page_id"]: r for r in urls.judge(df, lab).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://Ex.EXAMPLE.com/en/7x?q#f": ("ex.example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://a.com/en/": ("a.com", "/en/", "com/en/", "block"), "https://a.com/en": ("a.com", "/en", None, "allow"),
        "x://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "x://notexample.net/de/81": ("notexample.net", "/de/81", "net/de/", "allow"),
        "s://com/en/9": ("com", "/en/9", "com/en/", "block"), "s://org?/es/": ("org", "", None, "allow"),
        "s://ÄB.org/es/": ("Äb.org", "/es/", "org/es/", "block"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"), "://h#x": ("h", "", None, "allow"), None: ("", "", None, "allow"),
    }
    got = judged(spark, list(enumerate(cases)))
    for i, want in enumerate(cases.values()):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == want


def test_rules_are_those_of_the_contract(spark):
    assert set(urls.RULES) == {
        ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
    }
    pages = [(k, f"http://bad.net/{'de' if k < 40 else 'fr'}/{k}") for k in range(80)]
    got = judged(spark, pages, [(k, 0) for k, _ in pages])  # a host of bad repute: the rule still allows its part
    assert {r["verdict"] for k, r in got.items() if k < 40} == {"allow"} and {r["verdict"] for k, r in got.items() if k >= 40} == {"block"}


def test_reputation_shrinks_to_domain_and_suffix(spark):
    pages, labels, n = [], [], 0
    for host, good, bad in [("bad.x.com", 4, 40), ("few.w.com", 0, 1), ("good.y.com", 50, 12), ("b.z.org", 8, 42), ("c.z.org", 6, 39), ("ok.org", 60, 10), ("mid.v.com", 30, 30)]:
        for k in range(good + bad):
            pages.append((n, f"http://{host}/p{k}"))
            labels.append((n, 1 if k < good else 0))
            n += 1
    pages += [(9001, "http://new.z.org/"), (9002, "http://new.y.com/")]
    got = judged(spark, pages, labels)
    verdict = {r["host"]: r["verdict"] for r in got.values()}
    assert verdict["bad.x.com"] == verdict["b.z.org"] == "block" and verdict["good.y.com"] == verdict["ok.org"] == "allow"
    bound = {r["host"]: r["bound"] for r in got.values()}
    assert bound["few.w.com"] > bound["bad.x.com"]  # one bad page proves less than forty
    assert bound["new.z.org"] < bound["new.y.com"] and got[9001]["n_labels"] == 0


def test_edges(spark):
    assert judged(spark, []) == {}
    got = judged(spark, [(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://a.com/")], [(1, None), (1, 0), (None, 1)])
    assert set(got) == {1, None}
    hosts = ["a.b.co.uk", "co.uk", "uk", "h:80", "1.2.3.4"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    d, s = urls.domain_and_suffix(df["h"])
    assert [tuple(r) for r in df.select(d, s).collect()] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("h", "h"), ("3.4", "4")]


def test_no_pages(spark):
    assert judged(spark, []) == {} and judged(spark, [], [(1, 1), (2, 0), (None, 1)]) == {}
