import random

from tidewatch.llm import link_graph

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def brute(seeds, edges, rounds=link_graph.ROUNDS):
    total = sum(seeds.values()) or 1
    start = {h: w * link_graph.UNIT // total for h, w in seeds.items() if w}
    out = {}
    for (a, _), w in edges.items():
        out[a] = out.get(a, 0) + w
    mass = dict(start)
    for _ in range(rounds):
        new = {h: s * (100 - link_graph.FOLLOW) // 100 for h, s in start.items()}
        for (a, b), w in edges.items():
            if a in mass:
                new[b] = new.get(b, 0) + mass[a] * link_graph.FOLLOW * w // (100 * out[a])
        mass = new
    return mass


def test_propagation_equals_a_plain_loop(spark):
    rng = random.Random(3)
    hosts = ["h%d" % i for i in range(25)]
    edges = {(a, b): rng.randint(1, 9) for a in hosts for b in rng.sample(hosts, 3) if a != b}
    seeds = {h: rng.choice([0, 0, 1, 7]) for h in hosts}
    got = link_graph.propagate(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight long"),
                               spark.createDataFrame(list(seeds.items()), "host string, weight long"))
    assert {r.host: r.mass for r in got.collect() if r.mass} == {h: m for h, m in brute(seeds, edges).items() if m}


def test_verdicts(spark):
    link = '<a href="%s">x</a>'
    rows = [(1, "https://WWW.Example.com/en/a?x#y", ""), (2, "http://blog.example.com/en/", ""), (3, "http://a.net/es/1", link % "http://b.org/x"),
            (4, "http://b.org/y", (link % "//a.net/es/1") * 3), (5, "http://c.org/", link % "https://shop.com/"), (6, "http://shop.com/z", link % "http://c.org"),
            (7, None, None), (8, "no scheme", ""), (9, "x://", None), (9, "x://", None), (10, "http://com/", ""), (11, "http://d.org?q=/en/", ""), (12, "http://a.net/en/", None)]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in link_graph.judged(pages, RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    assert (got[3].rule, got[3].verdict) == ("net/es/", "block")
    # it links to a blocked host: distrust flows back along the link
    assert got[4].rule is None and got[4].distrust > got[4].trust and got[4].verdict == "block"
    assert got[5].rule is None and got[5].verdict == "allow" and got[5].trust > 0
    for i in (7, 8, 9):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow")
    assert (got[11].host, got[11].path) == ("d.org", "") and got[10].verdict == "allow"
    assert got[12].verdict == "block"
    assert link_graph.judged(pages, RULES).count() == len(rows)
    assert link_graph.judged(pages.limit(0), RULES).count() == 0
