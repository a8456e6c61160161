"""Trust and distrust reach every host and settle."""

import numpy as np

from nightloom.llm import url_filter


def settled(edges, seeds, damping=0.85):
    """The fixed point by linear algebra, mass without outgoing edges going to the seeds; scores sum to the number of seeds."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    base = np.array([(h in seeds) / len(seeds) for h in hosts])
    move = np.zeros((len(hosts), len(hosts)))
    for s, d in edges:
        move[at[d], at[s]] = 1 / sum(e[0] == s for e in edges)
    for h in hosts:
        if all(e[0] != h for e in edges):
            move[:, at[h]] = base
    x = np.linalg.solve(np.eye(len(hosts)) - damping * move, (1 - damping) * base)
    assert abs(x.sum() - 1) < 1e-9
    return {h: x[at[h]] * len(seeds) for h in hosts if x[at[h]] > 0}


def test_scores_are_the_fixed_point(spark):
    edges = [(f"h{k}", f"h{k + 1}") for k in range(14)] + [("s", "h0"), ("s", "end"), ("h3", "s"), ("t", "end"), ("far", "t")]
    starts = {"one": ["s", "t"], "other": ["end"]}
    e = spark.createDataFrame([(k, *x, 2.0) for k in starts for x in edges], "kind string, src string, dst string, weight double")
    s = spark.createDataFrame([(k, h) for k, seeds in starts.items() for h in seeds], "kind string, host string")
    got = {(r["kind"], r["host"]): r["score"] for r in url_filter.spread(e, s, 0.85, 1e-7, "t").collect()}
    want = {(k, h): x for k, seeds in starts.items() for h, x in settled(edges, seeds).items()}
    assert set(got) == set(want) and all(abs(got[h] - want[h]) < 1e-5 * want[h] for h in want)


def test_distrust_runs_down_a_long_chain(spark):
    page = lambda k, url, *links: (k, url, "".join(f'<a href="http://{h}/">' for h in links))
    rows = [page(0, "http://bad.net/es/1")] + [page(k, f"http://c{k}.org/", f"c{k - 1}.org" if k > 1 else "bad.net") for k in range(1, 15)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k]["verdict"] == "block" and got[k]["distrust"] > 0 for k in range(15))


def test_links_without_a_scheme_count_more_than_the_domain(spark):
    rows = [(1, "http://a.shop.net/x", "<a href='//good.org/'>"), (2, "http://www.example.com/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", url_filter.host_of("url"))
    got = {(r["src"], r["dst"]): r["weight"] for r in url_filter.host_edges(pages).collect()}
    assert got == {("a.shop.net", "good.org"): 1.0, ("a.shop.net", "shop.net"): 0.25, ("shop.net", "a.shop.net"): 0.25, ("www.example.com", "example.com"): 0.25, ("example.com", "www.example.com"): 0.25}
