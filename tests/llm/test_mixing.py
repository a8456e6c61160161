"""Tiny sources reach their targets."""

import collections

from nightloom.llm import mixing


def test_tiny_sources_reach_their_share(spark):
    """Two documents against 4000: a mean of 1000.5 each, drawn in parts."""
    rows = [(k, "tiny" if k < 2 else "hot") for k in range(4002)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix_sources(d, shuffle=False).select("doc_id", "source", "copy").collect()
    n = collections.Counter(r["source"] for r in got)
    assert abs(n["tiny"] - 2001) < 5 * 2001**0.5 and abs(n["hot"] - 2001) < 5 * 2001**0.5
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    each = collections.Counter(r["doc_id"] for r in got if r["source"] == "tiny")
    assert len(each) == 2 and each[0] != each[1] and all(abs(c - 1000.5) < 5 * 1000.5**0.5 for c in each.values())
    named = mixing.mix_sources(d, targets={"tiny": 3.0, "hot": 1.0}, size=0.5, shuffle=False).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in named}
    assert abs(n["tiny"] - 1500.75) < 5 * 1500.75**0.5 and abs(n["hot"] - 500.25) < 5 * 500.25**0.5
