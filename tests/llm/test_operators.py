"""Each operator against a plain version on small tables, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightloom.llm import licenses, lines, media, mixing, ngram_join, packing, secrets, topk, toxicity, url_filter
from nightloom.llm import queries as Q
from nightloom.llm.common import components, interpreted

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977} x{k}" for k in range(30_000))
ROWS = [
    (1, "a b c d e f g. All rights reserved.", "en", "s1", 5),
    (1, "a b c d e f g. All rights reserved.", "en", "s1", 5),
    (2, None, None, None, None),
    (3, "", "en", "s2", 0),
    (4, " \n\t ", "en", "s2", 4),
    (None, "no id here, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "en", "s1", 1),
    (5, LONG, "en", "s1", len(LONG)),
    (6, "a b c d e f g. All rights reserved.", "en", "s3", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names operators use inside."""
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.withColumns({c: F.lit(7) for c in ("k", "t", "n", "h", "row", "rank", "score", "predicted", "label", "copy", "mix_key", "n_lines", "n_removed", "bad", "__bad", "parts", "id", "doc", "tokens", "node", "part", "kind")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))


EVERY = ids([{"doc_id": r[0]} for r in ROWS])


# ---- 1 n-gram join


def plain_shingles(text):
    """Sets of word tuples by the contract's own words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(d, plain_shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (d, s) in enumerate(sets):
        for e, t in sets[:k]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in parent}


def test_shingles_are_of_the_words():
    assert len(ngram_join.shingle_set("A b\x0bC d E f")) == 2
    assert (ngram_join.shingle_set("A b c") == ngram_join.shingle_set(" a\tB C ")).all()
    assert len(ngram_join.shingle_set("a b c")) == 1 and not len(ngram_join.shingle_set(" \n")) and not len(ngram_join.shingle_set(None))
    assert (ngram_join.shingle_set("É b c d e") != ngram_join.shingle_set("é b c d e")).any()  # only A-Z is lowered


def test_repeated_words_keep_their_places():
    words = ["a", "b", "a", "a", "c", "b", "a", "b", "b", "c", "a", "a", "b", "c", "c"] * 3
    assert len(ngram_join.shingle_set(" ".join(words))) == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    import itertools

    every = [" ".join(p) for p in itertools.product("abc", repeat=5)]
    assert len({int(ngram_join.shingle_set(t)[0]) for t in every}) == len(every)


def test_every_similar_pair_meets():
    """The pigeonhole: random pairs at the threshold share a signature that neither loses, in all sizes."""
    rng = np.random.default_rng(1)
    plan = ngram_join.Plan({k: 10_000 for k in range(40)}, 3000)
    for size in [*range(1, 60), 100, 317, 800, 2000]:
        for _ in range(6):
            s = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
            most = (size + size) * 20 // 180
            drop = int(rng.integers(0, most + 1)) if most else 0
            add = most - drop if most else 0
            t = np.concatenate([s[drop:], rng.integers(0, 2**63, add, dtype=np.int64).astype(np.uint64)])
            both = len(np.intersect1d(s, t))
            if 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = set(plan.signatures(np.unique(s))[0].tolist()), set(plan.signatures(np.unique(t))[0].tolist())
                assert a & b, size


def test_join_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 14, 40, 120, 260]))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 5, 40]) if g else 60):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, " ")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)


def test_near_copies_of_one_text_are_told_apart(spark):
    """Copies of one base edited from hardly to far too much: many lie just under the similarity, and meet all others in common signatures."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for k in range(260):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 5])):
            at = rng.randrange(len(t))
            t[at : at + rng.choice([1, 1, 2])] = [f"e{k}x{rng.randrange(9)}"] if rng.random() < 0.8 else []
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 20 < len(set(want.values())) < 250
    assert all(r["n_shingles"] == len(plain_shingles(texts[r["doc_id"]])) for r in got)


def test_an_id_with_several_texts_is_one_document(spark):
    rng = random.Random(13)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    short, long = make(12), make(120)
    edited = long[:60] + ["other"] + long[61:]
    rows = [(9, " ".join(short)), (9, " ".join(long)), (7, " ".join(edited)), (8, " ".join(short)), (5, " ".join(make(40))), (6, None), (6, " ".join(make(30)))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (6, 6), (6, 6), (7, 7), (8, 7), (9, 7), (9, 7)]


def test_join_of_odd_rows(spark, odd):
    got = ngram_join.near_duplicates(odd).collect()
    assert ids(got) == EVERY
    by = {r["doc_id"]: r for r in got}
    assert by[6]["component_id"] == 1 and by[2]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[None]["component_id"] is None
    assert not ngram_join.near_duplicates(odd.limit(0)).collect()


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r["comp"] for r in components(e, "chain").collect()} == {0, 100}


# ---- 2 lines


def test_lines_equal_sql(spark, docs):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.execute(lines.SQL).fetchall()}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in Q.op2_line_dedup(spark, SF).collect()}
    assert got == want


def test_boilerplate_goes_and_copies_stay(spark):
    rows = [(k, f"unique {k} start\nShare this page!\nunique {k} end", "en", f"site{k % 12}", 0) for k in range(48)]
    rows += [(100 + k, "first line of a copy\nsecond line of a copy\nthird line of a copy", "en", f"site{k % 12}", 0) for k in range(36)]
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_removed"] == (1 if r["doc_id"] < 100 else 0) for r in got)
    assert all("Share" not in r["text"] for r in got)


def test_lines_of_odd_rows(odd):
    got = lines.dedup_lines(odd).collect()
    assert ids(got) == EVERY and {r["doc_id"]: r["text"] for r in got}[2] is None and got[0]["label"] == 7
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got}[1] == (1, 0) and len(got[0]) == len(set(got[0].asDict()))
    assert not lines.dedup_lines(odd.limit(0)).collect()


# ---- 3 toxicity


def test_gradients_are_those_of_the_loss():
    _, v = toxicity.vocabulary([["one", "two", "three", "four"] * 10])
    rng = np.random.default_rng(2)
    net = toxicity.Network(3)
    for p in net.p.values():
        p += (0.3 * rng.standard_normal(p.shape)).astype(np.float32)
    net.p = {k: p.astype(np.float64) for k, p in net.p.items()}
    batch = rng.integers(1, 5, (6, toxicity.WINDOW))
    batch[0, 20:] = 0
    target, weight = np.array([0, 1, 0, 1, 1, 0.0]), np.array([1, 2, 1, 1, 1, 0.5])

    def loss():
        z = net.logits(net.projected(net.inputs(v["buckets"], v["grams"], v["counts"])), batch)
        return float((weight / weight.sum() * (np.logaddexp(0, z) - target * z)).sum())

    grads = net.gradients(v, batch, target, weight)
    for name in ("uf", "wb", "att", "attv", "out", "cf", "word", "gram"):
        g = grads[name]
        rows, g = g if isinstance(g, tuple) else (None, g)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        full = at if rows is None else (rows[at[0]], *at[1:])
        old, h = net.p[name][full], 1e-3
        net.p[name][full] = old + h
        up = loss()
        net.p[name][full] = old - h
        down = loss()
        net.p[name][full] = old
        assert abs((up - down) / (2 * h) - g[at]) < 2e-2 * max(abs(g[at]), 1e-3), name


def test_toxic_words_are_learnt_and_found_anywhere(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice(["an", "er", "in", "th", "on", "st"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(700):
        words = [make() for _ in range(rng.choice([20, 60, 300]))]
        toxic = k % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = "grolk" + make()
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, y).withColumn("held", toxicity.held_out()).collect()
    fold = [r for r in got if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in fold) > 0.95 * len(fold)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert ids(got) == EVERY and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got) and {r["doc_id"]: r["score"] for r in got}[3] == 0
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert not toxicity.score_toxicity(odd.limit(0), labels).collect()


# ---- 4 licences


def test_base_places_equal_brute_force(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(lower))
        at = sorted((k, v) for p, v in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_base"]) == (len(w), len(at))
        assert (x["first_word"], x["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert x["base_labels"] == ",".join(sorted({v for _, v in at}))


def test_templates_need_place_and_key_phrase(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    mixed = " ".join(reversed(mit.split()))
    rows = [(1, f"x y z {mit} more"), (2, mixed), (3, "Licensed under the Apache License, Version 2.0."), (4, None), (5, "CC-BY 4.0 general  PUBLIC license all rights-reserved cc by")]
    rows += [(10 + k, "nothing of the kind here") for k in range(40)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[2]["labels"] == "" and got[3]["labels"] == "apache-2.0"
    assert got[5]["base_labels"] == "cc-by,gpl,reserved" and got[5]["n_base"] == 4 and got[4]["score"] == 0


def test_licences_of_odd_rows(odd):
    got = licenses.scan_licenses(odd).collect()
    assert ids(got) == EVERY and {r["doc_id"]: r["base_labels"] for r in got}[6] == "reserved"
    assert not licenses.scan_licenses(odd.limit(0)).collect()


# ---- 5 packing


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_are_the_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    assert list(np.frombuffer(packing._encoder(None).ids(text), "<u4")) == tokens(text)[:-1]


def test_special_tokens_are_the_tokenizers():
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext>"):
        assert list(np.frombuffer(packing._encoder(None).ids(text), "<u4")) == tokens(text)[:-1]
    assert tokens("a <|endoftext|> b") == [64, 220, 50256, 275, 2]


def checked(rows, want):
    """Pieces are whole, their ids right, sequences gapless and at most 1024 long."""
    pieces = collections.Counter()
    for text in want:
        t = tokens(text)
        start, end, k = 0, len(t) % 1024 or 1024, 0
        while start < len(t):
            pieces[k, start, end - start, zlib.crc32(np.array(t[start:end], "<u4").tobytes())] += 1
            start, end, k = end, end + 1024, k + 1
    assert collections.Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_packing_is_whole_and_tight(docs):
    rows = packing.pack(docs).collect()
    n = checked(rows, [r["text"] for r in docs.collect()])
    assert n <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def test_packing_of_odd_rows(odd):
    checked(packing.pack(odd).collect(), [r[1] for r in ROWS])
    assert not packing.pack(odd.limit(0)).collect()


def test_rounds_are_no_worse_than_best_fit_one_by_one(spark):
    rng = random.Random(8)
    cases = [collections.Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 20)]) for _ in range(400)), collections.Counter({1: 3000, 40: 7, 64: 2}), collections.Counter({33: 9, 32: 5})]
    for sizes in cases:
        gaps = []
        for length in sorted(sizes.elements(), reverse=True):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(64 - length)
        flows = packing.best_fit_rounds(spark.createDataFrame(list(sizes.items()), "length long, n long"), 64).collect()
        placed, filled = collections.Counter(), collections.defaultdict(list)
        for r in flows:
            for k in range(r["n"] * r["f"]):
                placed[r["length"], r["first"] + k] += 1
                filled[r["sequence"] + k // r["f"]].append((r["offset"] + k % r["f"] * r["length"], r["length"]))
        assert placed == collections.Counter((s, k) for s, n in sizes.items() for k in range(n))
        for parts in filled.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 64
        assert len(filled) <= len(gaps) + max(1, len(gaps) // 50)


def test_rounds_fill_narrow_gaps_too(spark, monkeypatch):
    sizes = {107: 177, 16: 2, 17: 40, 18: 2, 19: 200, 20: 2, 21: 1000, 22: 200, 23: 2, 24: 3000, 25: 1000, 26: 1, 27: 1, 28: 3000, 29: 1, 30: 3000, 31: 40}
    rounds, opened = [], packing._opened
    monkeypatch.setattr(packing, "_opened", lambda *a: rounds.append(opened(*a)) or rounds[-1])
    with interpreted(spark):
        flows = packing.best_fit_rounds(spark.createDataFrame(list(sizes.items()), "length long, n long").coalesce(1), 128)
    assert flows.agg(F.sum(F.col("n") * F.col("f"))).first()[0] == sum(sizes.values())
    assert len(rounds) <= 15 and rounds[-1][1] <= 2710  # 2511 would hold the tokens


def test_many_rounds_are_no_error(spark, monkeypatch):
    turns, opened = [], packing._opened

    def late(*a):
        turns.append(1)
        state, n, waiting = opened(*a)
        return state, n, waiting or len(turns) < 68

    monkeypatch.setattr(packing, "_opened", late)
    with interpreted(spark):
        flows = packing.best_fit_rounds(spark.createDataFrame([(5, 30), (64, 2)], "length long, n long").coalesce(1), 64)
    assert flows.agg(F.sum(F.col("n") * F.col("f"))).first()[0] == 32


# ---- 6 urls


def test_rules_hosts_and_paths(spark):
    urls = ["http://a.COM/x", "https://www.example.com/en/1", "https://m.example.com/en/1", "http://b.net/es/", "http://b.net/esx", "nothing", None, "http://c.org", "HTTP://D.NET?x=/es/", "http://xcom/", "http://e.com#top"]
    p = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(p).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == ("net/es/", "block") and got[4][2] is None and got[5] == got[6] == ("", "", None, "allow") and got[7] == ("c.org", "", None, "allow")
    assert got[8][:3] == ("d.net", "", None) and got[9][2] is None and got[10] == ("e.com", "", None, "allow")


def test_distrust_runs_against_links(spark):
    page = lambda k, url, *links: (k, url, "".join(f'<a href="http://{h}/">' for h in links))
    rows = [page(1, "http://bad.net/es/1"), page(2, "http://feeds.org/", "bad.net"), page(3, "http://good.com/", "liked.org"), page(4, "http://liked.org/"), page(5, "http://alone.org/")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2]["verdict"] == "block" and got[2]["distrust"] > 0 and got[4]["verdict"] == "allow" and got[4]["trust"] > 0 and got[5]["verdict"] == "allow"
    assert not url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect()


# ---- 7 mixing


def test_counts_are_poisson_inverses(spark):
    rows = [(k, "s1" if k < 3000 else "s2") for k in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix_sources(d).collect()
    n = collections.Counter(r["doc_id"] for r in got)
    rate = {"s1": 4000 / 2 / 3000, "s2": 4000 / 2 / 1000}
    for k, s in rows:
        u = (int(hashlib.md5(f"count7:{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        p = cum = np.exp(-rate[s])
        count = 0
        while u >= cum:
            count += 1
            p *= rate[s] / count
            cum += p
        assert n[k] == count
    share = sum(r["source"] == "s2" for r in got) / len(got)
    assert abs(share - 0.5) < 0.04 and [r["mix_key"] for r in got] == sorted(r["mix_key"] for r in got)


def test_mixing_of_odd_rows(odd):
    got = mixing.mix_sources(odd, targets={"s1": 1.0}).collect()
    assert {r["source"] for r in got} <= {"s1"} and got[0]["label"] == 7 and got[0]["text"] and isinstance(got[0]["mix_key"], float)
    assert len(got[0]) == len(set(got[0].asDict())) and all(r["copy"] < 7 for r in got)
    assert not mixing.mix_sources(odd.limit(0)).collect()


# ---- 8 secrets


def test_secrets_are_told_from_numbers(docs):
    got = secrets.scan_secrets(docs).collect()
    plain = [(r["doc_id"], c) for r in docs.collect() for c in re.findall(r"[Tt][Oo][Kk][Ee][Nn] = \"([0-9a-fA-F]{40})", r["text"] or "")]
    assert {(r["doc_id"], r["candidate"]) for r in got if r["is_secret"]} >= set(plain)
    assert not any(r["is_secret"] and r["candidate"].isdigit() for r in got)


def test_forest_learns_from_given_findings(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    d = spark.createDataFrame([(k, f"the password = \"{key()}\" and commit {key()} done") for k in range(60)], "doc_id long, text string").withColumn("source", F.lit("app"))
    found = secrets.candidates(d)
    labelled = found.withColumn("label", F.col("assigned"))
    got = secrets.scan_secrets(d, labelled).collect()
    assert len(got) == 120 and all(r["is_secret"] == (r["word"] == 3) for r in got)


def test_secrets_of_odd_rows(odd):
    got = secrets.scan_secrets(odd).collect()
    assert {r["doc_id"] for r in got} == {None} and not secrets.scan_secrets(odd.limit(0)).collect()


# ---- 9 media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000))
def test_media_keeps_every_byte(data):
    payload = data + b"\x00" * (max(64, -(-len(data) // 64) * 64) - len(data))
    assert media.read_media(media.write_avi(payload))[0] == payload


def test_foreign_huffman_codes_decode():
    """A frame of one block with the tables of another writer: DC 5, then a run of two zeros before -3, end of block."""
    table = media._huffman_table(0x00, {2: [0, 3]}) + media._huffman_table(0x10, {2: [0x00, 0x22]})
    head = b"\xff\xd8" + media._segment(0xDB, b"\x00" + bytes([2] * 64)) + media._segment(0xC0, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + table
    bits = "01" + "101" + "01" + "00" + "00"
    scan = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    coeffs, quant = media.decode_jpeg(head + media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9")
    assert coeffs[0, :5].tolist() == [5, 0, 0, -3, 0] and quant[0] == 2


def test_shots_are_cut_where_histograms_jump():
    calm, other = np.tile([100, 0, 28, 0], (10, 1)), np.tile([0, 90, 0, 38], (8, 1))
    assert media.shots(np.concatenate([calm, other])) == [(0, 10), (10, 18)] and media.shots(calm) == [(0, 10)]


def test_media_of_odd_rows(odd):
    got = media.media_digest(media.media_columns(odd)).collect()
    assert ids(got) == EVERY
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"]) or ""
        n, payload = media.padded(text)
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = media.media_columns(odd)
    broken = stored.withColumn("media", F.when(F.col("doc_id") == 6, F.lit(b"RIFF not a film")).when(F.col("doc_id") == 5, F.expr("substring(media, 1, 5000)")).when(F.col("doc_id").isNotNull(), F.col("media")))
    told = {r["doc_id"]: r for r in media.media_digest(broken).collect()}
    assert told[6]["feature"] == "unreadable" and told[6]["payload_sha256"] is None and told[6]["media_bytes"] == 15 and told[None]["feature"] is None and told[1]["payload_bytes"] == 64
    assert {r["doc_id"] for r in media.clip_rows(broken).collect()} <= {1, 2, 3, 4, 5}
    clips = media.clip_rows(media.media_columns(odd)).collect()
    assert all(c["end_s"] > c["start_s"] for c in clips) and not media.media_columns(odd.limit(0)).collect()


# ---- 10 top-k


def brute_top(vectors, every, k):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return {(q, n + 1, i, s) for q, v in usable if q % every == 0 for n, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q), key=lambda x: (-x[0], x[1]))[:k])}


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (rng.standard_normal(12) / 4).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(8)]  # ties
    rows += [(400, None), (450, [None] * 12), (500, [float("nan")] * 12), (550, [float("inf")] + [0.0] * 11), (600, [1e3] * 12), (650, [0.0] * 12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "score", "rank")}).repartition(3)
    got = {tuple(r) for r in topk.top_inner_products(d, block=3).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, 50, 5)
    huge = [(0, [1e18, -3.0]), (50, [1e30, 1.0]), (51, [-1e18, 2.0]), (52, [3.0, 4.0])]
    top = topk.top_inner_products(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    whole = {i: [max(-(2**62), min(2**62, int(256 * x))) for x in v] for i, v in huge}
    clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    want = {(q, n + 1, i, s) for q in (0, 50) for n, (s, i) in enumerate(sorted(((clip(sum(a * b for a, b in zip(whole[q], w, strict=True))), i) for i, w in whole.items() if i != q), key=lambda x: (-x[0], x[1])))}
    assert {tuple(r) for r in top} == want
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk.top_inner_products(few).count() == 2 and not topk.top_inner_products(few.limit(0)).collect()


def test_pivots_spare_most_candidates_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 12)) * 8
    rows = [(k, (centres[k % 40] + rng.standard_normal(12) / 8).tolist()) for k in range(2000)]
    seen = spark.sparkContext.accumulator(0)
    got = topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), evaluated=seen).collect()
    usable = np.floor(256 * np.array([v for _, v in rows]))
    scores = usable[::50] @ usable.T
    scores[np.arange(40), np.arange(0, 2000, 50)] = -np.inf
    want = {(50 * q, n + 1, int(i), int(scores[q, i])) for q in range(40) for n, i in enumerate(np.lexsort((np.arange(2000), -scores[q]))[:5])}
    assert {tuple(r) for r in got} == want and seen.value < 0.5 * 40 * 2000


# ---- pipeline


def test_stages_of_odd_rows(spark, odd):
    import corpus_pipeline as C

    for name, stage in C.STAGES:
        got, none = stage(spark, odd, SF), stage(spark, odd.limit(0), SF).collect()
        assert not none
        if name == "best_fit_packing":
            checked(got.collect(), [r[1] for r in ROWS])
            continue
        assert got.columns == C.COLUMNS
        want = [(r[0], r[1]) for r in ROWS]
        if name == "ngram_jaccard":  # 1 and 6 are copies, 1 stands there twice
            want = [x for k, x in enumerate(want) if k not in (1, 7)]
        if name in ("toxicity", "line_dedup", "ngram_jaccard"):
            assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr), name
        else:
            assert {(r["doc_id"], r["text"]) for r in got.collect()} <= set(want)


def test_stages_take_effect(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in C.STAGES:
        from nightloom.llm.common import saved

        out = saved(stage(spark, docs, SF), name)
        if name != C.STAGES[-1][0]:
            assert out.columns == C.COLUMNS
        seen.append((name, docs, out))
        docs = out
    by = {n: (a, b) for n, a, b in seen}
    a, b = by["ngram_jaccard"]
    want = brute_components([(r["doc_id"], r["text"]) for r in a.collect()])
    assert ids(b.collect()) == sorted(set(want.values()))
    assert by["toxicity"][1].count() < by["toxicity"][0].count()
    assert by["line_dedup"][1].count() == by["line_dedup"][0].count()
    checked(by["best_fit_packing"][1].collect(), [r["text"] for r in by["best_fit_packing"][0].collect()])
    assert json.dumps([n for n, _ in C.STAGES])
