"""Families of texts that share half their words in several ways: whole classes, and pairs that don't grow with the square of the texts."""

import random

import numpy as np
import pytest

from nightloom.llm import ngram_join


def family(texts: int, passages: int, length: int, own: int, seed: int, few: int = 2):
    """Texts of 200 words that all share, `few` of some passages, and words of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    base, parts = [word() for _ in range(200)], [[word() for _ in range(length)] for _ in range(passages)]
    return [(k, " ".join(base + sum((parts[p] for p in sorted(rng.sample(range(passages), few))), []) + [word() for _ in range(own)])) for k in range(texts)]


def brute(rows):
    """Smallest id reachable, from a matrix of memberships."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    at = {s: k for k, s in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(at)), np.float32)
    for k, s in enumerate(sets):
        m[k, [at[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= 80 * (n[:, None] + n - both)
    comp = np.arange(len(sets))
    while True:
        new = np.where(linked, comp[None, :], len(sets)).min(1)
        if (new == comp).all():
            return {rows[k][0]: rows[c][0] for k, c in enumerate(comp)}
        comp = new


@pytest.fixture
def measured(monkeypatch):
    """Numbers of pairs that were measured."""
    counts, plain = [], ngram_join._measured

    def counted(pairs, nodes, name):
        out = plain(pairs, nodes, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_measured", counted)
    return counts


def test_pairs_of_a_family_follow_its_parts(spark, measured):
    found = []
    for texts in (200, 400):
        measured.clear()
        rows = family(texts, 12, 22, 4, 5)
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)
        found.append(sum(measured))
    # Some hubs a text, and different parts with each other; listing pairs of texts would take 79800, four times those of half as many.
    assert found[1] < 79800 / 10 and found[1] < 2.2 * found[0] + 500, found


@pytest.mark.parametrize("length, own, few, seed", [(9, 9, 2, 1), (14, 16, 3, 2), (12, 1, 1, 3), (6, 22, 3, 4)])
def test_families_about_the_similarity_are_whole(spark, length, own, few, seed):
    rows = family(160, 6, length, own, seed, few)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)


def shuffled(spark):
    """Bytes of shuffle written so far."""
    gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_links_are_not_shuffled(spark, monkeypatch):
    rng, plain, dropped, kept = random.Random(7), ngram_join.saved, ngram_join.dropped, {}

    def saved(df, name):
        out = plain(df, name)
        kept[out.saved_at] = name
        if name == "texts":
            assert "scanned" not in kept.values()  # tokens go as soon as they are counted
        return out

    monkeypatch.setattr(ngram_join, "saved", saved)
    monkeypatch.setattr(ngram_join, "dropped", lambda *tables: (dropped(*tables), [kept.pop(t.saved_at, None) for t in tables]))
    word = lambda: f"{rng.randrange(16**12):x}"
    rows = [(k, " ".join(word() for _ in range(600))) for k in range(400)]
    rows += [(1000 + k, f"{rows[k][1]} {word()}") for k in range(12)]
    before = shuffled(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {k: k % 1000 for k, _ in rows}
    assert shuffled(spark) - before < 0.6 * sum(len(t) for _, t in rows)


def test_rows_of_ids_are_found_beyond_the_bitmaps(spark, monkeypatch):
    docs = spark.createDataFrame([(None if k == 7 else k // 2, str(k)) for k in range(5000)], "doc_id long, text string")
    ids = spark.range(0, 2500, 3).selectExpr("id - 30 doc_id")
    want = sorted(str(k) for k in range(5000) if k != 7 and k // 2 % 3 == 0 and k // 2 < 2470)
    for slots in (64, 1 << 27):
        monkeypatch.setattr(ngram_join, "_WORD", 64)
        monkeypatch.setattr(ngram_join, "SLOTS", slots)
        assert sorted(r["text"] for r in ngram_join._of_ids(docs, ids).collect()) == want
