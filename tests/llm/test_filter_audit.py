"""Filter audit against filters applied one after another."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from nightloom.llm.filter_audit import LETTERS, WORDS, audit_filters, positional_counts


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search("[#$%&*|]", text) is not None,
    }


def plain(docs, labels):
    rows, firsts = [], {}
    for k, t, _ in docs:
        if k is not None:
            firsts[t or ""] = min(k, firsts.get(t or "", k))
    for k, t, part in docs:
        f = fails(t or "") | {"E": k is not None and firsts[t or ""] < k}
        rows.append((part or "", f, any(a == k and q == 1 for a, q, _ in labels if k is not None), any(a == k and x == 1 for a, _, x in labels if k is not None)))
    out = {}
    for part in {r[0] for r in rows}:
        mine, removed_by = [r for r in rows if r[0] == part], dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                failing = [r for r in mine if r[1][x]]
                removed_by[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def rows_of(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def made(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    d = d.selectExpr("*", "lang part", "text words", "doc_id id", "text digest", "1 quality", "1 toxic", "2 fails", "3 n", "doc_id good")  # names that are used inside
    return audit_filters(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "doc_id id", "quality good", "toxic bad"))


def sample():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Big", "UPPER", "a|b", "50%", "é", "日本"]
    docs = []
    for i in range(160):
        n = rnd.choice([0, 5, 199, 200, 260])
        words = rnd.choices(vocab[: rnd.choice([60, 400, 406])], k=n)
        docs.append((i, rnd.choice([" ", "\n", "\x0b "]).join(words) + rnd.choice(["", " ", "\x85"]), rnd.choice(["en", "de", None, ""])))
    docs += [(1000 + i, docs[i % 7][1], "en") for i in range(60)]  # copies
    docs += [(None, docs[3][1], "en"), (None, None, "fr"), (5, docs[5][1], docs[5][2]), (5, docs[5][1], "de"), (5, "another", "en"), (2000, None, None), (-1, "", "xx")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 170, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (1003, 1, 1)]
    return docs, labels


def test_same_as_filters_in_turn(spark):
    docs, labels = sample()
    assert rows_of(made(spark, docs, labels)) == plain(docs, labels)


def test_long_texts(spark):
    docs = [(1, "word " * 1_000_000, "en"), (2, " " * 3_000_000, "en"), (3, "A" * 4_000_000, "en"), (4, "A" * 4_000_000, "en"), (5, " ".join(map(str, range(700_000))), "en")]
    assert rows_of(made(spark, docs, [(4, 1, 1)])) == plain(docs, [(4, 1, 1)])


@pytest.mark.parametrize("docs", [[], [(None, None, None)], [(1, "x", "en")] * 50])
def test_few_rows(spark, docs):
    assert rows_of(made(spark, docs, [])) == plain(docs, [])


def test_positional_counts():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 1000):
        words = rnd.integers(0, 2**32, n, dtype=np.uint32)
        times = rnd.integers(1, 40, n)
        want = [int(times[(words >> b) & 1 == 1].sum()) for b in range(32)]
        assert positional_counts(words, times).tolist() == want


def test_words():
    for f, word in enumerate(WORDS.tolist()):
        assert [s for s in range(32) if word >> s & 1] == [s for s in range(32) if s & f == 0]
