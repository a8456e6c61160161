"""Licence scans against brute force over all templates and all places."""

import random
import re

from nightloom.llm import licenses


def brute_labels(text, cover=0.8):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    out = {v for p, v in licenses.BASE.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))}
    for label, template, phrase in licenses.TEMPLATES:
        t, p = template.split(), phrase.split()
        at = next(k for k in range(len(t)) if t[k : k + len(p)] == p)
        for s in range(-len(t), len(w)):
            there = [0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(t)]
            if all(there[at : at + len(p)]) and sum(there) / len(t) >= cover:
                out.add(label)
    return ",".join(sorted(out))


def test_labels_do_not_hang_on_frequency_or_company(spark):
    """A licence in a third of the files, files with several or all licences, damaged ones, and plain files with licence words."""
    rng = random.Random(6)
    every = [t for _, t, _ in licenses.TEMPLATES]
    common = sorted({w for t in every for w in t.split()})
    texts = ["Licensed under the Apache License, Version 2.0"] * 40
    texts += [" / ".join([every[1], every[6], every[0]]), " . ".join(every), " . ".join(reversed(every)), "version 2 0 apache license"]
    for _ in range(80):
        parts = []
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            t = rng.choice(every).split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                t[rng.randrange(len(t))] = "x"
            parts.append(" ".join(t))
        texts.append(" ".join([*parts, *rng.choices(common, k=rng.choice([0, 30]))]))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: brute_labels(t) for k, t in rows}
    assert got[0] == "apache-2.0" and {"apache-2.0", "bsd", "mit"} <= set(got[40].split(","))
    assert set(got[41].split(",")) >= {label for label, _, _ in licenses.TEMPLATES}
