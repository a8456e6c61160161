"""Unspaced text is read to its end."""

import random

from nightloom.llm import toxicity


def test_pieces_cover_long_runs():
    rng = random.Random(1)
    for n in (1, 39, 40, 41, 45, 46, 75, 76, 200, 5000):
        w = "".join(rng.choice("abcdefghij") for _ in range(n))
        pieces = toxicity.words_of(f"one {w} two")[1:-1]
        assert pieces[0] + "".join(p[toxicity.SHARED :] for p in pieces[1:]) == w and max(map(len, pieces)) <= 40
        assert {w[k : k + 5] for k in range(n - 4)} <= {p[k : k + 5] for p in pieces for k in range(len(p) - 4)}
        assert len(pieces) == 1 or n > 40


def test_late_passage_of_an_unspaced_run_counts():
    rng = random.Random(3)
    make = lambda: "".join(rng.choice(["an", "er", "in", "th", "on", "st"]) for _ in range(rng.randint(1, 4)))
    run = lambda n, at=None: "".join("grolkvumb" * 3 if k == at else make() for k in range(n))
    texts = [run(60, rng.randrange(60)) if k % 3 == 0 else run(60) for k in range(450)]
    net = toxicity.train(texts, [int(k % 3 == 0) for k in range(450)])
    clean = [run(60) for _ in range(20)]
    toxic = [t + "grolkvumb" * 3 for t in clean]
    a, b = toxicity.scores(net, clean, {}), toxicity.scores(net, toxic, {})
    assert all(y > x for x, y in zip(a, b, strict=True))
    assert sum(y >= toxicity.THRESHOLD for y in b) >= 18 and sum(x >= toxicity.THRESHOLD for x in a) <= 2
