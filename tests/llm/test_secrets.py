"""Every run of a word is a candidate."""

import json
import random
import re

from nightloom.llm import secrets


def test_minified_text_gives_each_secret(spark):
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    keys = [key() for _ in range(4)]
    one = json.dumps({"authorization_token": keys[0], "numbers": [1, 2, 3], "database_password": keys[1], "client_secret": keys[2]}, separators=(",", ":"))
    rows = [(1, one), (2, f"see https://a-host-with-a-long-name.example.org/path?token:{keys[3]}&x"), (3, ",".join([keys[0]] * 3)), (4, "no-digit-in-this-long-run-at-all")]
    rows += [(10 + k, f"the password = \"{key()}\" and blob {key()} done") for k in range(40)]
    found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'app' AS source")).collect()
    by = {d: sorted((r["run"], r["candidate"]) for r in found if r["doc_id"] == d) for d, _ in rows}
    assert by[1] == [(1, keys[0]), (3, keys[1]), (4, keys[2])] and [c for _, c in by[2]] == [keys[3]]
    assert by[3] == [(k, keys[0]) for k in range(3)] and not by[4] and all(len(by[10 + k]) == 2 for k in range(40))
    assert all(r["is_secret"] for r in found if r["doc_id"] == 1)


def test_candidates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r["doc_id"], r["candidate"]) for r in secrets.candidates(docs).select("doc_id", "candidate").collect())
    want = sorted((r["doc_id"], c) for r in docs.collect() for w in re.split(r"[ \t\n\x0b\f\r]+", r["text"] or "") if len(w) >= 16 for c in re.findall(r"[A-Za-z0-9+/_=-]{16,}", w) if re.search("[0-9]", c))
    assert got == want and want


def test_held_out_findings_are_told(spark):
    """Precision and recall on planted findings whose texts the forest hasn't seen; the labels say what was planted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secrets.planted_findings(docs, dictionary=secrets.corpus_dictionary(docs)).cache()
    model = secrets.train_forest(found.where("fold > 0"))
    rows = model.transform(found.where("fold = 0")).select("label", "prediction", "kind").collect()
    right = sum(r["label"] == 1 and r["prediction"] == 1 for r in rows)
    precision, recall = right / sum(r["prediction"] == 1 for r in rows), right / sum(r["label"] == 1 for r in rows)
    print("held-out findings", len(rows), "precision", round(precision, 3), "recall", round(recall, 3))
    assert len(rows) > 500 and len({r["kind"] for r in rows}) >= 17 and precision >= 0.9 and recall >= 0.9
