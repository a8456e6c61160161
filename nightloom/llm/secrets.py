"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of 16 or more token characters with a digit; a word (minified text is one) may hold many. Its features:
length, transitions between character classes and within letters, entropy, how much of its letters are words of a dictionary counted over the corpus, whether
its path (here the source) and what stands beside it speak of keys, of tests or of other data: the words beside, and inside
a word with several runs the text up to the runs beside. A random forest trained on labelled findings scores it. Where no labelled findings are given, they are
planted: keys of known kinds and look-alikes of other kinds, made from hashes, stand among words of the corpus, and the label is what was planted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import saved

SHAPE = r"[A-Za-z0-9+/_=-]{16,}"

# Words beside or in front of a secret, and words of examples.
KEY_WORDS = ["token", "secret", "password", "passwd", "apikey", "api_key", "key", "auth", "credential", "bearer"]
TEST_WORDS = ["test", "example", "sample", "dummy", "fake", "mock", "placeholder", "hash", "checksum", "commit", "sha"]

BESIDE = 40  # characters of a word that count as beside a run inside it

FEATURES = ["length", "class_changes", "letter_runs", "distinct_share", "entropy", "digit_share", "hex_only", "upper_share", "dictionary", "key_path", "test_path", "key_before", "key_near", "assigned", "quoted", "test_near"]


def corpus_dictionary(docs: DataFrame, most: int = 400, least: int = 4) -> list[str]:
    """The `most` words of `least` or more ASCII letters that most texts have (the bound), over all texts."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z\u0080-\uffff]+", -1))
    counts = docs.select(F.explode(F.filter(words, lambda w: w.rlike(f"^[a-z]{{{least},24}}$"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()]


def candidates(docs: DataFrame, path: str = "source", dictionary: list[str] | None = None) -> DataFrame:
    """doc_id, word (place among white-space words, from 0), run (place among the word's runs of SHAPE, from 0), candidate, and FEATURES."""
    words = F.split(F.coalesce("text", F.lit("")), r"\s+", -1)
    d = docs.select("doc_id", F.lower(F.coalesce(F.col(path).cast("string"), F.lit(""))).alias("path"), words.alias("w"))
    # Runs and the gaps before, between and after them, once for each word.
    long = F.transform("w", lambda w, i: F.when(F.length(w) >= 16, F.struct(i.alias("i"), F.regexp_extract_all(w, F.lit(SHAPE), F.lit(0)).alias("runs"), F.split(w, SHAPE, -1).alias("gaps"))))
    long = F.filter(long, lambda x: F.exists(x["runs"], lambda c: c.rlike("[0-9]")))

    def run(x, c, k):
        word = lambda n: F.lower(F.coalesce(F.get("w", x["i"] + n), F.lit("")))
        left = F.concat(F.coalesce(F.get(x["runs"], k - 1), F.lit("")), F.get(x["gaps"], k))
        right = F.get(x["gaps"], k + 1)
        inner, last = k > 0, k + 1 == F.size(x["runs"])
        return F.struct(
            x["i"].cast("long").alias("word"),
            k.alias("run"),
            c.alias("candidate"),
            F.concat(left, c, right).alias("whole"),
            F.when(inner, F.lower(F.substring(left, -BESIDE, BESIDE))).otherwise(word(-1)).alias("b1"),
            F.when(inner, F.lit("")).otherwise(word(-2)).alias("b2"),
            F.when(last, word(1)).otherwise(F.lower(F.substring(right, 1, BESIDE))).alias("a1"),
            inner.alias("inner"),
        )

    runs = F.flatten(F.transform(long, lambda x: F.filter(F.transform(x["runs"], lambda c, k: run(x, c, k)), lambda r: r["candidate"].rlike("[0-9]"))))
    d = d.select("doc_id", "path", F.explode(runs).alias("x")).select("doc_id", "path", "x.*")
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    kinds = F.translate(F.translate(F.translate(c, "abcdefghijklmnopqrstuvwxyz", "a" * 26), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26), "0123456789", "0" * 10)
    changes = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(kinds, "a+", "a"), "A+", "A"), "0+", "0")) - 1
    chars = F.split(c, "")
    each = F.filter(F.array_distinct(chars), lambda x: x != "")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    entropy = F.reduce(each, F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x)))
    low = F.lower(c)
    named = sorted({*KEY_WORDS, *TEST_WORDS, *(dictionary or [])}, key=lambda w: (-len(w), w))
    covered = n - F.length(F.regexp_replace(low, "|".join(named), ""))
    has = lambda col, words: F.when(col.rlike("(" + "|".join(words) + ")"), 1.0).otherwise(0.0)
    beside = F.concat_ws(" ", "b2", "b1", "a1")
    return d.select(
        "doc_id",
        "word",
        "run",
        "candidate",
        n.alias("length"),
        (changes / n).alias("class_changes"),
        (F.length(F.regexp_replace(low, "[^a-z]+", "")) / F.greatest(F.lit(1), F.size(F.split(low, "[^a-z]+")))).alias("letter_runs"),
        (F.size(each) / n).alias("distinct_share"),
        entropy.alias("entropy"),
        (F.length(F.regexp_replace(c, "[^0-9]+", "")) / n).alias("digit_share"),
        F.when(c.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 1.0).otherwise(0.0).alias("hex_only"),
        (F.length(F.regexp_replace(c, "[^A-Z]+", "")) / n).alias("upper_share"),
        (covered / n).alias("dictionary"),
        has(F.col("path"), KEY_WORDS).alias("key_path"),
        has(F.col("path"), TEST_WORDS).alias("test_path"),
        has(F.concat_ws(" ", "b2", "b1"), KEY_WORDS).alias("key_before"),
        has(F.concat_ws(" ", beside, "whole"), KEY_WORDS).alias("key_near"),
        F.when(F.when(F.col("inner"), F.col("b1").rlike("[=:]['\"]?$")).otherwise(F.col("b1").rlike("[=:]") | F.col("whole").rlike("^[^=:]*[A-Za-z_]['\"]?[=:]")), 1.0).otherwise(0.0).alias("assigned"),
        F.when(F.col("whole").rlike("['\"]"), 1.0).otherwise(0.0).alias("quoted"),
        has(beside, TEST_WORDS).alias("test_near"),
    )


def _pools(seed):
    """Snippets of a planted row by kind, (label, text before, core, text after), from a hash that differs by row."""
    h = lambda k, bits=256: F.sha2(F.concat_ws(":", F.lit(k), seed), bits)
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(h(k, 512))), "[+/=]", "")
    upper = lambda k: F.translate(F.upper(h(k)), "0123456789ABCDEF", "Q7ZK2MXB5WNRT4YD")
    digits = lambda k, n: F.translate(F.substring(h(k), 1, n), "abcdef", "274519")
    words = lambda *k: F.concat_ws("-", *[F.element_at(F.array(*[F.lit(w) for w in ("blue", "river", "annual", "report", "market", "review", "garden", "winter")]), (F.pmod(F.crc32(h(x).cast("binary")), F.lit(8)) + 1).cast("int")) for x in k])
    keys = [
        ("token = \"", F.substring(h("a"), 1, 40), "\""),
        ("TOKEN = \"", F.upper(F.substring(h("b"), 1, 40)), "\""),
        ("api_key: ", F.substring(mixed("c"), 1, 32), ""),
        ("aws_access_key_id=", F.concat(F.lit("AKIA"), F.substring(upper("d"), 1, 16)), ""),
        ("password='", F.substring(mixed("e"), 1, 20), "'"),
        ("Authorization: Bearer ", F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9"), F.substring(mixed("f"), 1, 40)), ""),
        ("{\"user\":\"x\",\"secret\":\"", F.substring(mixed("g"), 1, 40), "\"}"),
        ("", F.concat(F.lit("ghp_"), F.substring(mixed("h"), 1, 36)), ""),
    ]
    others = [
        ("commit ", F.substring(h("i"), 1, 40), ""),
        ("sha256 checksum ", h("j"), ""),
        ("", digits("k", 16), ""),
        ("call ", digits("l", 18), ""),
        ("https://www.example.com/", F.concat(words("m", "n", "o", "p"), F.lit("-20"), digits("q", 2)), ".html"),
        ("src=\"data:image/png;base64,", F.concat(F.lit("iVBORw0KGgoAAAANSUhEUg"), mixed("r")), "\""),
        ("name: ", F.concat(F.lit("user_profile_"), F.translate(words("s", "t"), "-", "_"), F.lit("_v"), digits("u", 1)), ""),
        ("token count ", digits("v", 17), ""),
        ("etag: \"", F.concat(F.substring(h("w"), 1, 8), F.lit("-"), F.substring(h("x"), 1, 16)), "\""),
        ("test token = \"", F.concat(F.lit("example"), F.translate(words("y", "z"), "-", ""), F.lit("0123456789")), "\""),
    ]
    return [(1.0, *x) for x in keys] + [(0.0, *x) for x in others]


def planted_findings(docs: DataFrame, path: str = "source", dictionary: list[str] | None = None, texts: int = 400) -> DataFrame:
    """Labelled findings: FEATURES, label, fold (0 to 4, by text). Each of at most `texts` texts of the corpus (the bound; by hash of the text) lends some of its words to stand around a
    key or look-alike of each kind. The label is what was planted, whatever the features say."""
    part = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: ~w.rlike(SHAPE))
    # Some eight times as many texts, by hash, are what is put in order.
    step = max(1, docs.count() // (8 * texts))
    some = docs.where("text <> ''").withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(step)) == 0)
    some = some.select("h", F.col(path).cast("string").alias(path), F.slice(part, 1, 12).alias("w")).dropDuplicates(["h"]).orderBy("h").limit(texts)
    pools = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(before).alias("before"), core.alias("core"), F.lit(after).alias("after")) for label, before, core, after in _pools(F.col("h").cast("string"))])
    made = some.select("h", path, "w", F.posexplode(pools).alias("kind", "x"))
    half = F.pmod(F.col("h") + F.col("kind"), F.lit(7)).cast("int")
    text = F.concat_ws(" ", F.slice("w", F.lit(1), half), F.concat("x.before", "x.core", "x.after"), F.slice("w", half + 1, F.lit(12)))
    made = made.select(F.struct("h", "kind", "x.core", "x.label").alias("doc_id"), path, text.alias("text"))
    found = candidates(made, path, dictionary).where(F.col("doc_id.core").contains(F.col("candidate")) | F.col("candidate").contains(F.col("doc_id.core")))
    return found.select(*FEATURES, "candidate", F.col("doc_id.kind").alias("kind"), F.col("doc_id.label").alias("label"), F.pmod(F.col("doc_id.h"), F.lit(5)).cast("int").alias("fold"))


def train_forest(labelled: DataFrame, most: int = 4000, trees: int = 20, depth: int = 5, seed: int = 3):
    """A random forest from candidate, FEATURES and label, on at most `most` labelled findings of each label (the bound; by hash order). None without both labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    order = F.xxhash64("candidate")
    pick = lambda v: labelled.where(F.col("label") == v).select(*FEATURES, "label", order.alias("h")).orderBy("h", *FEATURES).limit(most).drop("h")
    sample = pick(0.0).union(pick(1.0)).cache()
    if sample.select("label").distinct().count() < 2:
        return None
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="features"), RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")]
    model = Pipeline(stages=steps).fit(sample)
    sample.unpersist()
    return model


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, word, run, candidate, length, entropy, score, is_secret: a row for each candidate of each row of docs.

    labelled: findings with candidate, FEATURES and label (1 secret, 0 not); without them planted ones train the forest. Where there are not both labels (an
    empty table among others) the score is the share of key_before, assigned and entropy signs.
    Null or empty texts have no candidates; null path and doc_id are allowed; repeated rows repeat their findings. Other
    columns are not carried. An empty table gives an empty one.
    """
    from pyspark.ml.functions import vector_to_array

    dictionary = corpus_dictionary(docs)
    found = candidates(docs, path, dictionary)
    model = train_forest(saved(planted_findings(docs, path, dictionary), "planted") if labelled is None else labelled)
    if model is None:
        scored = found.withColumn("score", (F.col("key_before") + F.col("assigned") + F.least(F.col("entropy") / 4, F.lit(1.0))) / 3)
    else:
        scored = model.transform(found).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.select("doc_id", "word", "run", "candidate", F.col("length").cast("int").alias("length"), "entropy", "score", (F.col("score") >= threshold).alias("is_secret"))
