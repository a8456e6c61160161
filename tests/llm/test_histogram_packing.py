"""Histogram packing: ids against the tokenizer, sequences without gaps or padding, odd rows."""

import random
import zlib

import public_tokenizers
import pytest
import tokenizers

from nightloom.llm.histogram_packing import END, Gaps, pack_by_histogram, shortest_pack_first

ROOM = 2048


def ids_of(tokenizer, text):
    return [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), END]


def check(got, texts, room=ROOM):
    """got are rows; texts a list of (key, text), repeated rows included."""
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {}
    for k, t in texts:
        docs.setdefault(k, []).append(ids_of(tokenizer, t))
    want, sums, sequences = {}, {}, {}
    for k, several in docs.items():
        want[k] = sorted(len(x) for x in several for _ in [0])
    for r in got:
        fits = [x for x in docs[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[r.start : r.start + r.length])) == r.ids_crc32]
        assert fits, r
        sums.setdefault(r.doc_id, {}).setdefault(r.doc_tokens, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, several in docs.items():
        for n in {len(x) for x in several}:
            copies = sum(len(x) == n for x in several)
            marks = [0] * n
            for start, length in sums[k][n]:
                for i in range(start, start + length):
                    marks[i] += 1
            assert marks == [copies] * n
    padding, short = 0, []
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at and length > 0
            at += length
        assert at <= room
        padding += 0 if at & (at - 1) == 0 else room - at
        short += [at] if at < room else []
    assert padding == 0 and len(set(short)) == len(short)
    return sequences


def test_pieces_and_sequences(spark):
    rnd = random.Random(5)
    words = "sky dust lens noise frame star field night drift tile".split()
    texts = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 5, 40, 700, 1500, 2047, 2048, 5000])))) for i in range(150)]
    texts += [(500, None), (501, ""), (502, ""), (None, "no id"), (7, texts[7][1]), (7, "another text"), (503, "é ﬀ 日本 " * 300), (504, "a" + " " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    docs = docs.withColumn("length", docs.doc_id).withColumn("sequence_id", docs.doc_id).withColumn("k", docs.text)  # names that are used inside
    check(pack_by_histogram(docs).collect(), texts)


@pytest.mark.parametrize("texts", [[], [(1, None)], [(1, "one two three four five six seven")], [(3, "x"), (4, "y")] * 40])
def test_few_rows(spark, texts):
    got = pack_by_histogram(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(got, texts)
    assert bool(got) == bool(texts)


def test_many_copies_of_one_length(spark):
    texts = [(i, None if i % 3 else "some words of one text") for i in range(9000)]
    check(pack_by_histogram(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)


def test_very_long_texts(spark):
    texts = [(1, "word " * 1_000_000), (2, " " * 4_000_000), (3, "a" + "\n" * 4_000_000), (4, "x" * 2_000_000)]
    got = pack_by_histogram(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "length", "doc_tokens").collect()
    for k, _ in texts:
        assert sum(r.length for r in got if r.doc_id == k) == next(r.doc_tokens for r in got if r.doc_id == k)


def test_placement_over_the_histogram():
    rnd = random.Random(2)
    for _ in range(200):
        room = rnd.choice([16, 64, 256])
        sizes = {rnd.randrange(1, room): rnd.choice([1, 2, 7, 1000]) for _ in range(rnd.randrange(0, 12))}
        patterns, placements, packs = shortest_pack_first(sizes, room)
        fill, ranks = {}, {}
        for length, first, f, n, base, at in placements:
            assert ranks.get(length, 0) == first
            ranks[length] = first + f * n
            for p in range(base, base + n):
                assert fill.get(p, 0) == at and at + f * length <= room
                fill[p] = at + f * length
        assert ranks == sizes and len(fill) == packs and sorted(fill) == list(range(packs))
        left = {p: r for r, base, n in patterns for p in range(base, base + n)}
        assert left == {p: room - u for p, u in fill.items() if u < room}
        need = sum(left.values())
        gaps = Gaps(patterns, packs, room, need + 3 * room + 5)
        at = 0
        while at < need + 3 * room + 5:
            n = min(rnd.randrange(1, room), need + 3 * room + 5 - at)
            for _, some, p, offset in gaps.cut(at, n):
                assert fill.get(p, 0) == offset
                fill[p] = offset + some
            at += n
        assert sorted(u for u in fill.values() if u < room) == [1, 4]


def test_millions_of_equal_lengths_take_few_steps():
    sizes = {n: 10**9 // n for n in range(1, 2048)}
    patterns, placements, packs = shortest_pack_first(sizes, 2048)
    assert len(placements) < 50_000
    assert sum(n * k for n, k in sizes.items()) > 0.98 * 2048 * packs
