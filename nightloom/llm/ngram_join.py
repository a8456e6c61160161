"""N-gram Jaccard join by universe partition and pigeonhole.

Texts are sets of word shingles. Sizes fall into bands of ratio 1 / similarity; a pair belongs to the band of its smaller set, so a set is indexed in
its own band and in the band below. In a band, similar sets differ in at most H tokens. Hashing deals the tokens
into segments; segment i has a weight v: 1 where only its whole content is a signature, 2 where the
contents with one token deleted are signatures as well (a difference of one then still meets). If the weights exceed H by one,
some segment must meet. Segments too thin to tell anything (empty; with v = 2 also single tokens) give no signature; the
weights therefore exceed H by a slack, and the few sets with more thin segments than the slack do index
them. So no pair is lost. The number of segments and of weights of 2 in a band is the cheapest by a cost
model over the sizes of all documents.

The search runs over the different sets. First, exactly and over all of them, tokens are counted in parts of the universe: a set of whose tokens
too many are in no other set has no link, and leaves. Sets that meet in a signature which few have are compared. Of a signature that many have,
a hub is chosen; all are compared with it, and their differences from it are the sets of a new problem without what they share: distances stay as they
are, and whatever has too few tokens in common with other classes of linked sets leaves. What is left is known by its part: the tokens of its difference that
other classes have too. Sets of different classes share tokens of their parts only, so of equal parts the set with the least left to explain stands for all,
and as many pairs are compared as different parts of classes ask for, however many texts have them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import components, dropped, released, saved, unshuffled

SHINGLE = 5  # words
PERCENT = 80  # similarity
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)  # odd and unrelated: places must not be exchangeable


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; bytes.lower and bytes.split know ASCII only."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * _MULTIPLIERS[j]
    return np.unique(_mix(out))


def bands(most: int) -> list[tuple[int, int]]:
    """Sizes (low, high) of bands up to a size; a similar smaller set is in the same band or in the one below."""
    out, low = [], 1
    while low <= most:
        high = max(low, low * 100 // PERCENT)
        out.append((low, high))
        low = high + 1
    return out


def largest_difference(high: int) -> int:
    """Of similar sets the smaller of which has at most `high` tokens: |A| + |B| - 2 |A & B|, as |A & B| >= PERCENT % of the union."""
    return high * (100 + 100 * 100 // PERCENT) * (100 - PERCENT) // (100 * (100 + PERCENT))


def allocate(low: int, high: int, documents: int) -> tuple[int, int, int]:
    """(segments, how many of them have weight 2, slack) of a band: the least cost for its largest set.

    Cost: signatures of a set, plus what its thin segments would cost if it exceeded the slack. The slack grows with the
    number of documents in the band, so that sets beyond it stay few.
    """
    need = largest_difference(high) + 1
    safest = math.sqrt(2 * math.log(documents + 10))
    best = None
    for z in (safest, safest / 2, 1.0, 0.0):  # standard deviations that the slack leaves for thin segments
        for m in range(1, 2 * need + 12):
            none = (1 - 1 / m) ** low
            one = none + low / m * (1 - 1 / m) ** (low - 1)
            double = 0
            for _ in range(12):
                mean, var = (m - double) * none + 2 * double * one, (m - double) * none + 4 * double * one
                wanted = need + math.ceil(mean + z * math.sqrt(var)) - m if m > 1 else need - 1
                if wanted <= double:
                    break
                double = wanted
            if double > m or m + double < need:
                continue
            beyond = documents * math.exp(-z * z / 2) * (m - double) * none * none + documents * math.exp(-z * z / 2) * double * one * one
            cost = (m - double) + double * (1 + high / m) + beyond
            if best is None or cost < best[0]:
                best = (cost, m, double, m + double - need)
    return best[1:]


class Plan:
    """Allocations for all bands of a corpus."""

    def __init__(self, density: dict[int, int], most: int):
        self.bands = bands(max(1, most))
        self.highs = np.array([h for _, h in self.bands])
        self.allocations = []
        for low, high in self.bands:
            near = sum(n for k, n in density.items() if low * 0.8 <= 1.25**k <= high * 1.25)
            self.allocations.append(allocate(low, high, near))

    def signatures(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of a set in its own band and in the band below: hashes, roles (0 own, 1 below), weights, and the weight that may be lost in that role."""
        n = len(tokens)
        if not n:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        own = int(np.searchsorted(self.highs, n))
        # The smaller set of a pair in the own band has at most n tokens, in the band below at most that band's.
        parts = [self._in_band(tokens, own, largest_difference(n))]
        if own and n * PERCENT <= 100 * self.bands[own - 1][1]:
            smaller = self.bands[own - 1][1]
            parts.append(self._in_band(tokens, own - 1, min(largest_difference(smaller), (n + smaller) * (100 - PERCENT) // (100 + PERCENT))))
        sig = [s for s, _, _ in parts]
        return np.concatenate(sig), np.repeat(np.arange(len(parts)), [len(s) for s in sig]), np.concatenate([w for _, w, _ in parts]), np.repeat([x for _, _, x in parts], [len(s) for s in sig])

    def _in_band(self, tokens: np.ndarray, band: int, difference: int) -> tuple[np.ndarray, np.ndarray, int]:
        m, double, _ = self.allocations[band]
        salt, base = (np.uint64((band + 1) * x % 2**64) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25))
        mixed = _mix(tokens + salt)
        segment = (mixed >> np.uint64(40)) % np.uint64(m)
        order = np.argsort(segment, kind="stable")
        segment, mixed = segment[order].astype(np.int64), _mix(mixed[order])
        count = np.bincount(segment, minlength=m)
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])
        total = np.zeros(m, np.uint64)
        full = count > 0
        total[full] = np.add.reduceat(mixed, starts[full])
        name = _mix(np.arange(m, dtype=np.uint64) + base)
        thin = ~full
        thin[:double] |= count[:double] == 1
        out, weights = [_mix(total[full] ^ name[full])], [1 + (np.flatnonzero(full) < double)]
        if double:
            two = segment < double
            seg = segment[two]
            keep = count[seg] > 1  # what is left of a single token is nothing: a thin segment
            seg = seg[keep]
            out.append(_mix((total[seg] - mixed[two][keep]) ^ name[seg]))
            weights.append(np.full(len(seg), 2))
        left = m + double - difference - 1 - int(thin.sum()) - int(thin[:double].sum())
        if left < 0:
            out.append(_mix(name[thin]))  # the empty content
            weights.append(np.full(int(thin.sum()), 2))
        return np.concatenate(out), np.concatenate(weights), left


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set, as two longs."""
    return (int(np.bitwise_xor.reduce(tokens)) - 2**63, int(np.add.reduce(_mix(tokens))) - 2**63) if len(tokens) else (0, 0)


SHARES = 16  # of the documents that have one set
KEY = ["n", "h1", "h2"]  # size and hashes of a set
SLICE = 8_000_000  # characters of the texts that a task handles at once
_SHARED = 0xFFFF  # stands for the document of a token that several documents of a slice have


def _scanned(docs: DataFrame, part_of: int, buckets: int) -> DataFrame:
    """One pass over doc_id, text. kind 1: doc_id, n, h1, h2 of every row. The rest is of slices of a task's texts, `part` names the slice.
    kind 2: its different sets, packed (n, h1, h2). kind 0: tokens of one bucket, of that part of the universe whose tokens leave 0 by
    `part_of`: `sig` has 40 bits of each, `docs` the place of its document in the slice."""

    def scan(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["kind", "part", "bucket", "doc_id", "n", "h1", "h2", "sig", "docs"]
        part = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                rows, sets, size = [], {}, 0
                while at < len(ids) and size < SLICE and len(sets) < _SHARED:
                    text = texts[at].as_py()
                    size += len(text or "")
                    s = shingle_set(text)
                    key = (len(s), *set_key(s))
                    rows.append((1, part, 0, ids[at], *key, None, None))
                    if ids[at] is not None and len(s):
                        sets.setdefault(key, s)
                    at += 1
                if sets:
                    rows.append((2, part, -1, None, None, None, None, np.array(list(sets), np.int64).tobytes(), None))
                    tokens = np.concatenate(list(sets.values()))
                    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets.values()])
                    chosen = tokens % np.uint64(part_of) == 0
                    tokens, doc = tokens[chosen], doc[chosen]
                    tokens = _mix(tokens)
                    order = np.argsort(tokens, kind="stable")
                    tokens, doc = tokens[order], doc[order]
                    first = np.ones(len(tokens), bool)
                    first[1:] = tokens[1:] != tokens[:-1]
                    again = np.zeros(len(tokens), bool)
                    again[:-1] = ~first[1:]
                    doc[again] = _SHARED
                    tokens, doc = tokens[first], doc[first]
                    bucket = ((tokens >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    tokens, doc, bucket = tokens[order], doc[order], bucket[order]
                    low = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :5]
                    cuts = np.flatnonzero(np.diff(bucket)) + 1
                    for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True) if len(bucket) else ():
                        rows.append((0, part, int(bucket[lo]), None, None, None, None, low[lo:hi].tobytes(), doc[lo:hi].tobytes()))
                part += 1
                kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        released()

    return docs.select("doc_id", "text").mapInArrow(scan, "kind int, part long, bucket long, doc_id long, n long, h1 long, h2 long, sig binary, docs binary")


def _sharing(scanned: DataFrame) -> DataFrame:
    """n, h1, h2, alone: the sets that share enough for a link. alone: how many of its scanned tokens no other set has; a similar set lacks these too, so with more than
    100 - PERCENT % of them alone a set has no link. Tokens are compared by 40 bits in their bucket; falsely equal ones only make `alone` smaller."""

    def compare(key, table):
        import pyarrow as pa

        low = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :5] = low
        tokens = wide.view(np.uint64)[:, 0]
        docs = [np.frombuffer(x, np.uint16) for x in table.column("docs").to_pylist()]
        order = np.argsort(tokens)
        differs = np.ones(len(tokens) + 1, bool)
        differs[1:-1] = np.diff(tokens[order]) != 0
        alone = np.zeros(len(tokens), bool)
        alone[order] = differs[1:] & differs[:-1]
        ends = np.cumsum([len(d) for d in docs])
        counts = []
        for d, end in zip(docs, ends, strict=True):
            counts.append(np.sort(d[alone[end - len(d) : end] & (d != _SHARED)]).tobytes())
        return pa.table({"part": table.column("part"), "kind": pa.array([0] * len(docs), pa.int32()), "packed": pa.array(counts, pa.binary())})

    def total(key, table):
        import pyarrow as pa

        kind, packed = table.column("kind").to_pylist(), table.column("packed").to_pylist()
        sets = np.frombuffer(packed[kind.index(2)], np.int64).reshape(-1, 3)
        alone = np.zeros(len(sets), np.int64)
        for k, p in zip(kind, packed, strict=True):
            if k == 0:
                alone += np.bincount(np.frombuffer(p, np.uint16), minlength=len(sets))
        keep = 100 * (sets[:, 0] - alone) >= PERCENT * sets[:, 0]
        return pa.table({c: pa.array(v[keep]) for c, v in zip((*KEY, "alone"), (*sets.T, alone), strict=True)})

    compared = scanned.where("kind = 0").select("bucket", "part", "sig", "docs").groupBy("bucket").applyInArrow(compare, "part long, kind int, packed binary")
    both = compared.union(scanned.where("kind = 2").select("part", "kind", "sig"))
    found = both.groupBy("part").applyInArrow(total, "n long, h1 long, h2 long, alone long")
    return found.groupBy(*KEY).agg(F.min("alone").alias("alone"))


def _buckets(docs: DataFrame, part_of: int) -> int:
    """As many as leave some 400 000 tokens of the scanned part of the universe in each."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(16, chars // (6 * part_of * 400_000))


def _tokens(docs: DataFrame) -> DataFrame:
    """n, h1, h2, tokens (packed) for each row of doc_id, text."""

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingle_set(t) for t in batch.column(1).slice(at, 256).to_pylist()]
                keys = [(len(s), *set_key(s)) for s in found]
                yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.int64()) for j in range(3)), pa.array([s.tobytes() for s in found], pa.binary())], names=[*KEY, "tokens"])
        released()

    return docs.select("doc_id", "text").mapInArrow(sets, "n long, h1 long, h2 long, tokens binary")


def _signatures(nodes: DataFrame, plan: Plan) -> DataFrame:
    """node, role, sig, weight, left: a row for each signature."""

    def deal(batches):
        import pyarrow as pa

        names = ["node", "role", "sig", "weight", "left"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256).to_numpy()
                made = [plan.signatures(np.frombuffer(t, np.uint64)) for t in batch.column(1).slice(at, 256).to_pylist()]
                sig, role, weight, left = (np.concatenate([m[k] for m in made]) for k in range(4))
                columns = [np.repeat(ids, [len(m[0]) for m in made]), role.astype(np.int32), sig.view(np.int64), weight.astype(np.int32), left.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        released()

    return nodes.select("node", "tokens").mapInArrow(deal, "node long, role int, sig long, weight int, left int")


COMMON = 8  # sets; what more of them share is a common signature


def _met(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, common): groups(nodes), the sorted sets, COMMON at most, that share a signature; common(sig, node), memberships of common signatures that must count.

    A similar pair meets in weights above what thin segments and common signatures can cost a set that has loss left for all of its own; so common
    signatures only matter between sets that lose more than they may.
    """
    counts = signatures.groupBy("sig").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = saved(signatures.join(counts, "sig"), "shared-signatures")
    groups = shared.where(f"sets <= {COMMON}").groupBy("sig").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("nodes").where("size(nodes) > 1").distinct()
    single = shared.where(f"sets > {COMMON}")
    lost = single.groupBy("node", "role").agg(F.sum("weight").alias("lost"), F.min("left").alias("left")).where("lost > left").select("node").distinct()
    return saved(groups, "groups"), saved(single.join(lost, "node", "left_semi").select("sig", "node"), "common")


def _hubs(groups: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stars, families), both (node, hub): each set with the first of its groups, and with the set of its common signatures that has most of them;
    edited copies are nearer to that one than to each other."""
    stars = groups.select(F.explode("nodes").alias("node"), F.get("nodes", 0).alias("hub")).where("node <> hub").distinct()
    weight = common.groupBy("node").agg(F.count("*").alias("weight"))
    middle = common.join(weight, "node").groupBy("sig").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("m"))
    families = common.join(middle, "sig").select("node", (-F.col("m.node")).alias("hub")).distinct()
    return stars, saved(families, "families")


def _placed(pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Rows (place, b, share, many, node, role, tokens) of pairs(a, b): role 0 the a, role 1 the b of a share; many: how many pairs b has. A set's tokens go once to each
    group of partners: pairs are dealt by b and, where b has many, by shares of a."""
    many = pairs.groupBy("b").agg(F.count("*").alias("many"))
    dealt = saved(pairs.join(many, "b").select("a", "b", "many", F.pmod(F.xxhash64("a"), F.ceil(F.col("many") / 256)).alias("share")), name)
    groups = max(1, dealt.count() // 512)
    place = F.pmod(F.xxhash64("b", "share"), F.lit(groups)).alias("place")
    asked = dealt.select(place, "b", "share", "many", F.col("a").alias("node"), F.lit(0).alias("role"))
    held = dealt.select(place, "b", "share", "many", F.col("b").alias("node"), F.lit(1).alias("role")).distinct()
    return asked.union(held).join(nodes.select("node", "tokens"), "node")


def _of_partners(table, made) -> list:
    """Rows made(a, tokens of a, b, tokens of b) of the pairs of a place."""
    b, share, node, role = (table.column(c).to_pylist() for c in ("b", "share", "node", "role"))
    tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    hubs = {(b[k], share[k]): tokens[k] for k in range(len(b)) if role[k]}
    return [made(node[k], tokens[k], b[k], hubs[b[k], share[k]]) for k in range(len(b)) if not role[k]]


def _measured(pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """For pairs(a, b): a, b, na, nb, both (tokens shared), exactly."""

    def measure(key, table):
        import pyarrow as pa

        rows = _of_partners(table, lambda a, x, b, y: (a, b, len(x), len(y), len(x) + len(y) - len(np.unique(np.concatenate([x, y])))))
        return pa.table({c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(("a", "b", "na", "nb", "both"))})

    return saved(_placed(pairs, nodes, f"{name}-dealt").groupBy("place").applyInArrow(measure, "a long, b long, na long, nb long, both long"), name)


def _links(measured: DataFrame) -> DataFrame:
    """Integer test: 100 * intersection >= PERCENT * union."""
    return measured.where(f"100 * both >= {PERCENT} * (na + nb - both)").select("a", "b")


def _labels(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """node, comp of all nodes after links(a, b)."""
    found = components(links, name)
    return saved(nodes.select(F.col("node").alias("id")).join(found, F.col("id") == found.node, "left").select(F.col("id").alias("node"), F.coalesce("comp", "id").alias("comp")), f"{name}-labels")


# Similar sets of sizes x and y differ in at most (x + y) * LEAST / MOST tokens and share at least (x + y) * PERCENT / MOST.
LEAST, MOST = 100 - PERCENT, 100 + PERCENT
_FIT = f"100 * least(n, pn) >= {PERCENT} * greatest(n, pn) AND {MOST} * least(e, pe) >= {PERCENT} * (n + pn)"


def _within_groups(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of groups whose sets are in different classes, as far as sizes and shared tokens leave a link possible. A group has COMMON sets at most."""
    first = groups.select("nodes", F.explode("nodes").alias("a"))
    pairs = first.select("a", F.explode(F.filter("nodes", lambda b: b > F.col("a"))).alias("b")).distinct()
    of = lambda c, p: sizes.selectExpr(f"node {c}", f"n {p}n", f"e {p}e", f"comp {p}comp")
    return pairs.join(of("a", ""), "a").join(of("b", "p"), "b").where(f"comp <> pcomp AND {_FIT}").select("a", "b")


def _differences(families: DataFrame, nodes: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """hub, node, bucket, comp, delta, tokens: what a set and its hub don't both have, by buckets of tokens. Dropping what the members of a family share with the hub
    leaves all distances between them as they are."""

    def differ(key, table):
        import pyarrow as pa

        rows, members = [], dict(zip(table.column("b").to_pylist(), table.column("many").to_pylist(), strict=True))
        for a, b, x in _of_partners(table, lambda a, x, b, y: (a, b, np.setxor1d(x, y, assume_unique=True))):
            bucket = (x >> np.uint64(32)) % np.uint64(1 + members[b] // 4096)
            rows += [(b, a, int(k), len(x), x[bucket == k].tobytes()) for k in np.unique(bucket)] or [(b, a, 0, 0, b"")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.binary()], strict=True)], names=["hub", "node", "bucket", "delta", "tokens"])

    placed = _placed(families.selectExpr("node a", "hub b"), nodes, f"{name}-dealt")
    found = placed.groupBy("place").applyInArrow(differ, "hub long, node long, bucket long, delta long, tokens binary")
    return saved(found.join(classes.select("node", "comp"), "node"), name)


def _parts(differences: DataFrame) -> DataFrame:
    """hub, node, o, x1, x2: of a difference, how many tokens the differences of other classes in the family have too, and 128 bits that name these tokens."""

    def compare(key, table):
        import pyarrow as pa

        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        every = np.concatenate(tokens)
        ends = np.cumsum([len(t) for t in tokens])
        of = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        _, comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)
        _, at = np.unique(every, return_inverse=True)
        low, high = np.full(at.max(initial=-1) + 1, len(comp)), np.full(at.max(initial=-1) + 1, -1)
        np.minimum.at(low, at, comp[of])
        np.maximum.at(high, at, comp[of])
        shared = (low != high)[at]

        def named(x):
            upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(shared, x, np.uint64(0)))])
            return pa.array((upto[ends] ^ upto[np.concatenate([[0], ends[:-1]])]).view(np.int64))

        o = np.bincount(of[shared], minlength=len(tokens))
        first = _mix(every + _MULTIPLIERS[0])
        return pa.table({"hub": table.column("hub"), "node": table.column("node"), "o": pa.array(o, pa.int64()), "x1": named(first), "x2": named(_mix(first + _MULTIPLIERS[1]))})

    found = differences.groupBy("hub", "bucket").applyInArrow(compare, "hub long, node long, o long, x1 long, x2 long")
    return found.groupBy("hub", "node").agg(F.sum("o").alias("o"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))


def _left_of_families(families: DataFrame, nodes: DataFrame, sizes: DataFrame, name: str, rounds: int = 3) -> tuple[DataFrame, int]:
    """Rows (hub, node, comp, n, e, o, x1, x2, excess) of the sets of families(node, hub) that may be linked to another class of their family, and how many.

    With differences x and y from the hub, two sets differ in |x| + |y| - 2 |x & y| tokens, so a link asks for 2 |x & y| >= excess(a) + excess(b), where a set's excess is the
    size of its difference less its part of what a similar pair may differ in. No set shares more with other classes than its o. Sets that
    this rules out go, which lowers the o of others.
    """
    several = families.join(sizes.select("node", "comp"), "node").groupBy("hub").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("hub")
    open_ = saved(families.join(several, "hub", "left_semi"), f"{name}-open")
    found = _differences(open_, nodes, sizes, name)
    for r in range(rounds):
        rows = found.groupBy("hub", "node", "comp").agg(F.max("delta").alias("delta")).join(_parts(found), ["hub", "node"]).join(sizes.select("node", "n", "e"), "node")
        rows = saved(rows.withColumn("excess", F.expr(f"{MOST} * delta - {LEAST} * n")), f"{name}-{r}")
        # The least excess of another class: that of the family's best, or of the best outside its class.
        best = rows.groupBy("hub").agg(F.min(F.struct("excess", "comp")).alias("best"), F.min("n").alias("pn"))
        second = rows.join(best, "hub").where("comp <> best.comp").groupBy("hub").agg(F.min("excess").alias("second"))
        partner = best.join(second, "hub").selectExpr("hub", "best.excess first", "best.comp of", "second", "pn")
        kept = rows.join(partner, "hub").where(f"{2 * MOST} * o >= excess + CASE WHEN comp = of THEN second ELSE first END AND {MOST} * e >= {PERCENT} * (n + pn)")
        kept = saved(kept.select("hub", "node", "comp", "n", "e", "o", "x1", "x2", "excess"), f"{name}-kept-{r}")
        many = kept.count()
        if r == rounds - 1 or many * 10 > rows.count() * 9:
            break
        found = found.join(kept.select("hub", "node"), ["hub", "node"], "left_semi")
    return kept, many


def _of_one_part(left: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with the same part and the one with the least excess among them, where the two are linked: they share their part, o tokens. Two others
    that are linked are linked to that one as well, so the classes are whole."""
    part = ["hub", "o", "x1", "x2"]
    least = left.groupBy(*part).agg(F.min(F.struct("excess", "node", "comp")).alias("least"))
    # A part that very many sets have is a hot key: the one row of the least goes to all shares.
    share = F.pmod(F.xxhash64("node"), F.lit(SHARES)).cast("int")
    least = least.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    pairs = left.withColumn("share", share).join(least, [*part, "share"])
    return pairs.where(f"comp <> least.comp AND {2 * MOST} * o >= excess + least.excess").selectExpr("node a", "least.node b").distinct()


def _between_parts(left: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes that may be linked; of the sets of a class with the same part that with the least excess stands for all."""
    one = left.groupBy("hub", "o", "x1", "x2", "comp").agg(F.min(F.struct("excess", "node", "n", "e")).alias("s")).select("hub", "o", "comp", "s.*")
    other = one.selectExpr("hub", "node b", "comp pcomp", "n pn", "e pe", "o po", "excess pexcess")
    may = f"node < b AND comp <> pcomp AND {2 * MOST} * least(o, po) >= excess + pexcess AND {_FIT}"
    return one.join(other, "hub").where(may).selectExpr("node a", "b").distinct()


SLOTS = 1 << 27  # bits at most that tell ids, 16 MB
_WORD = 32768  # bits of one of Spark's bitmaps


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids(doc_id). Bitmaps of hashed ids, of at most SLOTS bits, go to where the texts are and let few others pass; so only these are shuffled
    for the join, which is exact. Whatever ids the bitmaps are too small for merely pass more texts. The join itself has no proven bound: it is not to be broadcast, whatever its size here."""
    words = min(SLOTS, 32 * ids.count()) // _WORD + 1
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(words * _WORD))
    word, bit = F.floor(slot / _WORD).cast("int").alias("word"), (slot % _WORD).alias("bit")
    bits = ids.select(word, bit).groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits"))
    octet = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = docs.select("*", word, bit).join(F.broadcast(bits), "word").where(F.getbit(octet, F.col("bit") % 8) == 1)
    # A semi join would be moved before the bitmaps.
    return some.select(*docs.columns).join(ids.select("doc_id").distinct().hint("merge"), "doc_id").select(*docs.columns)


def near_duplicates(docs: DataFrame, part_of: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Documents link where 100 * |A & B| >= 80 * |A or B| over sets of five-word shingles; component_id is the smallest
    doc_id reachable. Null, empty and blank texts have no shingles and link with nothing. Rows that share a
    doc_id are one document with several texts: each text is compared, and links count for the id. A null doc_id has a null
    component and takes no part. Other columns are not carried. An empty table gives an empty one.
    part_of: the first pass compares the tokens of one part of so many of the universe.
    """
    with unshuffled(docs.sparkSession):
        return _near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), part_of)


def _near_duplicates(docs: DataFrame, part_of: int) -> DataFrame:
    scanned = saved(_scanned(docs, part_of, _buckets(docs, part_of)), "scanned")
    sizes = scanned.where("kind = 1").select("doc_id", *KEY)
    known = sizes.where("doc_id is not null and n > 0")
    # Equal sets are one node of the search, named by the smallest doc_id.
    sets = saved(known.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "sets")
    some = sets.join(_sharing(scanned), KEY).select("first", *KEY)
    some = saved(some, "sharing-part")
    # Of the tokens nothing is read any more.
    counted, sizes = scanned, saved(sizes, "sizes")
    known = sizes.where("doc_id is not null and n > 0")
    dropped(counted)
    texts = saved(_of_ids(docs, some.select(F.col("first").alias("doc_id"))), "texts")
    # The same by the whole universe, over the sets that are left.
    again = saved(_scanned(texts, 1, _buckets(texts, 1)), "scanned-again")
    left = saved(sets.join(_sharing(again), KEY).select(*KEY, "first", (F.col("n") - F.col("alone")).alias("e")), "sharing")
    dropped(again)
    nodes = _of_ids(texts, left.select(F.col("first").alias("doc_id")))
    nodes = _tokens(nodes).dropDuplicates(KEY).join(left, KEY).withColumn("node", F.monotonically_increasing_id())
    nodes = saved(nodes, "nodes")
    dropped(texts)
    density = nodes.groupBy(F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).cast("int").alias("k")).agg(F.count("*").alias("d"), F.max("n").alias("most")).collect()  # some dozens of rows
    plan = Plan({r["k"]: r["d"] for r in density}, max((r["most"] for r in density), default=1))
    signatures = saved(_signatures(nodes, plan), "signatures")
    groups, common = _met(signatures)
    dropped(signatures)
    stars, families = _hubs(groups, common)
    both = stars.union(families.where("node <> hub")).distinct().selectExpr("node a", "hub b")
    size = nodes.select("node", "n", "e")
    fit = both.join(size.selectExpr("node a", "n", "e"), "a").join(size.selectExpr("node b", "n pn", "e pe"), "b").where(_FIT).select("a", "b")
    links = _links(_measured(fit, nodes, "stars-measured"))
    classes = saved(size.join(_labels(nodes, links, "stars"), "node"), "classes")
    families, many = _left_of_families(families, nodes, classes, "families-apart")
    rest = _within_groups(groups, classes)
    links = links.union(_links(_measured(rest.union(_of_one_part(families)).distinct() if many else rest, nodes, "rest-measured")))
    if many:
        classes = saved(size.join(_labels(nodes, links, "parts"), "node"), "classes-of-parts")
        families, many = _left_of_families(families.select("node", "hub"), nodes, classes, "parts-apart")
        if many:
            links = links.union(_links(_measured(_between_parts(families), nodes, "parts-measured")))
    # Ends of links as documents; an id with several texts is one document.
    ends = links.join(nodes.selectExpr("node a", "first x"), "a").join(nodes.selectExpr("node b", "first y"), "b").selectExpr("x a", "y b")
    several = known.groupBy("doc_id").agg(F.min(F.struct(*KEY)).alias("k"), F.max(F.struct(*KEY)).alias("l")).where("k <> l").select("doc_id")
    texts_of = known.join(several, "doc_id", "left_semi").distinct().join(sets, KEY).selectExpr("doc_id a", "first b")
    found = components(ends.union(texts_of), "documents")
    named = sets.where("copies > 1").select(*KEY, "first").union(left.select(*KEY, "first")).union(sets.join(several, F.col("first") == F.col("doc_id"), "left_semi").select(*KEY, "first")).distinct()
    named = saved(named.join(found, F.col("first") == F.col("node"), "left").select(*KEY, F.coalesce("comp", "first").alias("comp")), "named")
    # A set that very many documents have is a hot key of this join: its documents are dealt by shares.
    named = named.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = sizes.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int"))
    out = dealt.join(named, [*KEY, "share"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
