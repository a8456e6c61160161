"""Exact top-k inner products by pivot-table elimination.

Vectors are made equally long by one more component (the root of what is missing to the longest norm), so the highest
inner product is the least distance. A table holds each candidate's distances to many pivots that lie far apart; by the triangle
inequality the largest |d(q, p) - d(c, p)| over the pivots bounds d(q, c) from below. Candidates of a batch stand in cells by their nearest pivot, in the
order of their distance from it. All queries of a block go through a batch together: in each turn every query takes the cell with the least bound
that it has not seen, and of the cell the candidates whose bound leaves them a chance; a query stops where no cell's bound can beat its
k-th best. What a cell and its queries need is one matrix product. Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm.common import saved

SLACK = 1e-6  # on distances relative to the longest norm: far above rounding, so no true candidate is lost
LIMIT = float(2**62)  # greater components count as this
LONG = 2**63 - 1


def quantised(vectors: DataFrame, key: str, vector: str, factor: int) -> DataFrame:
    """id, v: floor(factor * x) as longs, at most LIMIT. Rows with a null id or vector, or a null or non-finite component, are left out."""
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.greatest(F.least(F.lit(factor) * x, F.lit(LIMIT)), F.lit(-LIMIT))))
    fine = F.forall(F.col(vector).cast("array<double>"), lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(fine).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def lifted_distances(v: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of vectors (with their extra component) to pivots (with theirs)."""
    square = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (v @ pivots.T) + (lift[:, None] - pivot_lift) ** 2
    return np.sqrt(np.maximum(square, 0))


def lifts(v: np.ndarray, longest2: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest2 - (v * v).sum(1), 0))


def far_apart(v: np.ndarray, count: int, longest2: float) -> np.ndarray:
    """Pivots among v: the first, then again and again the one farthest from all before; equal ones do not come twice."""
    lift = lifts(v, longest2)
    chosen, away = [0], lifted_distances(v, lift, v[:1], lift[:1])[:, 0]
    while len(chosen) < min(count, len(v)) and away.max() > 0:
        k = int(away.argmax())
        chosen.append(k)
        away = np.minimum(away, lifted_distances(v, lift, v[k : k + 1], lift[k : k + 1])[:, 0])
    return v[chosen]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all q with all c: exact, as floats where these hold them, else as Python integers held to the range of a long."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return q @ c.T
    whole = q.astype(np.int64).astype(object) @ c.astype(np.int64).astype(object).T
    return np.minimum(np.maximum(whole, -LONG), LONG)


class Best:
    """The k best of each query so far; empty places have no id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.of, self.k = ids, k
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(ids), k), -np.inf, object)
        self.worst = np.full(len(ids), -np.inf)

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge scores (rows x ids); ties go to the smaller id. A query's own id is left out."""
        own = ids[None, :] == self.of[rows][:, None]
        scores = np.where(own, -np.inf, scores)
        level = self.worst[rows]
        if scores.shape[1] > self.k and scores.dtype != object:
            level = np.maximum(level, np.partition(scores, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((scores >= level[:, None]).astype(bool) & ~own)
        if not len(r):
            return
        touched, at = np.unique(r, return_inverse=True)
        every = rows[touched]
        row = np.concatenate([at, np.repeat(np.arange(len(every)), self.k)])
        found = np.concatenate([scores[r, c].astype(object), self.scores[every].ravel()])
        name = np.concatenate([ids[c], self.ids[every].ravel()])
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -found[i], name[i]))) if scores.dtype == object else np.lexsort((name, -found.astype(np.float64), row))
        starts = np.searchsorted(row[order], np.arange(len(every)))
        pick = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.ids[every], self.scores[every] = name[pick].reshape(-1, self.k), found[pick].reshape(-1, self.k)
        last = self.scores[every, -1].astype(np.float64)
        self.worst[every] = np.where(np.isfinite(last), last - np.abs(last) * 1e-12, last)  # floats may not hold it


def search_batch(q: np.ndarray, q_to: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_to: np.ndarray, longest2: float, best: Best) -> int:
    """Take one batch of candidates into best; the number of (query, candidate) pairs evaluated. q_to, c_to: distances to the pivots."""
    # Of equal vectors, the rows of the k smallest ids beside a query's own are all that it can need.
    raw = np.ascontiguousarray(c.astype(np.int64)).view(np.dtype((np.void, 8 * c.shape[1]))).ravel() if c.shape[1] else np.zeros(len(c))
    order = np.argsort(c_ids, kind="stable")
    _, same = np.unique(raw[order], return_inverse=True)
    by = np.argsort(same, kind="stable")
    starts = np.searchsorted(same[by], np.arange(same.max(initial=-1) + 1))
    most = np.unique(c_ids, return_counts=True)[1].max(initial=0)
    keep = order[by[np.arange(len(by)) - starts[same[by]] < best.k + most]]
    c_ids, c, c_to = c_ids[keep], c[keep], c_to[keep]
    cell = c_to.argmin(axis=1)
    order = np.lexsort((c_to[np.arange(len(cell)), cell], cell))
    c_ids, c, c_to, cell = c_ids[order], c[order], c_to[order], cell[order]
    names, first = np.unique(cell, return_index=True)
    ends = np.append(first[1:], len(cell))
    low, high = np.minimum.reduceat(c_to, first, axis=0), np.maximum.reduceat(c_to, first, axis=0)
    bound = np.zeros((len(q), len(names)))
    for p in range(c_to.shape[1]):
        np.maximum(bound, np.maximum(q_to[:, p : p + 1] - high[None, :, p], low[None, :, p] - q_to[:, p : p + 1]), out=bound)
    turn = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, turn, axis=1)
    own = (q * q).sum(1)
    eps = SLACK * (longest2**0.5 + np.sqrt(own) + 1)
    # d(q, c)^2 = |q|^2 + longest^2 - 2 score
    reach = lambda rows: np.sqrt(np.maximum(own[rows] + longest2 - 2 * best.worst[rows], 0)) + eps[rows]
    open_, pairs = np.arange(len(q)), 0
    for t in range(len(names)):
        open_ = open_[bound[open_, t] <= reach(open_)]
        if not len(open_):
            break
        at = turn[open_, t]
        for g in np.unique(at):
            rows = open_[at == g]
            near, far = q_to[rows, names[g]], reach(rows)
            along = c_to[first[g] : ends[g], names[g]]
            lo = int(np.searchsorted(along, (near - far).min(), side="left"))
            hi = int(np.searchsorted(along, (near + far).max(), side="right"))
            if lo < hi:
                some = slice(first[g] + lo, first[g] + hi)
                best.take(rows, c_ids[some], products(q[rows], c[some]))
                pairs += len(rows) * (hi - lo)
    return pairs


def _matrices(batch):
    """(length, ids, matrix by column name) for each vector length in an Arrow batch of id, v, ...; columns of lists become matrices."""
    lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        part = batch.take(rows)
        flat = lambda name, part=part, rows=rows: part.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        yield int(n), part.column("id").to_numpy(), flat


def _lists(m: np.ndarray, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel(), kind))


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", factor: int = 256, pivots: int = 64, block: int = 8192, sample: int = 4096, evaluated=None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by every, the k highest integer inner products.

    Components x count as floor(factor * x), held to +-2^62; scores beyond a long are its ends. Vectors that are null, or hold null or non-finite components, take no
    part; only vectors of the same length are compared. Ties go to the smaller vec_id; a query is never its own candidate
    (by id). Repeated ids: candidates are rows, so each counts; as a query the least vector of an id stands.
    Queries come in blocks of about block rows, each sent to all tasks (a stated bound); candidates stay where they are.
    pivots: how many are chosen, far apart, among `sample` rows (the bound) by hash. evaluated: an accumulator of the pairs evaluated.
    Other columns are not carried. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    v = saved(quantised(vectors, key, vector, factor), "vectors")
    square = F.reduce("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    head = v.agg(F.max(square).alias("most"), F.count(F.when(F.col("id") % every == 0, 1)).alias("queries")).first()
    if not head["queries"]:
        return spark.createDataFrame([], schema)
    longest2 = float(head["most"])
    by_length = {}
    for r in v.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect():
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    by_length = {n: far_apart(np.array(x, np.float64).reshape(len(x), n), pivots, longest2) for n, x in by_length.items()}

    def table(batches):
        import pyarrow as pa

        for batch in batches:
            for n, ids, flat in _matrices(batch):
                m = flat("v")
                p = by_length.get(n, np.zeros((1, n)))
                to = lifted_distances(m, lifts(m, longest2), p, lifts(p, longest2))
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(m.astype(np.int64), pa.int64()), _lists(to, pa.float64())], names=["id", "v", "to"])

    pivoted = saved(v.mapInArrow(table, "id long, v array<bigint>, to array<double>"), "pivots")
    blocks = max(1, -(-head["queries"] // block))
    queries = v.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = saved(queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")), "queries")
    found = None
    for b in range(blocks):
        by = {}
        for r in queries.where(F.col("block") == b).select("id", "v").collect():
            by.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        made = {}
        for n, rows in by.items():
            m, p = np.array([r[1] for r in rows], np.float64).reshape(len(rows), n), by_length.get(n, np.zeros((1, n)))
            made[n] = np.array([r[0] for r in rows], np.int64), m, lifted_distances(m, np.zeros(len(m)), p, lifts(p, longest2))
        sent = spark.sparkContext.broadcast(made)

        def search(batches, sent=sent):
            import pyarrow as pa

            best: dict[int, Best] = {}
            for batch in batches:
                for n, ids, flat in _matrices(batch):
                    if n in sent.value:
                        q_ids, q, q_to = sent.value[n]
                        pairs = search_batch(q, q_to, ids, flat("v"), flat("to"), longest2, best.setdefault(n, Best(q_ids, k)))
                        if evaluated is not None:
                            evaluated.add(pairs)
            for x in best.values():
                row, place = np.nonzero(x.scores != -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(x.of[row]), pa.array(x.ids[row, place]), pa.array([int(s) for s in x.scores[row, place]], pa.int64())], names=["query_id", "vec_id", "score"])

        part = pivoted.mapInArrow(search, "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
