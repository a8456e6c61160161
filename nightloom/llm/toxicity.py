"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word's input is its own hashed embedding beside the scaled sum of its character n-gram embeddings. Two GRUs read a window
of words from either end; attention over their states gives the window's logit, and a text's logit is the highest of all its
overlapping windows. Long runs of letters (text without spaces) are read in overlapping pieces. Everything is numpy. Training: of each toxic document those windows that score best, of each other
document the best-scoring and some others, chosen anew in each epoch; Adam on all parameters. A part of the labelled sample is
kept from training to place the threshold.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm.common import released

WINDOW, STRIDE = 32, 24
WORDS, GRAMS = 1 << 18, 1 << 17  # hash buckets; 0 is kept for padding
EMBED, HIDDEN = 8, 8
THRESHOLD = 0.7
PIECE, SHARED = 40, 5  # letters of a piece of a longer run, and how many it shares with the next: no 5-gram is lost
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in order, those of more than PIECE letters as overlapping pieces."""
    found = _WORD.findall((text or "").lower())
    if all(len(w) <= PIECE for w in found):
        return found
    return [w[at : at + PIECE] for w in found for at in range(0, max(1, len(w) - SHARED), PIECE - SHARED)]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 3- and 5-grams of words with their ends marked: all in one array, and how many each word has."""
    codes = np.frombuffer("\n".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(codes == 10)
    found, of = [], []
    for n in (3, 5):
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ codes[j : len(codes) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = (word[: len(h)] == word[n - 1 :]) & (codes[: len(h)] != 10)
            found.append((h[inside] % np.uint64(GRAMS - 1)).astype(np.int64) + 1)
            of.append(word[: len(h)][inside])
    of = np.concatenate(of)
    return np.concatenate(found)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def word_bucket(word: str) -> int:
    return zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % (WORDS - 1) + 1


def vocabulary(texts: Iterable[list[str]]) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Texts as rows of their distinct words (row 0 is padding), and of the rows: bucket, grams in one array, their starts and counts."""
    rows: dict[str, int] = {}
    ids = [np.array([rows.setdefault(w, len(rows) + 1) for w in t], np.int32) for t in texts]
    words, grams, counts = list(rows), [np.zeros(1, np.int32)], [np.ones(1, np.int32)]
    for at in range(0, len(words), 20_000):
        g, n = grams_of(words[at : at + 20_000])
        grams.append(g.astype(np.int32))
        counts.append(n.astype(np.int32))
    grams, counts = np.concatenate(grams), np.concatenate(counts)
    return ids, {"buckets": np.array([0, *map(word_bucket, rows)]), "grams": grams, "counts": counts, "starts": np.cumsum(counts) - counts}


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover n words; a shorter text has one window."""
    return np.array([0]) if n <= WINDOW else np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def windows(ids: np.ndarray) -> np.ndarray:
    if len(ids) < WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None]
    return ids[window_starts(len(ids))[:, None] + np.arange(WINDOW)]


def _sigmoid(x):
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Parameters, forward and backward passes; all float32."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d = 2 * EMBED
        glorot = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": np.zeros((WORDS, EMBED), np.float32), "gram": np.zeros((GRAMS, EMBED), np.float32), "att": glorot(2 * HIDDEN, HIDDEN), "attv": glorot(HIDDEN), "out": glorot(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": glorot(d, 3 * HIDDEN), f"u{side}": glorot(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.shift, self.scale = 0.0, 1.0

    def inputs(self, buckets, grams, counts) -> np.ndarray:
        """Input vectors of words: word embedding beside the sum of gram embeddings over the root of their number."""
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        chars = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / np.sqrt(counts)[:, None]
        return np.concatenate([self.p["word"][buckets], chars.astype(np.float32)], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input terms, side by side."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)

    def run(self, steps: np.ndarray, mask: np.ndarray | None, side: str, keep: bool):
        """States (time, n, HIDDEN) of one direction from its input terms (time, n, 3 HIDDEN), in the order of reading."""
        u, n = self.p[f"u{side}"], steps.shape[1]
        h, states, cache = np.zeros((n, HIDDEN), np.float32), np.empty((len(steps), n, HIDDEN), np.float32), []
        for t in range(len(steps)):
            rz = _sigmoid(steps[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            reset, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            c = np.tanh(steps[t, :, 2 * HIDDEN :] + (reset * h) @ u[:, 2 * HIDDEN :])
            new = h + z * (c - h)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                cache.append((h, reset, z, c))
            h = states[t] = new
        return states, cache

    def pooled(self, hf: np.ndarray, hb: np.ndarray, mask: np.ndarray | None):
        h = np.concatenate([hf, hb], axis=2)
        a = np.tanh(h @ self.p["att"])
        e = a @ self.p["attv"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pool = (alpha[:, :, None] * h).sum(axis=0)
        return h, a, alpha, pool, pool @ self.p["out"] + self.p["bias"]

    def logits(self, table: np.ndarray, batch: np.ndarray) -> np.ndarray:
        """Logits of windows of rows of a table of input terms."""
        steps = table[batch.T]
        mask = batch.T != 0 if (batch[:, -1] == 0).any() else None
        hf, _ = self.run(steps[:, :, : 3 * HIDDEN], mask, "f", False)
        hb, _ = self.run(steps[::-1, :, 3 * HIDDEN :], None if mask is None else mask[::-1], "b", False)
        return self.pooled(hf, hb[::-1], mask)[4]

    def _back(self, steps, mask, side, cache, dstates, grads):
        """Gradient of the input terms of one direction; adds to those of its recurrent weights."""
        u, du, dh = self.p[f"u{side}"], np.zeros_like(self.p[f"u{side}"]), np.zeros_like(dstates[0])
        dsteps = np.zeros_like(steps)
        for t in range(len(steps) - 1, -1, -1):
            h, reset, z, c = cache[t]
            dnew = dh + dstates[t]
            held = 0
            if mask is not None:
                held, dnew = np.where(mask[t][:, None], 0, dnew), np.where(mask[t][:, None], dnew, 0)
            dc = dnew * z * (1 - c * c)
            dz = dnew * (c - h) * z * (1 - z)
            drh = dc @ u[:, 2 * HIDDEN :].T
            dr = drh * h * reset * (1 - reset)
            drz = np.concatenate([dr, dz], axis=1)
            dsteps[t, :, : 2 * HIDDEN], dsteps[t, :, 2 * HIDDEN :] = drz, dc
            du[:, : 2 * HIDDEN] += h.T @ drz
            du[:, 2 * HIDDEN :] += (reset * h).T @ dc
            dh = held + dnew * (1 - z) + drh * reset + drz @ u[:, : 2 * HIDDEN].T
        grads[f"u{side}"] = du
        return dsteps

    def gradients(self, v: dict, batch: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted log loss over windows; v: buckets, grams, counts, starts of the vocabulary."""
        rows, at = np.unique(batch, return_inverse=True)
        at = at.reshape(batch.shape)
        counts = v["counts"][rows]
        flat = np.repeat(v["starts"][rows] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        grams = v["grams"][flat]
        x = self.inputs(v["buckets"][rows], grams, counts)
        steps = self.projected(x)[at.T]
        mask = batch.T != 0
        hf, cf = self.run(steps[:, :, : 3 * HIDDEN], mask, "f", True)
        hb, cb = self.run(steps[::-1, :, 3 * HIDDEN :], mask[::-1], "b", True)
        h, a, alpha, pool, logit = self.pooled(hf, hb[::-1], mask)
        g = ((_sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
        grads = {"out": pool.T @ g, "bias": np.array([g.sum()], np.float32)}
        dpool = g[:, None] * self.p["out"]
        dh = alpha[:, :, None] * dpool
        dalpha = (h * dpool).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        grads["attv"] = np.einsum("tnk,tn->k", a, de)
        da = de[:, :, None] * self.p["attv"] * (1 - a * a)
        grads["att"] = np.einsum("tni,tnk->ik", h, da)
        dh = dh + da @ self.p["att"].T
        df = self._back(steps[:, :, : 3 * HIDDEN], mask, "f", cf, dh[:, :, :HIDDEN], grads)
        db = self._back(steps[::-1, :, 3 * HIDDEN :], mask[::-1], "b", cb, dh[::-1, :, HIDDEN:], grads)[::-1]
        dproj = np.zeros((len(rows), 6 * HIDDEN), np.float32)
        np.add.at(dproj, at.T.ravel(), np.concatenate([df, db], axis=2).reshape(-1, 6 * HIDDEN))
        for side, part in (("f", dproj[:, : 3 * HIDDEN]), ("b", dproj[:, 3 * HIDDEN :])):
            grads[f"w{side}"], grads[f"c{side}"] = x.T @ part, part.sum(axis=0)
        dx = dproj[:, : 3 * HIDDEN] @ self.p["wf"].T + dproj[:, 3 * HIDDEN :] @ self.p["wb"].T
        dx[rows == 0] = 0
        grads["word"] = _by_row(v["buckets"][rows], dx[:, :EMBED])
        grads["gram"] = _by_row(grams, np.repeat(dx[:, EMBED:] / np.sqrt(counts)[:, None], counts, axis=0))
        return grads


def _by_row(rows: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the rows of an embedding that a batch touches."""
    own, at = np.unique(rows, return_inverse=True)
    out = np.zeros((len(own), parts.shape[1]), np.float32)
    np.add.at(out, at, parts)
    return own, out


def _evidence(lists: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Shrunken log odds of hashed features over documents: where embeddings begin."""
    seen = np.zeros((2, size))
    for ids, y in zip(lists, labels, strict=True):
        seen[int(y)][np.unique(ids)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    out = odds * seen.sum(axis=0) / (seen.sum(axis=0) + 5)
    out[0] = 0
    return np.clip(out / 3, -1, 2).astype(np.float32)


def train(texts: list[str | None], labels: list[int], steps: int = 450, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network | None:
    """A network from labelled texts; None without both labels. About `steps` batches at least, in 5 to 40 epochs."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    docs, v = vocabulary(map(words_of, texts))
    counts = v["counts"]
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # a fifth of each label places the threshold
        held[rng.permutation(np.flatnonzero(y == c))[: int((y == c).sum() // 5)]] = True
    learn = np.flatnonzero(~held)
    grams_in = lambda ids: v["grams"][np.concatenate([np.arange(v["starts"][w], v["starts"][w] + counts[w]) for w in np.unique(ids)])] if len(ids) else np.zeros(0, np.int64)
    for name, ids in (("word", np.unique(v["buckets"])), ("gram", np.unique(v["grams"]))):  # what was never seen stays zero
        net.p[name][ids] = (0.02 * rng.standard_normal((len(ids), EMBED))).astype(np.float32)
    net.p["word"][:, 0] = _evidence([v["buckets"][docs[k]] for k in learn], y[learn], WORDS)
    net.p["gram"][:, 0] = _evidence([grams_in(docs[k]) for k in learn], y[learn], GRAMS)
    net.p["word"][0] = net.p["gram"][0] = 0
    cut = [windows(d) for d in docs]
    first = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
    every = np.concatenate(cut)
    del cut
    moments = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in net.p.items()}
    step = 0
    epochs = int(np.clip(steps * batch / (2 * y[learn].sum() + 5 * (1 - y[learn]).sum()), 5, 40))
    for epoch in range(epochs):
        if epoch:
            score = _all_logits(net, v, every)
        else:
            # The first dimensions hold the evidence of words and grams.
            chars = np.add.reduceat(net.p["gram"][:, 0][v["grams"]], v["starts"]) / np.sqrt(counts)
            score = (net.p["word"][v["buckets"], 0] + chars)[every].max(axis=1)
        picks = []
        for k in learn:
            s = score[first[k] : first[k + 1]]
            best = np.argsort(-s)[: 2 if y[k] else 3]
            if not y[k]:
                best = np.unique(np.append(best, rng.integers(0, len(s), 2)))
            picks += [(first[k] + b, y[k]) for b in best]
        at = np.array([p[0] for p in picks])
        target = np.array([p[1] for p in picks], np.float32)
        share = target.mean()
        weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        order = rng.permutation(len(at))
        for lo in range(0, len(order), batch):
            b = order[lo : lo + batch]
            grads = net.gradients(v, every[at[b]], target[b], weight[b])
            step += 1
            for k, g in grads.items():
                at_rows, g = g if isinstance(g, tuple) else (slice(None), g)
                m, s2 = (old[at_rows] for old in moments[k])
                m, s2 = m + 0.1 * (g - m), s2 + 0.01 * (g * g - s2)
                moments[k][0][at_rows], moments[k][1][at_rows] = m, s2
                net.p[k][at_rows] -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-7)
    score = _all_logits(net, v, every)
    top = np.array([score[first[k] : first[k + 1]].max() for k in range(len(docs))])
    net.shift = _threshold(top[held], y[held]) if held.any() and len(set(y[held])) == 2 else _threshold(top, y)
    return net


def _all_logits(net: Network, v: dict, every: np.ndarray) -> np.ndarray:
    table, ends = np.empty((len(v["buckets"]), 6 * HIDDEN), np.float32), v["starts"] + v["counts"]
    for lo in range(0, len(table), 20_000):
        hi = min(lo + 20_000, len(table))
        table[lo:hi] = net.projected(net.inputs(v["buckets"][lo:hi], v["grams"][v["starts"][lo] : ends[hi - 1]], v["counts"][lo:hi]))
    return np.concatenate([net.logits(table, every[k : k + 1024]) for k in range(0, len(every), 1024)])


def _threshold(top: np.ndarray, y: np.ndarray) -> float:
    """Where the share of toxic ones found less eight times that of others flagged is highest; the middle, where a range of logits is."""
    order = np.argsort(top)
    s, t = top[order], y[order]
    gain = np.concatenate([[0], np.cumsum(np.where(t == 1, -1 / max(1, (y == 1).sum()), 8 / max(1, (y == 0).sum())))])
    k = int(np.flatnonzero(gain == gain.max())[0])
    low, high = (s[k - 1] if k else s[0] - 1), (s[k] if k < len(s) else s[-1] + 1)
    return float((low + high) / 2)


def scores(net: Network | None, texts: list[str | None], state: dict) -> list[float]:
    """Scores of whole texts. state keeps the input terms of words from call to call (and starts anew when full)."""
    if net is None:
        return [0.0] * len(texts)
    if len(state.setdefault("rows", {})) > 50_000 or "table" not in state:
        state["rows"], state["table"] = {}, np.zeros((4096, 6 * HIDDEN), np.float32)
    rows, fresh = state["rows"], []

    def row(w):
        rows[w] = len(rows) + 1
        fresh.append(w)
        return rows[w]

    ids = [np.array([rows.get(w) or row(w) for w in words_of(t)], np.int64) for t in texts]
    if fresh:
        x = net.inputs(np.array([word_bucket(w) for w in fresh]), *grams_of(fresh))
        while len(rows) + 1 > len(state["table"]):
            state["table"] = np.concatenate([state["table"], np.zeros_like(state["table"])])
        at = len(rows) + 1 - len(fresh)
        state["table"][at : at + len(fresh)] = net.projected(x)
    out, todo, size = np.full(len(texts), -np.inf), [], 0

    def settle():
        every = np.concatenate([w for _, w in todo])
        of = np.repeat([k for k, _ in todo], [len(w) for _, w in todo])
        np.maximum.at(out, of, net.logits(state["table"], every))

    for short in (False, True):  # texts that need padding go together
        for k, i in enumerate(ids):
            if len(i) and (len(i) < WINDOW) == short:
                w = windows(i)
                for lo in range(0, len(w), 2048):
                    todo.append((k, w[lo : lo + 2048]))
                    size += len(todo[-1][1])
                    if size >= 2048:
                        settle()
                        todo, size = [], 0
        if todo:
            settle()
            todo, size = [], 0
    at = np.log(THRESHOLD / (1 - THRESHOLD))
    return np.where(np.isfinite(out), _sigmoid(out - net.shift + at), 0.0).tolist()


def held_out(doc_id="doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, most: int = 1500, seed: int = 5, characters: int = 12_000_000) -> Network | None:
    """A network from a bounded sample of labelled documents: at most `most` of each label, by hash of the id, held-out rows left out, and of each label as many
    whole texts in that order as have `characters` together (a longer one is passed over). One task learns from this bounded sample; the driver gets the network alone."""
    given = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [given.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # at most 2 * most rows of two numbers
    length = F.coalesce(F.length("text"), F.lit(0))
    fits = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # at most `most` ids a label
    sample = sample.where(length <= characters).withColumn("so_far", F.sum(length).over(fits)).where(F.col("so_far") <= characters)

    def learn(batches):
        import pyarrow as pa

        rows = sorted((d, t or "", y) for batch in batches for d, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        net = train([r[1] for r in rows], [r[2] for r in rows], seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([] if net is None else [pickle.dumps(net)], pa.binary())], names=["net"])
        del rows, net
        released()

    found = sample.select("doc_id", "text", "toxic").repartition(1).mapInArrow(learn, "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else None


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 1500) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.7 on); every row and column stays, but for any named score or predicted, which these replace.

    docs has doc_id and text, labels doc_id and toxic. Whole texts are read, in overlapping windows. Null or empty texts and those
    without a letter score 0. Rows with null ids are scored, not learnt from; repeated rows score alike; of contradictory labels the toxic one holds.
    Without labels of both kinds nothing can be learnt and every score is 0. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train_on(docs, labels, most))
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        state: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = scores(sent.value, part.column(names.index("text")).to_pylist(), state)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=[*names, "score", "predicted"])
        state.clear()
        released()

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)
