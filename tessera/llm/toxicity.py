"""Toxicity scores by a bidirectional gated recurrent network in numpy.

A word is the sum of what it is (a hashed word vector) and what it is made of
(the mean of hashed vectors of its character trigrams).  Gated recurrent units
read a window of words in both directions; attention pools their states; a
logistic unit gives the window's score.  A document's score is that of its
highest window, over all windows of the whole text, which overlap by half.

Training sees labelled documents only and knows no window labels: after some
rounds over random windows, each round scores the sampled windows, then learns
from the highest window of a toxic document and the highest and a random one of
a clean document.  The sample is
bounded: ``docs_per_label`` documents of each label, picked by a hash of the
id, and ``windows_per_doc`` windows of each.  An id with both labels teaches
both.

Defined results: a null, empty or wordless text is one window without words and
gets the network's score for it; rows without a usable label teach nothing;
with fewer than two labels every score is 0.5, or the only label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, released
from tessera.llm.textnum import LOWER, U64, hash_spans, mix, runs, slices, text_bytes

WINDOW, STEP = 64, 32
WORDS, TRIGRAMS = 1 << 13, 1 << 12
DIM, HIDDEN = 8, 8

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: Rounds of training over random windows, and how many of each document in one.
WARM_ROUNDS, WARM_WINDOWS = 4, 8

f32 = np.float32


# ------------------------------------------------------------------ inputs


def vocabulary(raw: np.ndarray, at: np.ndarray):
    """Distinct words of the texts: their codes and trigram codes, and each occurrence's word and row."""
    raw = LOWER[raw]
    start, end, row = runs(WORD_BYTE[raw], at)
    code = hash_spans(raw, start, end)
    code, first, which = np.unique(code, return_index=True, return_inverse=True)
    start, end = start[first], end[first]
    size = end - start
    total = int(size.sum())
    # a trigram ends at every byte of a word; those before its start count as zeros
    owner = np.repeat(np.arange(len(code)), size)
    inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    p = np.repeat(start, size) + inside
    b0 = raw[p].astype(np.int64)
    b1 = np.where(inside > 0, raw[np.maximum(p - 1, 0)], 0).astype(np.int64)
    b2 = np.where(inside > 1, raw[np.maximum(p - 2, 0)], 0).astype(np.int64)
    tri = (mix((b0 | b1 << 8 | b2 << 16).astype(U64)) % U64(TRIGRAMS)).astype(np.int32)
    return (code % U64(WORDS)).astype(np.int32), tri, owner, which.reshape(-1).astype(np.int32), row


def windows(which: np.ndarray, row: np.ndarray, n_rows: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of word numbers, and their rows; short ones are padded."""
    count = np.bincount(row, minlength=n_rows)
    n = np.maximum(1, -(-(count - WINDOW) // STEP) + 1)
    of = np.repeat(np.arange(n_rows), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    first = np.cumsum(count) - count
    p = (k * STEP)[:, None] + np.arange(WINDOW)
    inside = p < count[of][:, None]
    p = np.where(inside, first[of][:, None] + p, 0)
    words = which[p] if len(which) else np.full(p.shape, pad, np.int32)
    return np.where(inside, words, pad).astype(np.int32), of


# ----------------------------------------------------------------- network


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: rng.normal(scale=scale, size=s).astype(f32)
        self.p = {
            "word": normal(WORDS, DIM, scale=0.3),
            "tri": normal(TRIGRAMS, DIM, scale=0.3),
            "wa": normal(2 * HIDDEN, HIDDEN, scale=0.3),
            "va": normal(HIDDEN, scale=0.3),
            "out": normal(2 * HIDDEN, scale=0.3),
            "bias": np.zeros(1, f32),
        }
        self.slope, self.offset = 1.0, 0.0  # calibration of documents' scores
        for d in "fb":
            self.p["x" + d] = normal(2 * DIM, 3 * HIDDEN, scale=0.3)
            self.p["h" + d] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p["c" + d] = np.zeros(3 * HIDDEN, f32)

    def inputs(self, words, tri, owner) -> np.ndarray:
        """A row for each distinct word: its word vector and the mean of its trigrams."""
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1).astype(f32)
        sums = np.zeros((len(words), DIM), f32)
        if len(owner):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sums[owner[starts]] = np.add.reduceat(self.p["tri"][tri], starts)
        return np.concatenate([self.p["word"][words], sums / n[:, None]], axis=1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What both directions take from each word; the last row is padding, which keeps the state."""
        out = {}
        for d in "fb":
            a = x @ self.p["x" + d] + self.p["c" + d]
            pad = np.zeros((1, 3 * HIDDEN), f32)
            pad[0, :HIDDEN] = 1e4
            out[d] = np.concatenate([a, pad])
        return out

    def forward(self, a: dict[str, np.ndarray], idx: np.ndarray, keep: bool = False):
        """Scores (before the logistic function) of windows; with ``keep`` also what the gradient needs."""
        n, t_max = idx.shape
        pad = len(a["f"]) - 1
        states = np.empty((t_max, n, 2 * HIDDEN), f32)
        steps = {"f": [None] * t_max, "b": [None] * t_max}
        for d, order in (("f", range(t_max)), ("b", range(t_max - 1, -1, -1))):
            u = self.p["h" + d]
            h = np.zeros((n, HIDDEN), f32)
            at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            for t in order:
                x, g = a[d][idx[:, t]], h @ u
                zr = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
                np.negative(zr, out=zr)
                np.clip(zr, -30, 30, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if keep:
                    steps[d][t] = (h, z, r, c, g[:, 2 * HIDDEN :])
                h = new
                states[t, :, at] = h
        e = np.tanh(states.reshape(-1, 2 * HIDDEN) @ self.p["wa"])
        s = (e @ self.p["va"]).reshape(t_max, n)
        s = np.where(idx.T == pad, f32(-1e4), s)
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnk->nk", w, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, steps, e, w, pooled)) if keep else logit

    def gradients(self, words, tri, owner, idx: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted cross-entropy for windows over the given distinct words."""
        p, (n, t_max) = self.p, idx.shape
        x = self.inputs(words, tri, owner)
        a = self.projected(x)
        logit, (states, steps, e, w, pooled) = self.forward(a, idx, keep=True)
        prob = 1 / (1 + np.exp(-logit))
        d_logit = (weight * (prob - y) / weight.sum()).astype(f32)
        g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], f32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_w = np.einsum("nk,tnk->tn", d_pooled, states)
        d_s = w * (d_w - (w * d_w).sum(0))
        d_states = w[:, :, None] * d_pooled
        g["va"] = e.T @ d_s.reshape(-1)
        d_e = d_s.reshape(-1, 1) * p["va"] * (1 - e**2)
        g["wa"] = states.reshape(-1, 2 * HIDDEN).T @ d_e
        d_states += (d_e @ p["wa"].T).reshape(states.shape)
        d_x = np.zeros_like(x)
        for d, order in (("f", range(t_max - 1, -1, -1)), ("b", range(t_max))):
            u = p["h" + d]
            at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            d_h, d_u = np.zeros((n, HIDDEN), f32), np.zeros_like(u)
            d_a = np.empty((t_max, n, 3 * HIDDEN), f32)
            for t in order:
                h, z, r, c, gn = steps[d][t]
                d_h = d_h + d_states[t, :, at]
                d_c = d_h * (1 - z) * (1 - c**2)
                d_z = d_h * (h - c) * z * (1 - z)
                d_r = d_c * gn * r * (1 - r)
                d_a[t] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_u += h.T @ d_g
                d_h = d_h * z + d_g @ u.T
            rows = np.zeros((len(x) + 1, 3 * HIDDEN), f32)
            np.add.at(rows, idx.T.reshape(-1), d_a.reshape(-1, 3 * HIDDEN))
            rows = rows[:-1]
            g["h" + d], g["c" + d], g["x" + d] = d_u, rows.sum(0), x.T @ rows
            d_x += rows @ p["x" + d].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], words, d_x[:, :DIM])
        g["tri"] = np.zeros_like(p["tri"])
        share = np.maximum(np.bincount(owner, minlength=len(words)), 1)[owner]
        np.add.at(g["tri"], tri, d_x[owner, DIM:] / share[:, None].astype(f32))
        return g, prob


def highest(net: Network, raw: np.ndarray, at: np.ndarray, batch: int = 2048) -> np.ndarray:
    """The score of each text: that of its highest window, calibrated."""
    words, tri, owner, which, row = vocabulary(raw, at)
    a = net.projected(net.inputs(words, tri, owner))
    n = len(at) - 1
    best = np.full(n, -np.inf)
    # as many texts at a time as make a few batches of windows
    count = np.bincount(row, minlength=n)
    n_windows = np.maximum(1, -(-(count - WINDOW) // STEP) + 1)
    upto, done, first = np.cumsum(n_windows), 0, np.append(0, np.cumsum(count))
    while done < n:
        before = upto[done - 1] if done else 0
        end = max(done + 1, int(np.searchsorted(upto, before + 4 * batch, "right")))
        part = slice(first[done], first[end])
        idx, of = windows(which[part], row[part] - done, end - done, len(words))
        for i in range(0, len(idx), batch):
            np.maximum.at(best, done + of[i : i + batch], net.forward(a, idx[i : i + batch]))
        done = end
    return 1 / (1 + np.exp(-np.clip(net.slope * best + net.offset, -30, 30)))


def calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, with the targets drawn in a little (Platt)."""
    low, high = 1 / (2 + (y == 0).sum()), 1 - 1 / (2 + (y == 1).sum())
    target = np.where(y == 1, high, low)
    x = np.column_stack([logit, np.ones(len(logit))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - target)))
        w -= step / max(1.0, np.abs(step).max())
    return float(max(w[0], 1e-3)), float(w[1])


# ---------------------------------------------------------------- training


def fit(
    texts: list[list[str]], y: np.ndarray, share: float | None = None, rounds: int = 9, batch: int = 128, rate: float = 0.01, decay: float = 0.01, seed: int = 5
) -> Network:
    """Train on documents given as lists of windows' texts, and their labels.

    A fifth of them is left out of the rounds and calibrates the scores for a
    population with a ``share`` of label 1.
    """
    net = Network(seed)
    rng = np.random.default_rng(seed)
    flat = pa.array([w for doc in texts for w in doc])
    doc_of = np.repeat(np.arange(len(texts)), [len(d) for d in texts])
    words, tri, owner, which, row = vocabulary(*text_bytes(flat))
    idx, of = windows(which, row, len(flat), len(words))
    doc_of = doc_of[of]
    tri_at = np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))
    balance = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum()))).astype(f32)
    held = np.arange(len(y)) % 5 == 4
    mine = np.flatnonzero(~held[doc_of])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def one_of_each() -> np.ndarray:
        other = rng.permutation(mine)
        return other[np.unique(doc_of[other], return_index=True)[1]]

    def all_windows() -> np.ndarray:
        a = net.projected(net.inputs(words, tri, owner))
        return np.concatenate([net.forward(a, idx[i : i + 2048]) for i in range(0, len(idx), 2048)])

    for r in range(rounds):
        if r < WARM_ROUNDS:  # little is known of windows yet: random ones of each document
            pick = np.concatenate([one_of_each() for _ in range(WARM_WINDOWS)])
        else:
            logit = all_windows()[mine]
            order = mine[np.lexsort((logit, doc_of[mine]))]
            top = order[np.append(np.flatnonzero(doc_of[order][1:] != doc_of[order][:-1]), len(order) - 1)]
            other = one_of_each()
            pick = np.concatenate([top, other[y[doc_of[other]] == 0]])
        pick = rng.permutation(pick)
        lr = rate * (1 - 0.9 * r / rounds)
        for i in range(0, len(pick), batch):
            some = pick[i : i + batch]
            seen = np.where(rng.random((len(some), WINDOW)) < 0.1, len(words), idx[some])  # some words are left out
            used, local = np.unique(seen, return_inverse=True)
            local = local.reshape(len(some), WINDOW)
            if used[-1] < len(words):
                used = np.append(used, len(words))
            used = used[:-1]
            size = tri_at[used + 1] - tri_at[used]
            at = np.repeat(tri_at[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            d = doc_of[some]
            g, _ = net.gradients(words[used], tri[at], np.repeat(np.arange(len(used)), size), local, y[d].astype(f32), balance[d])
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] *= 1 - lr * decay
                net.p[k] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(f32)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc_of, all_windows())
    ones = int(y[held].sum())
    if 0 < ones < held.sum():
        share = y.mean() if share is None else share
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        net.slope, net.offset = calibrate(best[held], y[held], weight[held])
    return net


def _sampled_windows(windows_per_doc: int):
    """``(id, y, w)``: the texts of some windows of each document, as the scorer would cut them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, at = text_bytes(b.column("text"))
                raw = LOWER[raw]
                start, end, row = runs(WORD_BYTE[raw], at)
                first = np.searchsorted(row, np.arange(b.num_rows + 1))
                out = []
                for i, doc_id in enumerate(b.column("id").to_pylist()):
                    lo, hi = first[i], first[i + 1]
                    n = max(1, -(-(hi - lo - WINDOW) // STEP) + 1)
                    rng = np.random.default_rng(doc_id & 0xFFFFFFFF)
                    some = range(n) if n <= windows_per_doc else sorted(rng.choice(n, windows_per_doc, replace=False).tolist())
                    cut_at = [(start[lo + k * STEP], end[min(hi, lo + k * STEP + WINDOW) - 1]) for k in some] if hi > lo else [(0, 0)]
                    out.append([raw[p:q].tobytes().decode() for p, q in cut_at])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(out, pa.list_(pa.string()))], ["id", "y", "w"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_label: int = 1500, windows_per_doc: int = 24, **how
) -> Network | float:
    """Fit on the texts of ``docs`` and ``labels (id, y)``; a float is the constant score where there is nothing to learn.

    At most ``docs_per_label`` documents of each label and ``windows_per_doc``
    windows of each reach the driver.  They are picked by their ids alone, so
    that only their texts leave the scan.
    """
    usable = labels.where("y in (0, 1) and id is not null").select(F.col("id").cast("long").alias("id"), F.col("y").cast("int").alias("y")).distinct()
    there = docs.select(F.col(id_col).cast("long").alias("id"))
    usable = cut(usable.join(there, "id", "left_semi"), "usable")
    picks = [usable.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(docs_per_label) for k in (0, 1)]
    ids = cut(picks[0].unionByName(picks[1]), "picked")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # ids has at most two rows for each of 2 * docs_per_label documents
    sample = texts.join(F.broadcast(ids), "id").mapInArrow(released(_sampled_windows(windows_per_doc)), "id long, y int, w array<string>")
    rows = sorted(sample.collect(), key=lambda r: (r["id"], r["y"], r["w"]))
    y = np.array([r["y"] for r in rows], np.int64)
    if not len(y):
        return 0.5
    if y.min() == y.max():
        return float(y[0])
    n = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    return fit([list(r["w"]) for r in rows], y, n[1] / (n[0] + n[1]), **how)


def score(docs: DataFrame, net: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not isinstance(net, Network):
        return rows.select("id", F.lit(float(net)).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(highest(net, *text_bytes(b.column("text"))))], ["id", "score"])

    return rows.mapInArrow(released(run), "id long, score double")
