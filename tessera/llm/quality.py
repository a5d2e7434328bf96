"""Quality scores from random Fourier features over document statistics.

Statistics of the whole text are standardised and mapped to random Fourier
features, which approximate a Gaussian kernel (Rahimi and Recht, 2007).  Each
partition sums its part of the normal equations; ridge weights are solved from
the total.  Raw scores are calibrated by isotonic regression (pool adjacent
violators) over bins of scores.

Defined results: a null or empty text has the statistics of an empty text and
gets a score like any other; rows without a usable label (null, or not 0 or 1)
teach nothing; without any labelled row every score is 0.5; if only one label
occurs every score is that label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released
from tessera.llm.textnum import SEPARATOR, hash_spans, per_row, runs, slices, text_bytes, unique_per_row, words

STATISTICS = (
    "log_chars", "log_words", "log_lines", "mean_word", "std_word", "long_words", "upper", "digit", "symbol", "stop",
    "exclaim", "pipe", "space", "non_ascii", "distinct_words", "top_word", "repeated_next", "distinct_lines",
    "mean_line", "plain_words", "words_by_chars", "run_share",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER = _table(bytes(range(65, 91)))
DIGIT = _table(bytes(range(48, 58)))
STOP = _table(b".,;:?'\"()")
LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
SYMBOL = ~(LETTER | DIGIT | STOP | SEPARATOR | _table(b"!|"))


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    share = lambda mask: per_row(mask.astype(np.int64), at) / size
    ws, we, wr = words(raw, at)
    n_words = np.bincount(wr, minlength=n)
    some = np.maximum(n_words, 1).astype(float)
    length = (we - ws).astype(float)
    mean = np.bincount(wr, length, n) / some
    std = np.sqrt(np.maximum(np.bincount(wr, length**2, n) / some - mean**2, 0))
    code = hash_spans(raw, ws, we)
    again = np.zeros(len(code), bool)
    if len(code):
        again[1:] = (code[1:] == code[:-1]) & (wr[1:] == wr[:-1])
    order = np.lexsort((code, wr))
    c, r = code[order], wr[order]
    new = np.ones(len(c), bool)
    if len(c):
        new[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(new)
    top = np.zeros(n)
    if len(starts):
        np.maximum.at(top, r[starts], np.diff(np.append(starts, len(c))))
    ls, le, lr = runs(raw != 10, at)
    n_lines = np.bincount(lr, minlength=n)
    distinct_lines = np.bincount(unique_per_row(hash_spans(raw, ls, le), lr)[1], minlength=n)
    letters = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(LETTER[raw], out=letters[1:])
    plain = letters[np.maximum(we - 1, ws)] - letters[ws] == np.maximum(we - 1 - ws, 0)  # but for a last stop
    same = np.zeros(len(raw), bool)
    if len(raw):
        same[1:] = raw[1:] == raw[:-1]
    return np.column_stack([
        np.log1p(np.diff(at)), np.log1p(n_words), np.log1p(n_lines), mean, std,
        np.bincount(wr, length > 20, n) / some, share(UPPER[raw]), share(DIGIT[raw]), share(SYMBOL[raw]),
        share(STOP[raw]), per_row((raw == 33).astype(np.int64), at) / some, per_row((raw == 124).astype(np.int64), at) / some,
        share(SEPARATOR[raw]), share(raw > 127), np.bincount(r[starts], minlength=n) / some, top / some,
        np.bincount(wr, again, n) / some, distinct_lines / np.maximum(n_lines, 1), np.log1p(size / np.maximum(n_lines, 1)),
        np.bincount(wr, plain, n) / some, n_words / size, share(same),
    ])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)``: a row for each document, with its statistics."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                x = statistics(*text_bytes(b.column("text")))
                flat = pa.array(x.reshape(-1).astype(np.float32))
                at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(at, flat)], ["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(released(stats), "id long, x array<float>")


# ---------------------------------------------------------------------- model


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, increasing
    levels: np.ndarray  # calibrated scores at the knots, not decreasing

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.directions, self.phases) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def fourier(x, mean, scale, directions, phases) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    f = np.cos(z @ directions + phases) * np.sqrt(2.0 / len(phases))
    return np.column_stack([f, np.ones(len(x))])


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression: the non-decreasing fit of ``y``."""
    level, weight, count = [], [], []
    for a, b in zip(y, w, strict=True):
        level.append(a)
        weight.append(b)
        count.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            v, u, c = level.pop(), weight.pop(), count.pop()
            level[-1] = (level[-1] * weight[-1] + v * u) / (weight[-1] + u)
            weight[-1] += u
            count[-1] += c
    return np.repeat(level, count)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(float)


def fit(
    labelled: DataFrame,
    n_features: int = 256,
    bandwidth: float = 4.0,
    ridge: float = 1e-4,
    bins: int = 400,
    calibration_fold: float = 0.25,
    seed: int = 7,
) -> Model | float:
    """Fit on ``(id, x, y)``; a float is the constant score where nothing can be learnt.

    Rows are split by a hash of the id: a share of ``calibration_fold``
    calibrates, the rest gives the weights.  Classes weigh the same in the
    ridge fit.  The driver gets means, a matrix of ``n_features`` squared and
    ``bins`` sums, whatever the number of rows.
    """
    d = len(STATISTICS)
    data = labelled.where("y in (0, 1)").withColumn(
        "calibrates", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < int(calibration_fold * 1000)
    )
    sums = [F.count("*").alias("n"), F.sum("y").alias("ones")]
    for i in range(d):
        x = F.col("x")[i].cast("double")
        sums += [F.sum(x).alias(f"a{i}"), F.sum(x * x).alias(f"b{i}")]
    s = data.agg(*sums).first()
    if not s["n"]:
        return 0.5
    if s["ones"] in (0, s["n"]):
        return float(s["ones"] > 0)
    mean = np.array([s[f"a{i}"] for i in range(d)]) / s["n"]
    scale = np.sqrt(np.maximum(np.array([s[f"b{i}"] for i in range(d)]) / s["n"] - mean**2, 1e-8))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(d, n_features)) / bandwidth
    phases = rng.uniform(0, 2 * np.pi, n_features)
    balance = {0: s["n"] / (2 * (s["n"] - s["ones"])), 1: s["n"] / (2 * s["ones"])}
    m = n_features + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            f = fourier(_matrix(batch), mean, scale, directions, phases)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            w = np.where(y == 1, balance[1], balance[0])
            a += f.T @ (f * w[:, None])
            b += f.T @ (w * (2.0 * y - 1))
        both = np.column_stack([a, b])
        at = pa.array(np.arange(0, both.size + 1, m + 1, dtype=np.int32))
        rows = pa.ListArray.from_arrays(at, pa.array(both.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), rows], ["i", "v"])

    parts = data.where("not calibrates").select("x", F.col("y").cast("int").alias("y")).mapInArrow(released(partial), "i int, v array<double>")
    total = (
        parts.select("i", F.posexplode("v").alias("j", "v"))
        .groupBy("i", "j").agg(F.sum("v").alias("v"))
        .groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("v"))
        .orderBy("i").collect()
    )
    if not total:
        return s["ones"] / s["n"]
    both = np.array([r["v"] for r in total])
    a, b = both[:, :m], both[:, m]
    weights = np.linalg.solve(a + ridge * s["n"] * np.eye(m), b)
    model = Model(mean, scale, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch))
            k = np.clip(np.floor((raw + 2) / 4 * bins), 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    held = (
        data.where("calibrates").select("x", F.col("y").cast("int").alias("y")).mapInArrow(released(binned), "bin int, raw double, y int")
        .groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.sum("y").alias("y"))
        .orderBy("bin").collect()
    )
    n = np.array([r["n"] for r in held], float)
    y = np.array([r["y"] for r in held], float)
    if not len(n):
        knots, levels = np.array([-1.0, 1.0]), np.array([0.0, 1.0])
    else:
        knots = np.array([r["raw"] for r in held])
        levels = pool_adjacent(y / n, n)
        # a slight slope breaks ties between scores on one level
        levels = np.clip(0.999 * levels + 0.001 * np.clip((knots + 2) / 4, 0, 1), 0, 1)
    return Model(mean, scale, directions, phases, weights, knots, levels)


def score(stats: DataFrame, model: Model | float) -> DataFrame:
    """``(id, score)`` for every row of ``(id, x)``."""
    if not isinstance(model, Model):
        return stats.select("id", F.lit(float(model)).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(_matrix(b)))], ["id", "score"])

    return stats.select("id", "x").mapInArrow(released(run), "id long, score double")


def keep(docs: DataFrame, model: Model | float, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``least``."""
    if not isinstance(model, Model):
        return docs.where(F.lit(model >= least))
    text = "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text, 1 << 20):
                good = model.score(statistics(*text_bytes(b.column(text)))) >= least
                yield b.filter(pa.array(good)).select([c for c in b.schema.names if c != text])

    return docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(released(run), docs.schema)
