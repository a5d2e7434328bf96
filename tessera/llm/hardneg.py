"""Hard negatives by bit-sliced integer products.

Vectors are whole numbers.  An anchor's score of a row is their inner product,
summed from the row's bit-planes, most significant first: after every plane the
planes still to come can add no more than the anchor's positive components and
take off no more than its negative ones, each times the planes' weight, so the
score lies in an interval that halves with every plane.  Rows whose interval
cannot reach what an anchor still looks for are dropped; at first all rows of a
block are carried along, later only the pairs that are left.  What an anchor
looks for narrows as well, since from every block it keeps its best few.

Anchors and rows meet in cells of bounded size on both sides, dealt by row
number, so no label, copy or id makes a hot cell; each cell gives at most the
best few of every anchor, and windows merge the cells.  First every anchor's
best rows of its own label are found, among rows of that label alone, then for
each of these the best rows of other labels within the allowed share of its
score.

Defined results: a row takes no part if its id, label or vector is null, or if
a component is null, not finite or beyond ``LIMIT`` in size (scores would not
fit); vectors of different lengths do not meet; rows that repeat, also with
the same id, are rows of their own, and every anchor row is an anchor; of rows
that tie in score the smaller id comes first; no anchor or no partner gives no
rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, shuffle_partitions

#: Whole components lie below this, so that products of 2^14 of them fit in a long with room.
LIMIT = 1 << 22
#: Pairs that are scored in one go, and the share of them at which only what is left is carried on.
ANCHORS_AT_A_TIME, ROWS_AT_A_TIME, SPARSE = 256, 4096, 0.125
NEVER = np.iinfo(np.int64).min // 4


def type_of(bound: int) -> type:
    """The narrowest type in which whole numbers up to ``bound`` are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def planes(v: np.ndarray) -> list[np.ndarray]:
    """Bit-planes of whole numbers in two's complement, least significant first; the last one counts negatively."""
    top = int(max(v.max(initial=0), ~v.min(initial=0)))
    return [((v >> b) & 1) for b in range(top.bit_length() + 1)]


def within(q: np.ndarray, v: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``(anchor, row, score)`` whose product lies in the anchor's ``least..most``."""
    bits = planes(v)
    d = q.shape[1]
    size = int(np.abs(q).max(initial=0)) * max(1, d)
    kind = type_of(size) if size < 1 << 53 else np.float64
    total = type_of(size << len(bits))
    qs, up, down = q.astype(kind), np.maximum(q, 0).sum(1), np.minimum(q, 0).sum(1)
    score = np.zeros((len(q), len(v)), total)
    pair: tuple[np.ndarray, np.ndarray] | None = None
    for b in range(len(bits) - 1, -1, -1):
        weight, slack = (-1 if b == len(bits) - 1 else 1) << b, (1 << b) - 1
        plane = bits[b].astype(kind)
        floor, roof = least - slack * up, most - slack * down
        if pair is None:
            part = qs @ plane.T
            part *= weight
            score += part if part.dtype == total else part.astype(total)
            # narrow bounds may lie far outside of the scores' type
            alive = (score >= np.clip(floor, NEVER, -NEVER)[:, None]) & (score <= np.clip(roof, NEVER, -NEVER)[:, None])
            if b == 0 or np.count_nonzero(alive) < SPARSE * alive.size:
                pair = np.nonzero(alive)
                score = score[pair].astype(np.int64)
        else:
            i, j = pair
            for k in range(0, len(i), 1 << 18):
                score[k : k + (1 << 18)] += weight * np.einsum("pd,pd->p", qs[i[k : k + (1 << 18)]], plane[j[k : k + (1 << 18)]]).astype(np.int64)
            left = (score >= floor[i]) & (score <= roof[i])
            pair, score = (i[left], j[left]), score[left]
    return pair[0], pair[1], score


class Best:
    """The best ``k`` rows of every query; a query is an anchor and one of its ranges."""

    def __init__(self, least: np.ndarray, most: np.ndarray, k: int):
        self.least, self.most, self.k = least, most, k
        self.query, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = least.copy()

    def add(self, first: int, i: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take scored rows of the anchors from ``first`` on, and raise what a row must reach."""
        p = self.least.shape[1]
        new = [(self.query, self.score, self.id, self.row)]
        for r in range(p):
            fits = (score >= self.floor[first + i, r]) & (score <= self.most[first + i, r])
            new.append(((first + i[fits]) * p + r, score[fits], ids[fits], rows[fits]))
        query, score, ids, rows = (np.concatenate(x) for x in zip(*new, strict=True))
        order = np.lexsort((rows, ids, -score, query))
        query, score, ids, rows = query[order], score[order], ids[order], rows[order]
        start = np.searchsorted(query, query)
        rank = np.arange(len(query)) - start
        kept = rank < self.k
        last = query[rank == self.k - 1]
        self.floor.reshape(-1)[last] = score[rank == self.k - 1]
        self.query, self.score, self.id, self.row = query[kept], score[kept], ids[kept], rows[kept]


def search(q: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, apart) -> Best:
    """The best ``k`` of the rows ``v`` for each range ``least..most`` of each anchor.

    ``apart(i, j)`` tells which pairs of an anchor and a row may meet.
    """
    best = Best(least, most, k)
    at, size = 0, 256
    while at < len(v):  # small blocks first: they tell what later ones must reach
        block = slice(at, at + size)
        for first in range(0, len(q), ANCHORS_AT_A_TIME):
            some = slice(first, first + ANCHORS_AT_A_TIME)
            i, j, score = within(q[some], v[block], best.floor[some].min(1), most[some].max(1))
            meets = apart(first + i, at + j)
            i, j, score = i[meets], j[meets], score[meets]
            best.add(first, i, score, ids[at + j], rows[at + j])
        at, size = at + size, min(4 * size, ROWS_AT_A_TIME)
    return best


# -------------------------------------------------------------------- Spark


@dataclass(frozen=True)
class HardConfig:
    """Counts of positives and negatives, and the shares of the positive's score, in per cent, that a negative may have."""

    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90
    scale: float = 256.0
    anchor_rows: int = 8192
    cell_rows: int = 32768


def whole(vectors: DataFrame, anchor: Column, cfg: HardConfig, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(row, id, label, d, v, anchor)`` of the rows that take part."""
    usable = F.forall("x", lambda c: c.isNotNull() & (F.abs(F.floor(c * cfg.scale)) < LIMIT) & ~F.isnan(c) & (F.abs(c) < math.inf))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "label", F.size("x").alias("d"), F.transform("x", lambda c: F.floor(c * cfg.scale).cast("int")).alias("v"), "anchor"
    )


def _cells(anchors: DataFrame, rows: DataFrame, keys: list[str], cfg: HardConfig) -> tuple[DataFrame, DataFrame]:
    """Both sides with their cells ``a, c``: every anchor meets every row of its keys in exactly one."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n")).join(anchors.groupBy(*keys).agg(F.count("*").alias("__m")), keys)
    share = F.col("__n") / (2.0 * shuffle_partitions(rows.sparkSession))  # small tables are dealt to all cores
    n = n.select(
        *keys, F.ceil(F.col("__m") / cfg.anchor_rows).cast("int").alias("__a"),
        F.ceil(F.col("__n") / F.least(F.greatest(share, F.lit(2048.0)), F.lit(float(cfg.cell_rows)))).cast("int").alias("__c"),
    )
    n = cut(n, "cells")
    deal = lambda name, many, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(many)).cast("int").alias(name)
    every = lambda name, many: F.explode(F.sequence(F.lit(0), F.col(many) - 1)).alias(name)
    # new names for both sides' columns, which come from one table
    left = anchors.join(n, keys).select(*[F.col(c).alias(c) for c in anchors.columns], deal("a", "__a", 1), every("c", "__c"))
    right = rows.join(n, keys).select(*rows.columns, deal("c", "__c", 2), every("a", "__a"))
    return left, right


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(t), -1) if len(t) else np.zeros((0, 0), np.int64)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _positives(anchors: DataFrame, rows: DataFrame, cfg: HardConfig) -> DataFrame:
    """``(anchor_row, positives)``: the best other rows of each anchor's label, best first."""
    k = cfg.positives

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = _matrix(left), _matrix(right)
        a, r = _numbers(left, "row"), _numbers(right, "row")
        whole_range = np.full((len(a), 1), NEVER), np.full((len(a), 1), -NEVER)
        best = search(q.reshape(len(a), -1), *whole_range, k, v.reshape(len(r), -1), _numbers(right, "id"), r, lambda i, j: a[i] != r[j])
        return pa.table({"anchor_row": a[best.query], "id": best.id, "score": best.score, "row": best.row})

    keys = ["d", "label"]
    left, right = _cells(anchors.select("row", "d", "label", "v"), rows.select("row", "id", "d", "label", "v"), keys, cfg)
    found = left.groupBy(*keys, "a", "c").cogroup(right.groupBy(*keys, "a", "c")).applyInArrow(run, "anchor_row long, id long, score long, row long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))


def share(score: np.ndarray, per_cent: int, up: bool) -> np.ndarray:
    """``per_cent`` of whole scores, rounded up or down, without overflow."""
    s = -score if up else score
    part = per_cent * (s // 100) + (per_cent * (s % 100)) // 100
    return -part if up else part


def hard_negatives(
    vectors: DataFrame, anchor: Column, cfg: HardConfig = HardConfig(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` is a condition on the rows of ``vectors``.  Components become
    ``floor(scale * x)``; negatives are rows of other labels whose score lies
    between the two shares of the positive's.
    """
    rows = cut(whole(vectors, anchor, cfg, id_col, vector_col, label_col), "rows")
    anchors = rows.where("anchor")
    with_positives = cut(_positives(anchors, rows, cfg).withColumnRenamed("anchor_row", "row").join(anchors, "row"), "anchors")
    k = cfg.negatives

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r = _numbers(left, "row"), _numbers(right, "row")
        q, v = _matrix(left).reshape(len(a), -1), _matrix(right).reshape(len(r), -1)
        known = left.column("positives").combine_chunks()
        n = np.diff(np.asarray(known.offsets)) if len(a) else np.zeros(0, np.int64)
        flat = known.flatten()
        at = np.repeat(np.arange(len(a)), n), flat.field("rank").to_numpy().astype(np.int64) - 1
        ids, scores = flat.field("id").to_numpy(), flat.field("score").to_numpy()
        # places without a positive ask for nothing
        least, most = np.full((len(a), cfg.positives), -NEVER), np.full((len(a), cfg.positives), NEVER)
        least[at], most[at] = share(scores, cfg.least, True), share(scores, cfg.most, False)
        pid, ps = np.zeros(least.shape, np.int64), np.zeros(least.shape, np.int64)
        pid[at], ps[at] = ids, scores
        label, other = left.column("label").to_pandas().to_numpy(), right.column("label").to_pandas().to_numpy()
        code = {s: i for i, s in enumerate(dict.fromkeys([*label, *other]))}
        label, other = np.array([code[s] for s in label], np.int64), np.array([code[s] for s in other], np.int64)
        best = search(q, least, most, k, v, _numbers(right, "id"), r, lambda i, j: label[i] != other[j])
        i, p = best.query // cfg.positives, best.query % cfg.positives
        return pa.table({
            "anchor_row": a[i], "place": p, "anchor_id": _numbers(left, "id")[i], "positive_id": pid[i, p], "positive_score": ps[i, p],
            "negative_id": best.id, "negative_score": best.score, "row": best.row,
        })

    left, right = _cells(with_positives.select("row", "id", "d", "label", "v", "positives"), rows.select("row", "id", "d", "label", "v"), ["d"], cfg)
    schema = "anchor_row long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, row long"
    found = left.groupBy("d", "a", "c").cogroup(right.groupBy("d", "a", "c")).applyInArrow(run, schema)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id", "row")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
