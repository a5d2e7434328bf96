"""Near-duplicate vectors by a forest of random-projection trees.

Every node of a tree splits by the projection on a random direction at the
median of a sample; vectors near the split go down both sides.  How near is set
by how far the ends of a link can lie apart, so that a split parts few links
whatever the data's spread; a node that would send most of its vectors down
both sides splits no further.  Vectors that meet in a leaf of any tree are
compared by cosine in double precision, so no link is false; a true link is
missed only where every tree parts it.  With the defaults a split parts about
1 in 40 of the links right at the threshold, and fewer above it; ten trees of
six levels then miss fewer than one in a million.

Trees are fitted on at most ``sample_rows`` vectors; every vector is routed
through them.  Equal vectors with equal labels are one vertex with a weight.  A
leaf of more than ``block_rows`` vectors is compared in pairs of blocks, so a
task's rows are bounded.  A pair is counted in the first leaf that it shares,
which both vectors' leaf lists tell, so counts add up without gathering pairs;
links leave a leaf only as stars of its components.

Defined results: a null vector or label, a zero vector and one with null or
non-finite components link with nothing and are their own components; vectors
of different lengths do not link; rows that repeat count as vectors of their
own; a row with a null id has no component, and counts for others only where
a row with an id equals it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.components import components


# ------------------------------------------------------------------- trees


class Tree:
    """A complete binary tree; node k has children 2k+1 and 2k+2.

    A node that doesn't split sends everything to its left child.
    """

    def __init__(self, sample: np.ndarray, depth: int, margin: float, rng: np.random.Generator):
        nodes, d = (1 << depth) - 1, sample.shape[1]
        self.depth, self.margin = depth, margin
        self.direction = rng.normal(size=(nodes, d))
        self.direction /= np.linalg.norm(self.direction, axis=1, keepdims=True)
        self.at, self.splits = np.zeros(nodes), np.ones(nodes, bool)
        here = {0: np.arange(len(sample))}
        for k in range(nodes):
            rows = here.pop(k)
            p = sample[rows] @ self.direction[k]
            self.at[k] = np.median(p) if len(p) else 0.0
            self.splits[k] = len(p) > 1 and (np.abs(p - self.at[k]) <= margin).mean() <= 0.5
            left = p <= self.at[k] if self.splits[k] else np.ones(len(p), bool)
            here[2 * k + 1], here[2 * k + 2] = rows[left], rows[~left]

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf numbers; a row may reach several leaves."""
        rows, leaves = [], []
        stack = [(0, np.arange(len(x)))]
        inner = len(self.at)
        while stack:
            k, r = stack.pop()
            if not len(r):
                continue
            if k >= inner:
                rows.append(r)
                leaves.append(np.full(len(r), k - inner))
                continue
            if not self.splits[k]:
                stack.append((2 * k + 1, r))
                continue
            p = x[r] @ self.direction[k] - self.at[k]
            stack.append((2 * k + 1, r[p <= self.margin]))
            stack.append((2 * k + 2, r[p >= -self.margin]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


# ----------------------------------------------------------------- one leaf


def leaf_links(
    ids: np.ndarray, weight: np.ndarray, x: np.ndarray, leaves: list, leaf: int, side: np.ndarray, cosine: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a link: their positions, link weights first counted here, and components' least ids.

    ``side`` is 0 and 1 for rows of two different blocks, of which only pairs
    across are compared, or 0 for all.
    """
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if side.any() else a
    left, right = [], []
    for i in range(0, len(a), 512):
        g = x[a[i : i + 512]] @ x[b].T
        u, v = np.nonzero(g >= cosine)
        left.append(a[i + u])
        right.append(b[v])
    u, v = np.concatenate(left or [a]), np.concatenate(right or [a])
    apart = u != v if side.any() else u < v
    u, v = u[apart], v[apart]
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    some, pos = np.unique(np.concatenate([u, v]), return_inverse=True)
    pu, pv = pos[: len(u)], pos[len(u) :]
    # leaves that come before this one: pairs that share one are counted there
    before = [[k for k in leaves[i] if k < leaf] for i in some]
    known = {k: c for c, k in enumerate(sorted({k for r in before for k in r}))}
    seen = np.zeros((len(some), max(1, len(known))), np.float32)
    for r, ks in enumerate(before):
        seen[r, [known[k] for k in ks]] = 1
    shared = seen @ seen.T
    first = shared[pu, pv] == 0
    count = np.bincount(pu[first], weight[some][pv[first]], len(some)) + np.bincount(
        pv[first], weight[some][pu[first]], len(some)
    )
    least = ids[some].copy()
    while True:  # labels spread along links until they settle
        new = least.copy()
        np.minimum.at(new, pu, least[pv])
        np.minimum.at(new, pv, least[pu])
        if (new == least).all():
            break
        least = new
    return some, count.astype(np.int64), least


# -------------------------------------------------------------------- Spark


def _prepared(rows: DataFrame) -> DataFrame:
    """``(id, key, x)``: a digest of label and vector, and the unit vector; both null where a row can't link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, units = [], []
            for v, label in zip(b["x"], b["label"], strict=True):
                key = unit = None
                if v is not None and label is not None and len(v):
                    a = np.array([np.nan if c is None else c for c in v], float)
                    if np.isfinite(a).all() and a.any():
                        a = a / np.abs(a).max()  # norms of very large or small vectors stay finite
                        unit = a / math.sqrt(float(a @ a))
                        key = hashlib.blake2b(f"{label}\0".encode() + np.asarray(v, float).tobytes(), digest_size=16).hexdigest()
                keys.append(key)
                units.append(unit)
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "key": keys, "x": units})

    return rows.mapInPandas(run, "id string, label string, key string, x array<double>").withColumn("id", F.col("id").cast("long"))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
    trees: int = 10,
    spill: float = 0.5,
    leaf_rows: int = 1024,
    block_rows: int = 2048,
    sample_rows: int = 16384,
    seed: int = 11,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors go down both sides within ``spill`` times the typical distance of
    a link's ends along a direction.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").cast("string").alias("id"),
        F.col(vector_col).cast("array<double>").alias("x"),
        F.col(label_col).cast("string").alias("label"),
    )
    base = cut(_prepared(rows), "vectors")
    repeated = cut(
        base.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).where("weight > 1"),
        "repeated",
    )
    joined = base.join(repeated, "key", "left").withColumns(
        {"rep": F.coalesce("rep", "id"), "weight": F.coalesce("weight", F.lit(1)).cast("long")}
    )
    members = cut(joined.select("id", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"), "weight"), "members")
    # one row stands for a key, also where the least id occurs twice
    reps = cut(
        joined.where("key is not null and rep is not null and id = rep").dropDuplicates(["rep", "key"])
        .select("rep", "key", "label", "weight", "x", F.size("x").alias("d")),
        "reps",
    )
    shapes = [r["d"] for r in reps.select("d").distinct().collect()]
    parts = []
    for d in shapes:
        own = reps.where(F.col("d") == d)
        n = own.count()
        depth = min(12, max(0, math.ceil(math.log2(n / leaf_rows)))) if n > leaf_rows else 0
        sample = np.array([r["x"] for r in own.orderBy(F.xxhash64("key", F.lit(seed))).limit(sample_rows).select("x").collect()])
        rng = np.random.default_rng(seed)
        margin = spill * math.sqrt(2 - 2 * cosine) / math.sqrt(d)
        forest = [Tree(sample, depth, margin, rng) for _ in range(trees if depth else 1)]
        parts.append(own.mapInPandas(_router(forest, 1 << depth), "rep long, label string, weight long, x array<double>, d int, leaves array<int>"))
    if not parts:
        found = spark.createDataFrame([], "rep long, links long, least long")
    else:
        routed = parts[0]
        for p in parts[1:]:
            routed = routed.unionByName(p)
        found = _compared(cut(routed, "routed"), cosine, block_rows)
    found = cut(found, "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    least = components(found.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    least = least.withColumnRenamed("id", "rep").withColumnRenamed("component_id", "least")
    known = cut(counts.join(least, "rep", "left"), "known")
    out = members.join(known, "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "rep"))
    return out.select(
        "id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _router(forest: list[Tree], leaves_of_tree: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist())
            if not len(x):
                continue
            lists: list[list[int]] = [[] for _ in range(len(x))]
            for t, tree in enumerate(forest):
                for r, leaf in zip(*tree.route(x), strict=True):
                    lists[r].append(t * leaves_of_tree + int(leaf))
            yield b[["rep", "label", "weight", "x", "d"]].assign(leaves=[sorted(s) for s in lists])

    return run


def _compared(routed: DataFrame, cosine: float, block_rows: int) -> DataFrame:
    """``(rep, links, least)`` from every leaf, or pair of blocks of a large leaf."""
    at = ["label", "d", "leaf"]
    spread = routed.withColumn("leaf", F.explode("leaves"))
    sizes = spread.groupBy(*at).count()
    large = cut(sizes.where(F.col("count") > block_rows).withColumn("blocks", F.ceil(F.col("count") / block_rows).cast("int")).drop("count"), "large")
    spread = spread.join(large, at, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = (
        spread.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .withColumn("side", F.when(F.col("lo") == F.col("hi"), 0).otherwise((F.col("block") == F.col("hi")).cast("int")))
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # rows that tie on an id across keys are told apart by position
        rows = rows.sort_values("rep", kind="stable")
        ids = rows["rep"].to_numpy()
        some, links, least = leaf_links(
            ids, rows["weight"].to_numpy(), np.array(rows["x"].tolist()), rows["leaves"].tolist(), int(rows["leaf"].iloc[0]),
            rows["side"].to_numpy(), cosine,
        )
        return pd.DataFrame({"rep": ids[some], "links": links, "least": least})

    grouped = spread.select("label", "d", "leaf", "lo", "hi", "side", "rep", "weight", "x", "leaves")
    return grouped.groupBy("label", "d", "leaf", "lo", "hi").applyInPandas(compare, "rep long, links long, least long")
