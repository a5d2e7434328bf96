"""Class-aware split of images into training, validation and test parts."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SplitConfig:
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    priority: tuple[int, ...] = ()
    priority_weight: float = 3.0
    seed: int = 42

    def __post_init__(self):
        if abs(sum(self.ratios) - 1) > 1e-6:
            raise ValueError("ratios must add up to 1")
        if self.priority_weight < 1:
            raise ValueError("priority_weight must be at least 1")


def profiles(labels: DataFrame) -> DataFrame:
    """``image, class_id, n`` from label rows."""
    return labels.groupBy("image", "class_id").agg(F.count("*").alias("n"))


def capacities(n: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """Images for each split by largest remainder, from one column ``n``; ties go in split order."""
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("split"), (F.col("n") * r).alias("exact")) for i, (s, r) in enumerate(zip(SPLITS, ratios, strict=True))])
    base = F.transform(parts, lambda p: F.struct((F.floor(p["exact"]) - p["exact"]).alias("rest"), p["i"].alias("i"), p["split"].alias("split"), F.floor(p["exact"]).alias("low")))
    spare = F.col("n") - F.aggregate(base, F.lit(0).cast("long"), lambda a, p: a + p["low"])
    ranked = F.transform(F.array_sort(base), lambda p, k: F.struct(p["split"].alias("split"), (p["low"] + (k < spare).cast("long")).alias("capacity")))
    return n.select("n", F.inline(ranked))


def targets(profile: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """``class_id, total`` and the wanted count of each split."""
    totals = profile.groupBy("class_id").agg(F.sum("n").alias("total"))
    return totals.select("class_id", "total", *[(F.col("total") * r).alias(s) for s, r in zip(SPLITS, ratios, strict=True)])


def deficit(target: Column, current: Column, count: Column, weight: Column) -> Column:
    """How much a class of an image lessens a split's deficit."""
    return weight * F.least(target - current, count)


def scores(profile: DataFrame, wanted: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Score of each image for each empty split: ``image, split, score``."""
    weight = F.when(F.col("class_id").isin(*cfg.priority), cfg.priority_weight).otherwise(1.0) if cfg.priority else F.lit(1.0)
    long = wanted.select("class_id", F.explode(F.create_map(*[c for s in SPLITS for c in (F.lit(s), F.col(s))])).alias("split", "target"))
    return profile.join(long, "class_id").groupBy("image", "split").agg(
        F.sum(deficit(F.col("target"), F.lit(0.0), F.col("n").cast("double"), weight)).alias("score")
    )


def assign(images: DataFrame, profile: DataFrame, cfg: SplitConfig = SplitConfig(), ties: str = "random") -> DataFrame:
    """``image, split``: greedy assignment in order of priority content, then name.

    Each image goes to the split with room that its classes lack most.  Every
    choice depends on all before it, so one task makes them, in an order that
    Spark sorts (on disk where needed); it reads names and class counts batch
    by batch and holds only a count for each class and split.  Ties are drawn
    by CPython's ``random.Random(seed)``, once for every image, or go to the
    first split.
    """
    names = images.select("image").distinct()
    first = F.sum(F.when(F.col("class_id").isin(*cfg.priority), F.col("n")).otherwise(0)) if cfg.priority else F.lit(0)
    counts = profile.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("class_id", "n"))).alias("p"), first.alias("first"))
    each = names.join(counts, "image", "left").select("image", "p", F.coalesce("first", F.lit(0)).alias("first"))
    n = names.count()
    total = {r["class_id"]: r["n"] for r in profile.join(names, "image", "left_semi").groupBy("class_id").agg(F.sum("n").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = _chooser(n, total, cfg, ties)
        for b in batches:
            image = b.column("image")
            out = [choose({q["class_id"]: q["n"] for q in p or []}) for p in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([image.cast(pa.string()), pa.array(out, pa.string())], ["image", "split"])

    return each.repartition(1).sortWithinPartitions(F.desc("first"), "image").select("image", "p").mapInArrow(run, "image string, split string")


def _chooser(n: int, total: dict[int, int], cfg: SplitConfig, ties: str) -> Callable[[dict[int, int]], str]:
    """The greedy rule over ``n`` images with these class totals, called once for each image in order."""
    exact = [n * r for r in cfg.ratios]
    room = [int(e) for e in exact]
    for i in sorted(range(3), key=lambda i: int(exact[i]) - exact[i])[: n - sum(room)]:
        room[i] += 1
    have = [dict.fromkeys(total, 0) for _ in SPLITS]
    rng = random.Random(cfg.seed)
    weight = lambda c: cfg.priority_weight if c in cfg.priority else 1.0

    def choose(found: dict[int, int]) -> str:
        open_ = [i for i in range(3) if room[i] > 0]
        value = {i: sum(weight(c) * min(total[c] * cfg.ratios[i] - have[i][c], k) for c, k in found.items()) for i in open_}
        best = [i for i in open_ if value[i] == max(value.values())]
        k = rng.choice(best) if ties == "random" else best[0]
        room[k] -= 1
        for c, m in found.items():
            have[k][c] += m
        return SPLITS[k]

    return choose


def greedy(found: dict[str, dict[int, int]], cfg: SplitConfig, ties: str) -> dict[str, str]:
    names = sorted(found)
    names.sort(key=lambda s: -sum(found[s].get(c, 0) for c in cfg.priority))
    total: dict[int, int] = {}
    for p in found.values():
        for c, n in p.items():
            total[c] = total.get(c, 0) + n
    choose = _chooser(len(names), total, cfg, ties)
    return {name: choose(found[name]) for name in names}


def distribution(profile: DataFrame, assigned: DataFrame) -> DataFrame:
    """Objects by class and split, 0 where there are none."""
    return profile.join(assigned, "image").groupBy("class_id").pivot("split", list(SPLITS)).agg(F.sum("n")).na.fill(0)
