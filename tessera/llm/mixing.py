"""Mixing sources to target weights by hash-threshold histograms.

Sources share a budget of words by their weights; none gets more than a
multiple of its own size, and what it would have got beyond goes to the others.
A source whose target is r times its size gives every document floor(r) times.
The rest of its target goes to the documents whose hash lies below a threshold:
words are summed by source and leading hash digit, the digit at which the
running sum passes the budget is the boundary, and only what lies in that
bucket is summed again by the next digit, until a bucket holds few documents.
Those few are taken in hash order as far as they fit, and one more where that
comes nearer to the target.  Thresholds nest: what is taken twice is a part of
what is taken once.  Documents are never sorted, and every source is cut by its
own threshold, so a hot source is summed like any other.

Hashes are made of id, source and text, so reruns agree whatever the
partitioning.  Rows that agree in all three are told apart by a second hash of
their place in the table that is written first; as they are equal, it does not
matter which of them are taken, only how many.

Defined results: a null text has no words; a null source is a source of its
own, the last one; a source without words has target 0; rows that repeat are
documents of their own; of an empty table the mix is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hashes are used to so many bits, in digits of ``MixConfig.digit_bits``.
HASH_BITS = 60


@dataclass(frozen=True)
class MixConfig:
    """Weights go to the sources in order and repeat; ``share`` is of all words, ``most`` of a source's own.

    ``leaf_docs`` bounds what is taken one by one; no document is taken more
    than ``most`` times, rounded up.
    """

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    leaf_docs: int = 1024
    digit_bits: int = 4
    seed: int = 42

    def __post_init__(self) -> None:
        if not self.weights or min(self.weights) <= 0 or self.share < 0 or self.most < 0 or self.leaf_docs < 1:
            raise ValueError("weights must be above 0, shares at least 0, leaf_docs at least 1")
        if HASH_BITS % self.digit_bits:
            raise ValueError(f"digit_bits must divide {HASH_BITS}")


def targets(sources: DataFrame, cfg: MixConfig) -> DataFrame:
    """``sources (k, source, source_size, docs)`` with ``target``: shares by weight, none above ``most`` times its size.

    With sources in order of size by weight, those up to some place are at their
    cap, and the others share what these leave: the end of sharing anew until
    none is above its cap.  The table has a row a source.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cfg.weights]), (number % len(cfg.weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(cfg.most))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "budget": F.sum("source_size").over(every) * float(cfg.share),
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "others": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    s = s.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("others"))
    s = s.withColumn("capped", F.col("ratio") <= F.col("level"))
    open_level = F.min(F.when(~F.col("capped"), F.struct("ratio", "spent", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * open_level)
    return s.select("k", "source", "source_size", "docs", target.alias("target"))


def _digit(level: Column, cfg: MixConfig) -> Column:
    """The hash digit that follows the first ``level`` ones."""
    per = HASH_BITS // cfg.digit_bits
    shift = HASH_BITS - cfg.digit_bits * (level % per + 1)
    word = F.when(level < per, F.col("h1")).otherwise(F.col("h2"))
    return F.call_function("shiftright", word, shift.cast("int")).bitwiseAND(F.lit((1 << cfg.digit_bits) - 1))


def _place(cfg: MixConfig) -> Column:
    """-1, 0 or 1: a row lies below, in or above its source's boundary bucket ``(level, p1, p2)``."""
    per = HASH_BITS // cfg.digit_bits

    def side(word: str, level: Column, prefix: str) -> Column:
        head = F.call_function("shiftright", F.col(word), (HASH_BITS - cfg.digit_bits * level).cast("int"))
        return F.signum((head - F.col(prefix)).cast("double"))

    first = side("h1", F.least(F.col("level"), F.lit(per)), "p1")
    return F.when(first != 0, first).otherwise(side("h2", F.greatest(F.col("level") - per, F.lit(0)), "p2"))


def _refined(rows: DataFrame, states: DataFrame, cfg: MixConfig) -> DataFrame:
    """States whose boundary bucket is the one digit within which the budget is passed."""
    per = HASH_BITS // cfg.digit_bits
    inside = rows.join(states, "k").where(_place(cfg) == 0)
    sums = inside.withColumn("digit", _digit(F.col("level"), cfg)).groupBy("k", "digit").agg(F.sum("size").alias("words"), F.count("*").alias("held"))
    upto = Window.partitionBy("k").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("words").over(upto)).join(states, "k")
    passed = sums.where(F.col("upto") > F.col("left")).groupBy("k").agg(F.min(F.struct("digit", "words", "held", "upto")).alias("b"))
    grown = lambda p: F.col(p) * (1 << cfg.digit_bits) + F.col("b.digit")
    return states.join(passed, "k").select(
        "k", "source_size", "target", "base", (F.col("left") - (F.col("b.upto") - F.col("b.words"))).alias("left"), F.col("b.held").alias("docs"),
        (F.col("level") + 1).alias("level"), F.when(F.col("level") < per, grown("p1")).otherwise(F.col("p1")).alias("p1"),
        F.when(F.col("level") >= per, grown("p2")).otherwise(F.col("p2")).alias("p2"),
    )


def _picks(rows: DataFrame, states: DataFrame, cfg: MixConfig) -> DataFrame:
    """``(k, picks)``: the rows ``h1, h2`` of boundary buckets that are taken, of at most ``leaf_docs`` each."""
    inside = rows.join(states.where("left > 0"), "k").where(_place(cfg) == 0)
    lists = inside.groupBy("k").agg(F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct("h1", "h2", "size"))).alias("l"))
    start = F.struct(F.col("left").alias("room"), F.slice("l", 1, 0).alias("picks"))

    def take(a: Column, x: Column) -> Column:
        fits = F.struct((a["room"] - x["size"]).alias("room"), F.array_append(a["picks"], x).alias("picks"))
        return F.when(x["size"] <= a["room"], fits).otherwise(a)

    folded = lists.withColumn("f", F.aggregate("l", start, take))
    over = lambda x: x["size"] - F.col("f.room")
    beyond = F.filter(F.array_except("l", "f.picks"), lambda x: over(x) < F.col("f.room"))
    nearest = F.array_min(F.transform(beyond, lambda x: F.struct(over(x).alias("over"), x.alias("x"))))["x"]
    picks = F.when(nearest.isNotNull(), F.array_append("f.picks", nearest)).otherwise(F.col("f.picks"))
    return folded.select("k", F.transform(picks, lambda x: F.struct(x["h1"], x["h2"])).alias("picks"))


def mix(
    docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", with_rows: bool = False
) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken)`` for every row of ``docs``.

    ``size`` counts words, ``copies`` is how often the mix takes the document,
    ``taken`` its words times that.  With ``with_rows`` the whole input row
    comes along as the struct ``row``, for ``repeated``.
    """
    source = F.col(source_col).cast("string")
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(cfg.seed), *c), 64 - HASH_BITS)
    rows = docs.select(
        F.col(id_col).alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("k"), size.alias("size"),
        hashed(F.col(id_col), source, F.col(text_col)).alias("h1"), hashed(F.monotonically_increasing_id()).alias("h2"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_rows else []),
    )
    rows = cut(rows, "rows")
    keys = rows.select("k", "size", "h1", "h2")
    sources = cut(rows.groupBy("k").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    states = targets(sources, cfg).withColumn("base", base).select(
        "k", "source_size", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("left"), "docs",
        F.lit(0).alias("level"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"),
    )
    states = cut(states, "states")
    levels = 2 * HASH_BITS // cfg.digit_bits
    wide = (F.col("left") > 0) & (F.col("docs") > cfg.leaf_docs) & (F.col("level") < levels)
    for _ in range(levels):
        if not states.where(wide).take(1):
            break
        states = cut(states.where(~wide).unionByName(_refined(keys, states.where(wide), cfg)), "states")
    plan = cut(states.join(_picks(keys, states, cfg), "k", "left"), "plan")
    place = _place(cfg)
    picked = F.array_contains("picks", F.struct("h1", "h2"))
    # nothing is picked where the rows below the boundary bucket have spent the budget
    more = (place < 0) | ((place == 0) & F.coalesce(picked, F.lit(False)))
    out = rows.join(plan, "k").withColumn("copies", (F.col("base") + more.cast("int")).cast("int"))
    return out.select(
        "id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if with_rows else [])
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself, of ``mix(..., with_rows=True)``: input rows, each as often as it is taken."""
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def most_copies(cfg: MixConfig) -> int:
    """No document is taken more often."""
    return math.ceil(cfg.most)
