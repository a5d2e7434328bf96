"""Passages repeated across documents, by hashed windows at minimisers.

Of all word positions of the texts only minimisers are kept: those whose hashed
``gram`` of words is least in some window of ``min_words`` words.  Frequent
grams come last in the order, so a passage that very many documents share is
anchored apart from what stands around it; a first pass counts grams, and
counts only choose the order, so that noise in them loses nothing.  Equal
windows have equal minimisers, so a window can only repeat in another document
if its least gram does.

For each anchor with a gram of several documents the windows of ``min_words``
words that contain it, and of which it is the least gram, are hashed (64 bits
over 64-bit word hashes); there are at most ``min_words - gram + 1``, and
together they are the anchor's context.  Equal contexts become one row with
their least and greatest document, by a grouped sum that Spark combines before
the shuffle; the contexts of a gram are then compared window by window.  A gram
with more than ``group_rows`` different contexts isn't one group: its windows
are grouped by their own hash.  A word is covered exactly if some window of
``min_words`` words around it is in another document.

Defined results: words are runs of bytes other than space and 9 to 13, compared
as they are; null, empty and short texts have no suffix; passages repeated only
within one document, or between rows of one id, don't count; rows with a null
id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import COUNTERS, counter_of, counter_rows, cut, released, summed
from tessera.llm.textnum import U64, hash_spans, mix, powers, slices, text_bytes, words

ROW_SEED = 0xC2B2AE3D27D4EB4F
ROW_INVERSE = pow(ROW_SEED, -1, 1 << 64)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values, by doubling."""
    f = np.minimum if least else np.maximum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def _grams(code: np.ndarray, gram: int) -> np.ndarray:
    n = len(code)
    h = np.zeros(max(0, n - gram + 1), U64)
    step = powers(ROW_SEED, gram)
    for j in range(gram):
        h += code[j : n - gram + 1 + j] * step[j]
    return mix(h)


def _least(code: np.ndarray, row: np.ndarray, gram: int, span: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams as places in the order, and the least of each window of ``span`` grams; 0 where a window leaves its text."""
    n = len(code)
    h = _grams(code, gram)
    h = (levels[counter_of(h)] << U64(60)) | (h >> U64(4)) | U64(1)
    inside = row[: n - gram - span + 2] == row[gram + span - 2 :]  # windows within one text
    return h, np.where(inside, _sliding(h, span, True), U64(0))


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """0 for counters up to four times the median, then one more for each doubling, 7 at most."""
    usual = max(1.0, 4 * float(np.median(counts)))
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / usual)), 0, 7).astype(U64)


def minimisers(code: np.ndarray, row: np.ndarray, gram: int, span: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected word positions and their gram hashes; ``span`` grams make a window."""
    if len(code) < gram + span - 1:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h, low = _least(code, row, gram, span, levels)
    # a position is selected if it equals the least of a window that it lies in
    padded = np.concatenate([np.zeros(span - 1, U64), low, np.zeros(span - 1, U64)])
    chosen = _sliding(padded, span, False) == h
    again = np.zeros(len(h) + 1, bool)
    again[1:-1] = (h[1:] == h[:-1]) & chosen[:-1] & chosen[1:] & (row[1 : len(h)] == row[: len(h) - 1])
    # of a run of equal grams, the first, the last and one in every span: every window has one of its own
    place = np.arange(len(h))
    first = np.maximum.accumulate(np.where(chosen & ~again[:-1], place, 0))
    at = np.flatnonzero(chosen & (((place - first) % span == 0) | ~again[1:]))
    return at, h[at]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    )


def _counted(gram: int):
    """Counters of the grams of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for b in slices(batch, "text"):
                raw, at = text_bytes(b.column("text"))
                start, end, row = words(raw, at)
                if len(start) < gram:
                    continue
                h = _grams(hash_spans(raw, start, end), gram)
                counts += np.bincount(counter_of(h[row[: len(h)] == row[gram - 1 :]]), minlength=COUNTERS)
        if counts.any():
            yield pa.RecordBatch.from_arrays(list(counter_rows(counts)), ["chunk", "counts"])

    return run


def _anchors(gram: int, span: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, at = text_bytes(b.column("text"))
                start, end, row = words(raw, at)
                pos, g = minimisers(hash_spans(raw, start, end), row, gram, span, levels)
                first = np.searchsorted(row, np.arange(b.num_rows))
                of = row[pos]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), b.column("id").take(pa.array(of)), pa.array((pos - first[of]).astype(np.int32))],
                    ["g", "id", "pos"],
                )

    return run


def _contexts(gram: int, span: int, levels: np.ndarray):
    """``(g, ctx, windows, id, pos, first_id)``: the hashed windows around the listed anchors, and a hash of them all."""
    words_in = gram + span - 1
    salt = mix(np.arange(1, span + 1, dtype=U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                raw, at = text_bytes(b.column("text"))
                start, end, row = words(raw, at)
                code, n = hash_spans(raw, start, end), len(start)
                if n < words_in:
                    continue
                _, low = _least(code, row, gram, span, levels)
                total = np.zeros(n + 1, U64)
                np.cumsum(code * powers(ROW_SEED, n), out=total[1:])
                whole = mix((total[words_in:] - total[:-words_in]) * powers(ROW_INVERSE, n)[: n - words_in + 1]) | U64(1)
                marks = b.column("marks")
                of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(marks.offsets)))
                m = marks.flatten()
                g, pos = np.asarray(m.field("g")), np.asarray(m.field("pos"), np.int64)
                first = np.searchsorted(row, np.arange(b.num_rows))[of]
                s = (first + pos)[:, None] - np.arange(span)[::-1]
                ok = (s >= first[:, None]) & (s < len(low))
                s = np.where(ok, s, 0)
                ok &= low[s] == g.view(U64)[:, None]
                found = np.where(ok, whole[s], U64(0))
                ctx = mix(found ^ salt).sum(1, dtype=U64)
                # the first of equal contexts carries the windows
                again = np.ones(len(g), bool)
                again[np.unique(np.column_stack([g.view(U64), ctx]), axis=0, return_index=True)[1]] = False
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * span), len(found), [None, pa.py_buffer(np.ascontiguousarray(found).tobytes())])
                data = pc.if_else(pa.array(again), pa.nulls(len(g), pa.binary()), data.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(ctx.view(np.int64)), data, b.column("id").take(pa.array(of)), pa.array(pos.astype(np.int32)), m.field("first_id")],
                    ["g", "ctx", "windows", "id", "pos", "first_id"],
                )

    return run


def _hashes(column: pa.Array, span: int) -> np.ndarray:
    """Window hashes, a row for each context."""
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(len(column), span)


def _repeated(span: int):
    """``(g, ctx, lo, hi, a, b)``: the first and last window that several documents have, and two that share one of them."""

    def matches(t: pa.Table) -> pa.RecordBatch:
        g, least, most = (np.asarray(t[c]) for c in ("g", "least", "most"))
        hashes = _hashes(t["windows"], span)
        of, j = np.nonzero(hashes)
        key = hashes[of, j]
        group = np.cumsum(np.append(False, g[1:] != g[:-1]))[of]
        order = np.lexsort((key, group))
        key, group, of, j = key[order], group[order], of[order], j[order]
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))[: len(key)])
        size = np.diff(np.append(starts, len(key)))
        a, b = (np.repeat(f.reduceat(x[of], starts), size) if len(key) else x[of] for f, x in ((np.minimum, least), (np.maximum, most)))
        both = a < b
        of, j, a, b = of[both], j[both], a[both], b[both]
        order = np.lexsort((b, a, of))
        of, j, a, b = of[order], j[order], a[order], b[order]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        lo, hi = (f.reduceat(j, starts) if len(j) else j for f in (np.minimum, np.maximum))
        at = of[starts]
        return pa.RecordBatch.from_arrays(
            [pa.array(g[at]), pa.array(np.asarray(t["ctx"])[at]), pa.array(lo), pa.array(hi), pa.array(a[starts]), pa.array(b[starts])],
            ["g", "ctx", "lo", "hi", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # keep the last group back: it may go on in the next batch
            g = np.asarray(b.column("g"))
            before = np.flatnonzero(g != g[-1])
            if len(before):
                yield matches(pa.Table.from_batches([*held, b.slice(0, int(before[-1]) + 1)]).combine_chunks())
                held = [b.slice(int(before[-1]) + 1)]
            else:
                held.append(b)
        if held:
            yield matches(pa.Table.from_batches(held).combine_chunks())

    return run


def _each_window(span: int):
    """``(g, ctx, least, most, j, w)``: a row for each window of a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = _hashes(b.column("windows"), span)
            of, j = np.nonzero(hashes)
            rows = b.select(["g", "ctx", "least", "most"]).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(j), pa.array(hashes[of, j].view(np.int64))], ["g", "ctx", "least", "most", "j", "w"])

    return run


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, gram: int = 20, group_rows: int = 4000
) -> DataFrame:
    """``(id, start_word, end_word, n_words, other_id, first_id, kept)``: each document's repeated passages.

    ``other_id`` is a document that shares some of the span, ``first_id`` the
    least id that shares a gram of it; a span is ``kept`` in that document.
    """
    span = min_words - gram + 1
    texts = _texts(docs, id_col, text_col)
    levels = frequency_levels(summed(cut(texts.mapInArrow(released(_counted(gram)), "chunk int, counts binary"), "counters")))
    anchors = cut(texts.mapInArrow(released(_anchors(gram, span, levels)), "g long, id long, pos int"), "anchors")
    repeated = cut(
        anchors.groupBy("g").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id").drop("last_id"), "repeated"
    )
    marks = anchors.join(repeated, "g").groupBy("id").agg(F.collect_list(F.struct("g", "pos", "first_id")).alias("marks"))
    around = cut(
        texts.join(cut(marks, "marks"), "id")
        .mapInArrow(released(_contexts(gram, span, levels)), "g long, ctx long, windows binary, id long, pos int, first_id long"),
        "contexts",
    )
    contexts = cut(
        around.groupBy("g", "ctx").agg(F.max("windows").alias("windows"), F.min("id").alias("least"), F.max("id").alias("most")), "distinct"
    )
    large = cut(contexts.groupBy("g").count().where(F.col("count") > group_rows).select("g"), "large")
    names = "g long, ctx long, lo long, hi long, a long, b long"
    some = contexts.join(large, "g", "left_anti").repartition("g").sortWithinPartitions("g").mapInArrow(released(_repeated(span)), names)
    each = contexts.join(large, "g", "left_semi").mapInArrow(_each_window(span), "g long, ctx long, least long, most long, j long, w long")
    several = each.groupBy("g", "w").agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a < b")
    apart = each.join(several, ["g", "w"]).groupBy("g", "ctx").agg(F.min("j").alias("lo"), F.max("j").alias("hi"), F.min(F.struct("a", "b")).alias("ab"))
    shared = cut(some.unionByName(apart.select("g", "ctx", "lo", "hi", "ab.a", "ab.b")), "shared")
    found = around.drop("windows").join(shared, ["g", "ctx"]).select(
        "id", (F.col("pos") - (span - 1) + F.col("lo")).alias("start_word"), (F.col("pos") - (span - 1) + F.col("hi") + min_words).alias("end_word"),
        F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other_id"), "first_id",
    )
    by_doc = Window.partitionBy("id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.coalesce((F.col("start_word") > reach).cast("int"), F.lit(0)))
    island = island.withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy("id", "island").agg(
        F.min("start_word").alias("start_word"),
        F.max("end_word").alias("end_word"),
        F.min("other_id").alias("other_id"),
        F.min("first_id").alias("first_id"),
    )
    return spans.select(
        "id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id", "first_id",
        (F.col("id") == F.col("first_id")).alias("kept"),
    )
