"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows.  If a part of a text is
within ``k`` edits of a window of ``w`` characters, both share at least
``w - q + 1 - k * q`` q-grams, on diagonals that differ by at most ``k``.
Shared q-grams are counted in overlapping bands of diagonals for each window;
regions that reach the bound are aligned within the band, and those within the
edit budget are matches.

Texts are compared in lower case (A-Z) with runs of white space as one space,
byte by byte.  The benchmark goes to the tasks in blocks of at most
``block_chars`` characters, each of which is one pass over the texts.  Windows
start every half window, so contiguous copies of about 87 characters or more
are sure to be found, shorter ones where they line up.

Defined results: null, empty and short texts match nothing; items shorter than
a q-gram, empty or null are left out; items that repeat match each on its own;
rows with a null id are reported with a null id, and so are items without one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released
from tessera.llm.textnum import LOWER, SEPARATOR, U64, mix, slices, text_bytes

FILTER_BITS = 20


@dataclass(frozen=True)
class Settings:
    q: int = 12
    window: int = 64
    edit_rate: float = 0.0625

    def budget(self, w: np.ndarray) -> np.ndarray:
        """Edits allowed in windows of ``w`` characters, as many as leave the lemma a bound of 1."""
        return np.minimum((w * self.edit_rate).astype(np.int64), (w - self.q) // self.q)


def normalised(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compared bytes of the texts, their offsets, and each byte's place in ``raw``."""
    gap = SEPARATOR[raw]
    after_gap = np.zeros(len(raw), bool)
    after_gap[1:] = gap[:-1]
    after_gap[at[:-1][np.diff(at) > 0]] = False
    place = np.flatnonzero(~(gap & after_gap))
    out = LOWER[raw[place]]
    out[SEPARATOR[out]] = 32
    return out, np.searchsorted(place, at), place


def grams(raw: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q bytes from every position on; q is 8 to 16, so hashes come from all bytes."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, U64)

    def eight(first: int) -> np.ndarray:
        x = np.zeros(n, U64)
        for j in range(8):
            x |= raw[first + j : first + j + n].astype(U64) << U64(8 * j)
        return x

    return mix(eight(0) * U64(0x9E3779B97F4A7C15) ^ mix(eight(q - 8)))


class Index:
    """Windows of benchmark items and where their q-grams stand."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings = Settings()):
        self.s = settings
        q, step = settings.q, settings.window // 2
        self.item, self.start, self.length, text, at, total = [], [], [], [], [], 0
        gram, window, pos = [], [], []
        for item_id, t in items:
            raw = np.frombuffer(t.encode(), np.uint8)
            raw, _, _ = normalised(raw, np.array([0, len(raw)]))
            if len(raw) and raw[-1] == 32:
                raw = raw[:-1]
            if len(raw) < q:
                continue
            w = min(settings.window, len(raw))
            starts = sorted({*range(0, len(raw) - w + 1, step), len(raw) - w})
            g = grams(raw, q)
            for s in starts:
                gram.append(g[s : s + w - q + 1])
                window.append(np.full(w - q + 1, len(self.item)))
                pos.append(np.arange(w - q + 1))
                self.item.append(item_id)
                self.start.append(s)
                self.length.append(w)
                at.append(total)
                text.append(raw[s : s + w])
                total += w
        self.length = np.array(self.length, np.int64)
        self.at = np.array(at, np.int64)
        self.text = np.concatenate(text) if text else np.zeros(0, np.uint8)
        self.edits = settings.budget(self.length) if len(self.length) else self.length
        self.least = self.length - q + 1 - self.edits * q
        gram = np.concatenate(gram) if gram else np.zeros(0, U64)
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.window = np.concatenate(window)[order] if window else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, np.int64)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.gram >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Matches in texts: ``row, window, start, end, edits``, with byte places in ``raw``."""
        none = np.zeros(0, np.int64)
        if not len(self.gram):
            return dict.fromkeys(("row", "window", "start", "end", "edits"), none)
        text, off, place = normalised(raw, at)
        g = grams(text, self.s.q)
        p = np.flatnonzero(self.maybe[(g >> U64(64 - FILTER_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.gram, g[p]), len(self.gram) - 1)
        hit = self.gram[k] == g[p]
        p, k = p[hit], k[hit]
        row = np.searchsorted(off, p, "right") - 1
        inside = p + self.s.q <= off[row + 1]
        p, k, row = p[inside], k[inside], row[inside]
        n = self.first[k + 1] - self.first[k]
        which = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        window = self.window[which]
        # diagonals count from the earliest that a window can have in its text
        diagonal = np.repeat(p - off[row], n) - self.pos[which] + self.s.window
        width = int(max(1, self.edits.max()))
        band = diagonal // width
        bands = int(np.diff(off).max() // width) + self.s.window // width + 4
        key = (np.repeat(row, n) * len(self.item) + window) * bands + band + 1
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        window = key // bands % len(self.item)
        good = count >= self.least[window]
        key, window = key[good], window[good]
        if not len(key):
            return dict.fromkeys(("row", "window", "start", "end", "edits"), none)
        row, low = key // bands // len(self.item), (key % bands - 1) * width - self.s.window
        first, last, edits = self._align(text, off, row, window, low, width)
        fits = edits <= self.edits[window]
        row, window, first, last, edits = row[fits], window[fits], first[fits], last[fits], edits[fits]
        end = np.append(place, len(raw))[last - 1] + 1
        return {"row": row, "window": window, "start": place[first] if len(place) else first, "end": end, "edits": edits}

    def _align(self, text, off, row, window, low, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of whole windows against parts of texts, over the diagonals of the band and its margins."""
        margin = int(self.edits.max())
        lanes = 2 * width + 2 * margin + 1
        c = np.arange(lanes)
        base = off[row] + low - margin
        big = 1 << 20
        cost = np.zeros((len(row), lanes), np.int64)
        origin = np.broadcast_to(base[:, None] + c, cost.shape).copy()
        outside = (origin < off[row][:, None]) | (origin > off[row + 1][:, None])
        cost[outside] = big
        best = np.full(len(row), big)
        best_start, best_end = np.zeros(len(row), np.int64), np.ones(len(row), np.int64)
        for i in range(int(self.length[window].max()) + 1):
            done = self.length[window] == i
            if done.any():
                k = cost[done].argmin(1)
                r = np.flatnonzero(done)
                best[r], best_start[r], best_end[r] = cost[r, k], origin[r, k], base[r] + i + k
            if i == int(self.length[window].max()):
                break
            t = base[:, None] + i + c
            ok = (t >= off[row][:, None]) & (t < off[row + 1][:, None])
            letter = self.text[np.minimum(self.at[window] + i, len(self.text) - 1)]
            differs = text[np.where(ok, t, 0)] != letter[:, None]
            step = np.where(ok, cost + differs, big)  # both advance
            skip = np.full_like(cost, big)  # the window's letter is missing in the text
            skip[:, :-1] = cost[:, 1:] + 1
            better = skip < step
            new = np.where(better, skip, step)
            start = np.where(better, np.roll(origin, -1, 1), origin)
            # letters of the text that the window lacks: a running minimum along the band
            slid = new - c
            low_ = np.minimum.accumulate(slid, 1)
            from_ = np.maximum.accumulate(np.where(slid == low_, c, 0), 1)
            cost, origin = low_ + c, np.take_along_axis(start, from_, 1)
        return np.clip(best_start, 0, max(0, len(text) - 1)), np.clip(best_end, 1, max(1, len(text))), best


# --------------------------------------------------------------------- Spark


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks: what the driver holds of it at a time is bounded."""
    rows = benchmark.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n):
        yield [(r["id"], r["text"]) for r in rows.where(block == k).orderBy("id", "text").collect()]


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", settings: Settings = Settings(), block_chars: int = 4 << 20,
) -> DataFrame:
    """``(id, item_id, start, end, windows, item_windows, edits)``: each document's contact with each item.

    ``start`` and ``end`` span all matches in code points; ``windows`` of the
    item's ``item_windows`` matched, with ``edits`` at least in all.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        index = Index(items, settings)
        part = rows.mapInArrow(released(_finder(index)), "id long, item_id long, window int, item_windows int, start long, end long, edits int")
        out = part if out is None else out.unionByName(part)
    # by window first: a window that occurs twice in a document counts once
    each = out.groupBy("id", "item_id", "window").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"), F.max("item_windows").alias("item_windows")
    )
    return each.groupBy("id", "item_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("windows"),
        F.max("item_windows").cast("long").alias("item_windows"), F.sum("edits").alias("edits"),
    )


def _finder(index: Index):
    item, item_ids = np.array([-1 if i is None else i for i in index.item], np.int64), pa.array(index.item, pa.int64())
    if len(item):
        new = np.append(True, (item[1:] != item[:-1]) | (np.array(index.start)[1:] == 0))
        group = np.cumsum(new) - 1
        number, of_item = np.arange(len(item)) - np.flatnonzero(new)[group], np.bincount(group)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                raw, at = text_bytes(b.column("text"))
                m = index.find(raw, at)
                if not len(m["row"]):
                    continue
                letters = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                first = letters[at[m["row"]]]
                w = m["window"]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(m["row"])), item_ids.take(pa.array(w)), pa.array(number[w].astype(np.int32)), pa.array(of_item[w].astype(np.int32)),
                     pa.array(letters[m["start"]] - first), pa.array(letters[m["end"]] - first), pa.array(m["edits"].astype(np.int32))],
                    ["id", "item_id", "window", "item_windows", "start", "end", "edits"],
                )

    return run


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    settings: Settings = Settings(), block_chars: int = 4 << 20,
) -> DataFrame:
    """``docs`` without the rows that match any item; all columns stay."""
    text = "__text"
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        index = Index(items, settings)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, text, 1 << 20):
                    keep = np.ones(b.num_rows, bool)
                    keep[index.find(*text_bytes(b.column(text)))["row"]] = False
                    b = b.filter(pa.array(keep))
                    yield b.select([c for c in b.schema.names if c != text])

        docs = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(released(run), docs.schema)
    return docs
