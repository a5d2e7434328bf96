"""A compressed file format for token ids: an adaptive context-mixing range coder.

A file holds the ids of consecutive documents::

    magic, counts         fixed header
    documents             ids and token counts of the documents, deflated
    table                 the ids that occur and their counts, deflated
    lengths, checksums    words and crc32 of every block
    words                 the range coder's output, block after block

The id stream is cut into blocks of equal length.  Every block starts from the
same state and is coded on its own, so a reader can decode any of them alone.
An id is predicted in three orders: by what followed the last two ids, by what
followed the last one, and by the ids' frequencies.  The confidence counters of
both contexts select adaptive weights that mix the three predictions into one
distribution, from which the coder narrows its range once for each id.

All blocks of a file are coded side by side: step i codes the i-th id of each
block in numpy vectors.  Everything is in integers, so files are the same on
every machine.

Defined results: a null or empty text is the end id alone; a null document id
is kept as null and sorts first; rows that share an id follow each other in
the order of their texts; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, shuffle_partitions
from tessera.llm.files import put
from tessera.llm.textnum import gathered
from tessera.llm.tokens import encoder

MAGIC = b"TIDS\x01\0\0\0"
HEADER = struct.Struct("<8sQIIIIII")  # magic, ids, documents, block length, blocks, bytes of documents, of table, spare
NO_ID = -(1 << 63)

BLOCK = 1024
MOST_LANES = 8192
SCALE = 24  # a distribution has 2**SCALE parts
SLOT_BITS = 9  # contexts of a block and order: 2**SLOT_BITS
LEARN = 4  # rate of the weights: the error divided by 2**LEARN
LEAST_BITS = 6
LEAST = 1 << LEAST_BITS  # parts of 2**SCALE that an id of the table has at least

u32, u64, i32 = np.uint32, np.uint64, np.int32


class FileError(ValueError):
    """A token file that is damaged or of another format."""


# ----------------------------------------------------------------- the model


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Cumulative parts of the order-0 distribution over ids that all occur."""
    if not len(counts):
        return np.zeros(1, np.int64)
    free = (1 << SCALE) - LEAST * len(counts)
    share = counts.astype(np.int64) * free // int(counts.sum()) + LEAST
    share[int(np.argmax(share))] += (1 << SCALE) - int(share.sum())
    return np.append(0, np.cumsum(share))


class Mixer:
    """Adaptive state of all blocks: one lane each.

    Symbols are the places of ids in the file's table.  A context's slot holds
    the symbol that followed it, shifted by 3, and a confidence of 0 to 7.
    """

    def __init__(self, lanes: int, table: np.ndarray):
        self.table = table.astype(u64)
        # the symbol at the start of each LEAST parts: a part's own is that or the next
        self.begin = (np.searchsorted(table, np.arange(0, 1 << SCALE, LEAST), "right") - 1).astype(i32)
        lane = np.arange(lanes, dtype=u32)
        self.slot = lane << u32(SLOT_BITS)
        # a lane's weights: 16 of order 2, by its confidence and whether order 1 bears it out, and 8 of order 1
        self.of2, self.of1 = lane * u32(24), lane * u32(24) + u32(16)
        self.seen1 = np.full(lanes << SLOT_BITS, 0xFFFFFFF8, u32)
        self.seen2 = np.full(lanes << SLOT_BITS, 0xFFFFFFF8, u32)
        start = np.array([400, 6000, 16000, 26000, 36000, 44000, 52000, 60000], i32)
        self.weight = np.tile(np.concatenate([np.repeat(start, 2), start // 2]), lanes)
        self.last = np.zeros(lanes, u32)
        self.before = np.zeros(lanes, u32)

    def predict(self) -> None:
        """Find both candidates and the parts that each order gets."""
        h1 = self.last * u32(0x9E3779B1)
        h2 = (h1 ^ (self.before * u32(0x85EBCA77))) * u32(0xC2B2AE3D)
        self.i1 = (self.slot + (h1 >> u32(32 - SLOT_BITS))).astype(np.int64)
        self.i2 = (self.slot + (h2 >> u32(32 - SLOT_BITS))).astype(np.int64)
        self.s1, self.s2 = self.seen1.take(self.i1), self.seen2.take(self.i2)
        self.k1, self.k2 = self.s1 & u32(7), self.s2 & u32(7)
        self.c1, self.c2 = self.s1 >> u32(3), self.s2 >> u32(3)
        same = self.c1 == self.c2
        self.j2 = (self.of2 + ((self.k2 << u32(1)) | same)).astype(np.int64)
        self.j1 = (self.of1 + self.k1).astype(np.int64)
        self.w2, self.w1 = self.weight.take(self.j2), self.weight.take(self.j1)
        # order 0 keeps 1/64 at least, so that every symbol has a part
        p2 = np.minimum(self.w2, i32(63488)).view(u32)
        p1 = np.minimum(((u32(65536) - p2) * self.w1.view(u32)) >> u32(16), u32(64512) - p2) * ~same
        self.part2 = p2 << u32(SCALE - 16)
        self.taken = (p1 + p2) << u32(SCALE - 16)
        self.rest = (u32(1 << SCALE) - self.taken).astype(u64)

    def place(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each symbol's interval starts in the mixed distribution, and its width."""
        at = sym.astype(np.int64)
        self.hit1, self.hit2 = sym == self.c1, sym == self.c2
        by1 = self.hit1 & (self.taken > self.part2)
        by2 = self.hit2 & (self.part2 > 0)
        # multiplied by truth values rather than chosen by them, which numpy does several times slower
        by0 = ~(by1 | by2)
        low = (((self.table.take(at) * self.rest) >> u64(SCALE)).astype(u32) + self.taken) * by0 + self.part2 * by1
        high = (((self.table.take(at + 1) * self.rest) >> u64(SCALE)).astype(u32) + self.taken) * by0 + self.taken * by1 + self.part2 * by2
        return low, high - low

    def find(self, v: np.ndarray) -> np.ndarray:
        """The symbols in whose intervals the points ``v`` lie."""
        by2 = v < self.part2
        by0 = v >= self.taken
        y = (v - self.taken) * by0
        # below 2**49, so that the quotient of floats has the right whole part
        point = ((y.astype(np.float64) + 1.0) * float(1 << SCALE) - 1.0) / self.rest.astype(np.float64)
        point = point.astype(np.int64)
        sym = self.begin.take(point >> LEAST_BITS).astype(np.int64)
        sym += self.table.take(sym + 1).view(np.int64) <= point
        return sym.astype(u32) * by0 + self.c1 * ~(by0 | by2) + self.c2 * by2

    def learn(self, sym: np.ndarray) -> None:
        """Adapt to the symbols that were placed."""
        hit2, hit1 = self.hit2, self.hit1
        self.weight[self.j2] = self.w2 + ((hit2 * i32(65535) - self.w2) >> i32(LEARN))
        # order 1 answers for what order 2 missed
        self.weight[self.j1] = self.w1 + ((hit1 * i32(65535) - self.w1) >> i32(LEARN)) * ~hit2
        for seen, i, c, k, hit in ((self.seen2, self.i2, self.c2, self.k2, hit2), (self.seen1, self.i1, self.c1, self.k1, hit1)):
            # a hit adds to the confidence, a miss halves it and puts the new symbol where it was low
            half = k >> u32(1)
            stays = (half > 0) & ~hit
            trust = half + (np.minimum(k + u32(1), u32(7)) - half) * hit
            seen[i] = ((sym + (c - sym) * stays) << u32(3)) | trust
        self.before, self.last = self.last, sym


# ----------------------------------------------------------------- the coder


def _carry(out: np.ndarray, lanes: np.ndarray, at: np.ndarray) -> None:
    """Add one to a word already out, and to those before it as far as it overflows."""
    while len(lanes):
        out[lanes, at] += u32(1)
        more = out[lanes, at] == 0
        lanes, at = lanes[more], at[more] - 1


def encode_blocks(symbols: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code a (blocks, length) matrix of symbols; gives all words and the blocks' numbers of words."""
    lanes, length = symbols.shape
    model = Mixer(lanes, table)
    out = np.zeros((lanes, length + 8), u32)
    at = np.zeros(lanes, np.int64)
    low = np.zeros(lanes, u64)
    span = np.full(lanes, (1 << 64) - 1, u64)
    steps = np.ascontiguousarray(symbols.T)
    for i in range(length):
        model.predict()
        start, width = model.place(steps[i])
        unit = span >> u64(SCALE)
        was = low
        low = low + unit * start
        span = unit * width
        over = np.flatnonzero(low < was)
        if len(over):
            _carry(out, over, at[over] - 1)
        small = np.flatnonzero(span < u64(1 << 32))
        if len(small):
            out[small, at[small]] = (low[small] >> u64(32)).astype(u32)
            at[small] += 1
            low[small] <<= u64(32)
            span[small] <<= u64(32)
        model.learn(steps[i])
    lane = np.arange(lanes)
    out[lane, at] = (low >> u64(32)).astype(u32)
    out[lane, at + 1] = low.astype(u32)
    at += 2
    return out[np.arange(out.shape[1]) < at[:, None]], at


def decode_blocks(words: np.ndarray, counts: np.ndarray, length: int, table: np.ndarray) -> np.ndarray:
    """The (blocks, length) matrix of symbols from the blocks' words."""
    lanes = len(counts)
    model = Mixer(lanes, table)
    words = np.append(words, np.zeros(2, u32)).astype(u64)
    at = np.cumsum(counts) - counts
    code = (words[at] << u64(32)) | words[at + 1]
    at = at + 2
    span = np.full(lanes, (1 << 64) - 1, u64)
    out = np.zeros((length, lanes), u32)
    top = u64((1 << SCALE) - 1)
    for i in range(length):
        model.predict()
        unit = span >> u64(SCALE)
        symbols = model.find(np.minimum(code // unit, top))
        if int(symbols.max(initial=0)) >= len(table) - 1:
            raise FileError("a symbol beyond the table")
        start, width = model.place(symbols)
        code = code - unit * start
        span = unit * width
        small = np.flatnonzero(span < u64(1 << 32))
        if len(small):
            code[small] = (code[small] << u64(32)) | words[np.minimum(at[small], len(words) - 1)]
            at[small] += 1
            span[small] <<= u64(32)
        model.learn(symbols)
        out[i] = symbols
    return np.ascontiguousarray(out.T)


# ------------------------------------------------------------------ one file


def pack_file(doc_ids: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    total = len(ids)
    block = max(1, min(block, total))
    blocks = -(-total // block)
    padded = np.zeros(blocks * block, u32)
    padded[:total] = ids
    padded[total:] = ids[-1] if total else 0
    counts = np.bincount(padded, minlength=1)
    known = np.flatnonzero(counts)
    counts, symbol_of = counts[known], (np.cumsum(counts > 0) - 1).astype(u32)
    padded = padded.reshape(blocks, block)
    symbols, table = symbol_of[padded], frequencies(counts)
    words, n_words = [], []
    for i in range(0, blocks, MOST_LANES):
        w, n = encode_blocks(symbols[i : i + MOST_LANES], table)
        words.append(w)
        n_words.append(n)
    sums = np.array([zlib.crc32(np.ascontiguousarray(b.astype("<u4"))) for b in padded], "<u4")
    docs = zlib.compress(np.diff(doc_ids.astype("<i8"), prepend=0).astype("<i8").tobytes() + n_tokens.astype("<u8").tobytes(), 1)
    counted = zlib.compress(known.astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 1)
    head = HEADER.pack(MAGIC, total, len(doc_ids), block, blocks, len(docs), len(counted), 0)
    body = [docs, counted]
    if blocks:
        body += [np.concatenate(n_words).astype("<u4").tobytes(), sums.tobytes(), np.concatenate(words).astype("<u4").tobytes()]
    data = head + b"".join(body)
    return data + struct.pack("<I", zlib.crc32(data))


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, token counts and all ids; raises ``FileError`` on any damage."""
    if len(data) < HEADER.size + 4 or data[:8] != MAGIC:
        raise FileError("not a token file")
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise FileError("the file does not match its checksum")
    _, total, n_docs, block, blocks, doc_bytes, table_bytes, _ = HEADER.unpack_from(data)
    at = HEADER.size
    raw = zlib.decompress(data[at : at + doc_bytes])
    doc_ids = np.cumsum(np.frombuffer(raw[: 8 * n_docs], "<i8"))
    n_tokens = np.frombuffer(raw[8 * n_docs :], "<u8").astype(np.int64)
    at += doc_bytes
    known, counts = np.frombuffer(zlib.decompress(data[at : at + table_bytes]), "<u4").reshape(2, -1)
    table = frequencies(counts)
    at += table_bytes
    n_words = np.frombuffer(data, "<u4", blocks, at).astype(np.int64)
    sums = np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    at += 8 * blocks
    words = np.frombuffer(data, "<u4", int(n_words.sum()), at)
    out = np.zeros((blocks, block), u32)
    first = np.append(0, np.cumsum(n_words))
    for i in range(0, blocks, MOST_LANES):
        j = min(blocks, i + MOST_LANES)
        out[i:j] = decode_blocks(words[first[i] : first[j]], n_words[i:j], block, table)
    out = known[out] if total else out
    for k, row in enumerate(out):
        if zlib.crc32(np.ascontiguousarray(row.astype("<u4"))) != sums[k]:
            raise FileError(f"block {k} does not match its checksum")
    if len(n_tokens) != n_docs or int(n_tokens.sum()) != total:
        raise FileError("the documents do not add up to the ids")
    return doc_ids, n_tokens, out.reshape(-1)[:total]


# --------------------------------------------------------------------- Spark


def write_tokens(
    docs: DataFrame,
    out_dir: str,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_tokens: int = BLOCK * MOST_LANES,
) -> DataFrame:
    """Write all documents in id order to ``out_dir/*.tids``; return the manifest.

    Documents are dealt to tasks by ranges of the id; a task closes a file when
    it holds ``file_tokens`` ids.  File names carry the partition and a running
    number, so their order is that of the documents, and a repeated attempt
    writes the same bytes to the same names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, made = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            ids, counts, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"part-{part:06d}-{made:06d}.tids"
            put(f"{out_dir}/{name}", pack_file(ids, counts, tokens))
            held, size, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(tokens)], pa.int64())], ["file", "tokens"])

        for b in gathered(batches, "text", 8 << 20):
            tokens, at = enc.encode(b.column("text"), end_id)
            ids = b.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            held.append((ids, np.diff(at), tokens))
            size += len(tokens)
            if size >= file_tokens:
                yield flush()
        if held:
            yield flush()

    return cut(ranged.mapInArrow(write, "file string, tokens long"), "token_files")


def read_tokens(spark: SparkSession, path: str, starts: dict[str, int] | None = None, with_tokens: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, tokens)`` of every document in the files under ``path``.

    ``starts`` has the number of ids before each file, one entry a file; without
    it, ``start`` counts from the file's first id.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tids").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                ids, counts, tokens = unpack_file(bytes(content))
                raw, end = memoryview(tokens.astype("<u4")).cast("B"), np.cumsum(counts)
                base = (starts or {}).get(name.rpartition("/")[2], 0)
                for i in range(0, len(ids), 4096):
                    some = range(i, min(i + 4096, len(ids)))
                    yield pd.DataFrame({
                        "doc_id": ["" if ids[k] == NO_ID else str(ids[k]) for k in some],
                        "start": [base + int(end[k] - counts[k]) for k in some],
                        "n_tokens": [int(counts[k]) for k in some],
                        "ids_crc32": [zlib.crc32(raw[int(end[k] - counts[k]) * 4 : int(end[k]) * 4]) for k in some],
                        "tokens": [tokens[int(end[k] - counts[k]) : int(end[k])].astype(np.int32) if with_tokens else None for k in some],
                    })

    out = files.mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long, tokens array<int>")
    return out.withColumn("doc_id", F.col("doc_id").try_cast("long"))
