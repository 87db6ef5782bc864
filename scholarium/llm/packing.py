"""Packing token ids into sequences of a fixed window, by best-fit decreasing.

Documents become token ids followed by an end id.  A document longer than the
window is first cut into full windows, which are sequences of their own; the
rest of each document joins a block, chosen by a hash of its id, and each block
is packed by itself: pieces from long to short, each into the open window with
the least room that still holds it.  A segment tree indexed by remaining room
finds that window in log2(window) steps.  The number of blocks follows the
corpus, so a block stays small at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import row_key, small_batches, task

WINDOW = 1024
END_ID = 0
#: UTF-8 bytes of text that a block should hold.
BLOCK_BYTES = 16 << 20
#: Bytes of ids that a batch of packed pieces holds at most.
OUT_BYTES = 4 << 20


class RoomTree:
    """Counts of open windows by remaining room; finds the least room of at least ``need``."""

    def __init__(self, window: int):
        self.size = 1 << math.ceil(math.log2(window + 1))
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest window, removed from the tree."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.open[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; sequences are numbered from 0.  Equal lengths keep their order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = RoomTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, opened = (window, opened), opened + 1
        room, s = found
        sequence[i], offset[i] = s, window - room
        if room > need:
            tree.add(room - need, s)
    return sequence, offset


def padded_length(used: int, window: int = WINDOW) -> int:
    """Sequences are padded to the window, except where they end at a power of two."""
    return used if used and used & (used - 1) == 0 else window


def pieces(docs: DataFrame, blocks: int, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Token ids of all documents in pieces of at most ``window``, 16 bits an id, with a block for each piece."""
    path = ranks_path or vocab.default_path("byte_bpe_50k.tiktoken")
    source = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))
    names = ["doc_id", "start", "length", "doc_tokens", "block", "ids"]

    def run(batches):
        bpe = vocab.byte_bpe(path)

        def rows(batch):
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(bpe.ids(text), END_ID).astype(bpe.dtype)
                n = len(ids)
                for k in range(0, n, window):
                    part = ids[k : k + window]
                    block = (key if len(part) < window else key + 1 + k // window) % blocks
                    yield doc, k, len(part), n, block, part.tobytes()

        try:
            for batch in batches:
                held, size = [], 0
                for row in rows(batch):
                    held.append(row)
                    size += len(row[-1])
                    if size > 4 << 20:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)
        finally:
            del bpe
            vocab.release()

    def _batch(held):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)

    return source.mapInArrow(task(run), "doc_id long, start long, length long, doc_tokens long, block int, ids binary")


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def pack(docs: DataFrame, ranks_path: str | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, padded, ids (little-endian unsigned 32-bit numbers).

    Null or empty text: the end id alone.  Repeated rows and null ids are
    packed like others, once per row.  sequence_id is unique over the corpus;
    offsets in a sequence are gapless from 0.
    """
    small_batches(docs.sparkSession)
    blocks = block_count(docs, block_bytes)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded", "ids"]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        # Order by content, so that a repeated task makes the same sequences.
        order = pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        lengths = table.column("length").take(order).to_numpy()
        sequence, offset = best_fit_decreasing(lengths, window)
        used = np.bincount(sequence, lengths).astype(np.int64)
        number = table.column("block")[0].as_py()
        padded = np.array([padded_length(int(u), window) for u in used], np.int64)[sequence]
        step = max(1, OUT_BYTES // (4 * window))
        for at in range(0, len(lengths), step):  # the block is held once; what goes out is made part by part
            part, own = table.take(order.slice(at, step)), slice(at, at + step)
            ids = [np.frombuffer(x, np.uint32 if len(x) > 2 * n else np.uint16).astype("<u4").tobytes() for x, n in zip(part.column("ids").to_pylist(), lengths[own], strict=True)]
            columns = [*(part.column(c) for c in names[:4]), sequence[own] * blocks + number, offset[own], padded[own], pa.array(ids, pa.binary())]
            yield from pa.table(dict(zip(names, columns, strict=True))).to_batches()

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded long, ids binary"
    return pieces(docs, blocks, ranks_path, window).groupBy("block").applyInArrow(task(block), schema)
