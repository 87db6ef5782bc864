"""Importance resampling of documents towards a target corpus.

Features are runs of 1 to 3 words, hashed to buckets by CRC-32.  How often a
bucket stands in the corpus and in the target gives its gain; a document's
weight is the sum of its features' gains, and a draw without replacement takes
the highest weights plus Gumbel noise that the document's id alone decides.

A text longer than ``LONG_BYTES`` is cut at word boundaries into chunks of
``CHUNK_BYTES``, which are dealt over all tasks.  A chunk owns the features
that start in it and carries the n - 1 words that follow, so that sums over
chunks are the sums of the text.

No feature becomes a row: CRC-32 is linear, so the CRC of a run follows from
the CRCs and lengths of its words by table lookups over whole arrays.  What a
task sends on is one count per bucket in the first pass, and a few numbers per
text or chunk in the second.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches, task, text_bytes

#: Longest run of words.
RUN = 3
BUCKETS = 10_000
#: Texts beyond this go through chunks; the result is the same.
LONG_BYTES = 1 << 16
CHUNK_BYTES = 1 << 15

#: Lower-cases A-Z; any other ASCII byte than a letter or digit separates words.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def _shift_tables(most: int) -> np.ndarray:
    """[length, byte of the register, its value]: what the CRC register becomes after ``length`` zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = []
    for _ in range(most):
        out.append(now)
        now = (now >> np.uint32(8)) ^ one[now & np.uint32(255)]
    return np.stack(out)


_SHORT = 64
_TABLES = _shift_tables(_SHORT + 1)
_SPACE = zlib.crc32(b" ")


def _lookup(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 255]
    for k in range(1, 4):
        out ^= table[k][(crc >> np.uint32(8 * k)) & 255]
    return out


def crc_shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs (uint32) carried over ``length`` zero bytes each: crc(a + b) = crc_shift(crc(a), len(b)) ^ crc(b)."""
    flat = _TABLES.reshape(-1)
    at = (length % _SHORT).astype(np.int64) * 1024
    out = flat[at + (crc & 255)]
    for k in range(1, 4):
        out ^= flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    rest, table = length // _SHORT, _TABLES[_SHORT]
    while rest.any():  # long words: the rest of the length, bit by bit
        odd = np.flatnonzero(rest & 1)
        out[odd] = _lookup(table, out[odd])
        table = np.stack([_lookup(table, table[k]) for k in range(4)])
        rest = rest >> 1
    return out


def buckets_of(words: list[bytes], part: np.ndarray, own: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to RUN words: (part, bucket) of each run that ``own``s its first word and stays in its part."""
    n = len(words)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    length = np.fromiter(map(len, words), np.int64, n)
    spaced = crc_shift(np.full(n, _SPACE, np.uint32), length) ^ crc  # of the word after a space
    run = crc
    for k in range(RUN):
        if k:
            run = crc_shift(run[:-1], length[k:] + 1) ^ spaced[k:]
        whole = own[: n - k] & (part[: n - k] == part[k:]) if n > k else np.zeros(0, bool)
        yield part[: max(0, n - k)][whole], (run[whole] % np.uint32(buckets)).astype(np.int64)
        if n <= k + 1:
            return


def _words(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of a batch of (piece, carry), the row of each, and whether the row owns it."""
    words, counts, carries = [], [], batch.column("carry").to_numpy()
    for piece in batch.column("piece"):
        got = piece.as_buffer().to_pybytes().translate(_WORDS).split()
        counts.append(len(got))
        words += got
    counts = np.array(counts, np.int64)
    part = np.repeat(np.arange(len(counts)), counts)
    own = np.arange(len(words)) < (np.cumsum(counts) - carries)[part]
    return words, part, own


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of each batch in groups of about ``most`` bytes of text."""
    for batch in batches:
        group = np.concatenate([[0], np.cumsum([len(p.as_buffer() or b"") for p in batch.column("piece")])]) // most
        edges = [0, *(np.flatnonzero(np.diff(group[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _counter(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in _slices(batches):
            for _, bucket in buckets_of(*_words(batch), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def _weigher(gains: np.ndarray, keys: list[str], buckets: int):
    def run(batches):
        for batch in _slices(batches):
            rows = batch.num_rows
            words, part, own = _words(batch)
            weight, features = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for at, bucket in buckets_of(words, part, own, buckets):
                features += np.bincount(at, minlength=rows)
                np.add.at(weight, at, gains[bucket])
            n_words = np.bincount(part[own], minlength=rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n_words), pa.array(features), pa.array(weight)], [*keys, "n_words", "n_features", "weight"])

    return run


def _cut(chunk_bytes: int):
    def carried(text: bytes, at: int) -> list[bytes]:
        """The RUN - 1 words that follow ``at``."""
        got: list[bytes] = []
        while len(got) < RUN - 1 and at < len(text):
            end = text.find(b" ", at)
            end = len(text) if end < 0 else end
            if end > at:
                got.append(text[at:end])
            at = end + 1
        return got

    def run(batches):
        for batch in batches:
            ids, digests = batch.column("id"), batch.column("digest")
            for row, value in enumerate(batch.column("piece")):
                text, at, no = value.as_buffer().to_pybytes().translate(_WORDS), 0, 0
                while no == 0 or at < len(text):
                    end = text.find(b" ", at + chunk_bytes)
                    end = len(text) if end < 0 else end
                    carry = carried(text, end)
                    piece = text[at:end] + b"".join(b" " + w for w in carry)
                    yield pa.RecordBatch.from_arrays([ids.slice(row, 1), digests.slice(row, 1), pa.array([no], pa.int32()), pa.array([piece], pa.binary()), pa.array([len(carry)], pa.int32())], ["id", "digest", "no", "piece", "carry"])
                    at, no = end, no + 1

    return run


class _Pieces:
    """The texts of a table as (piece, carry): short texts whole, long ones as chunks, dealt out and kept in the shared folder."""

    def __init__(self, docs: DataFrame, long_bytes: int, chunk_bytes: int):
        spark = docs.sparkSession
        small_batches(spark)
        long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
        self.short = docs.where(~long).select(F.col("doc_id").alias("id"), text_bytes().alias("piece"), F.lit(0).alias("carry"))
        cut = docs.where(long).select(F.col("doc_id").alias("id"), F.sha2(text_bytes(), 256).alias("digest"), text_bytes().alias("piece"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        cut = cut.mapInArrow(task(_cut(chunk_bytes)), f"id {kind}, digest string, no int, piece binary, carry int")
        # round robin: chunks of one text go to all tasks
        self.chunks = materialize(cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunks")
        self.kind = kind

    def counts(self, buckets: int) -> DataFrame:
        """(bucket, n): how many features stand in each bucket."""
        parts = [p.select("piece", "carry").mapInArrow(task(_counter(buckets)), "bucket long, n long") for p in (self.short, self.chunks)]
        return parts[0].unionAll(parts[1]).groupBy("bucket").agg(F.sum("n").alias("n"))

    def weights(self, gains: np.ndarray, buckets: int) -> DataFrame:
        """(id, n_words, n_features, weight), one row per text."""
        values = "n_words long, n_features long, weight long"
        short = self.short.mapInArrow(task(_weigher(gains, ["id"], buckets)), f"id {self.kind}, {values}")
        # Rows alike in id and text share their chunks' keys: sums are taken over all of them and shared out again.
        keys = ["id", "digest", "no"]
        long = self.chunks.mapInArrow(task(_weigher(gains, keys, buckets)), f"id {self.kind}, digest string, no int, {values}")
        copies = F.count_if(F.col("no") == 0)
        names = ("n_words", "n_features", "weight")
        summed = long.groupBy("id", "digest").agg(copies.alias("copies"), *(F.sum(c).alias(c) for c in names))
        shared = summed.select("id", *(F.expr(f"{c} div copies").alias(c) for c in names), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        return short.unionAll(shared.select("id", *names))


def _gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket, in thousandths; at most ``buckets`` rows reach the driver."""
    count = {}
    for name, df in (("corpus", corpus), ("target", target)):
        count[name] = np.zeros(buckets, np.int64)
        for r in df.collect():
            count[name][r["bucket"]] = r["n"]
    s_all, t_all = (int(count[n].sum()) for n in ("corpus", "target"))
    one = lambda s, t: math.floor(1000 * math.log((float(t + 1) * float(s_all + buckets)) / (float(s + 1) * float(t_all + buckets))))
    return np.array([one(s, t) for s, t in zip(count["corpus"].tolist(), count["target"].tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, the same for equal ids wherever they stand (null: the empty id)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    uniform = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def _ranked(scored: DataFrame, drawn: Column) -> DataFrame:
    """Adds ``place`` from 1: rows for which ``drawn`` holds first, by score downwards, then id (nulls first).

    Ranges of the order are sorted apart; their sizes, one row a range, give each its first place.
    """
    spark = scored.sparkSession
    shared_dir(spark)
    order = [F.col("_out"), F.col("score").desc(), F.col("id").asc_nulls_first()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # checkpoint() keeps each sorted range whole and in order, so a row's number in its range is fixed
    ranged = scored.withColumn("_out", (~drawn).cast("int")).repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()
    at = F.monotonically_increasing_id()
    ranged = ranged.withColumn("_range", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_range", before.alias("_first"))
    return ranged.join(F.broadcast(firsts), "_range").withColumn("place", F.col("_first") + F.col("_at") + 1).drop("_range", "_at", "_first", "_out")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, seed: int = 42, long_bytes: int = LONG_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null unless the row is drawn.

    Of the N rows with at least ``min_words`` words, the floor(percent * N / 100)
    highest scores are drawn.  ``docs`` needs doc_id and text, ``target`` text;
    other columns are not read, so their names are no matter, and the result
    holds the id to join by.

    Null and empty texts have no features, weight 0, and are never drawn while
    ``min_words`` is positive.  A row is a document: repeated rows count, and
    are drawn, each for itself, equal ids with equal noise; ties in score go to
    the smaller id (null first), and rows alike in both are interchangeable.
    An empty target makes every gain that of an unseen bucket; an empty table
    gives an empty table.  Texts of any length are counted whole.
    """
    pieces = _Pieces(docs, long_bytes, chunk_bytes)
    wanted = _Pieces(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), long_bytes, chunk_bytes)
    gains = _gains(pieces.counts(buckets), wanted.counts(buckets), buckets)
    scored = pieces.weights(gains, buckets).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = materialize(scored, "scored")
    enough = F.col("n_words") >= min_words
    n_drawn = percent * scored.where(enough).count() // 100
    placed = _ranked(scored, enough)
    rank = F.when(enough & (F.col("place") <= n_drawn), F.col("place")).cast("long")
    return placed.select(F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score", rank.alias("rank"))
