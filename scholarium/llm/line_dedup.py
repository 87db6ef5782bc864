"""Line dedup over the whole corpus, by a range partition with secondary sort.

Every line becomes (hash of its key, document, position), without its text.
The rows are range-partitioned by hash and document, so that a line which
stands in a third of all documents is spread over many tasks, sorted by hash,
document and position, and written once.  A second pass streams each sorted
part and marks lines; runs that go on in the next part are few (one per part
border) and are counted apart.  What returns to a document is a compressed
bitmap of kept lines, never text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, shared_dir, task

_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _lines(docs: DataFrame, with_id: bool) -> DataFrame:
    lines = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line")
    rows = docs.select(row_key("doc_id", "text").alias("doc"), *([F.col("doc_id").alias("id")] if with_id else []), lines)
    key = line_key(F.col("line"))
    # 96 bits tell keys apart
    return rows.where(key != "").select(
        F.xxhash64(key).alias("h"), F.crc32(key.cast("binary")).alias("h2"), *(["id"] if with_id else []), "doc", F.col("pos").cast("int").alias("pos")
    )


def _marked(policy: str, min_docs: int):
    """Streams a part sorted by (h, h2, doc, pos); yields (doc, pos) of lines to drop.

    'frequent': all lines of a key that stands in at least ``min_docs``
    documents.  'first': all but the first in order of document id and position.
    At most the lines of ``min_docs`` - 1 documents wait at a time.
    """

    def run(batches):
        key = last_doc = None
        docs = 0
        waiting: list[tuple[int, int]] = []
        drop: list[tuple[int, int]] = []

        def flush():
            nonlocal drop
            out = pa.RecordBatch.from_arrays([pa.array([d for d, _ in drop], pa.int64()), pa.array([p for _, p in drop], pa.int32())], ["doc", "pos"])
            drop = []
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "h2", "doc", "pos", "border_docs", "begun")]
            for h, h2, doc, pos, border, begun in zip(*columns, strict=True):
                if (h, h2) != key:
                    key, docs, last_doc, waiting = (h, h2), 0, None, []
                    seen_before = bool(begun)
                if policy == "first":
                    if seen_before or last_doc is not None:
                        drop.append((doc, pos))
                    last_doc = doc
                    continue
                if border is not None:
                    if border >= min_docs:
                        drop.append((doc, pos))
                    continue
                if doc != last_doc:
                    docs, last_doc = docs + 1, doc
                if docs < min_docs:
                    waiting.append((doc, pos))
                else:
                    drop.extend(waiting)
                    waiting = []
                    drop.append((doc, pos))
            if len(drop) > 50_000:
                yield flush()
        yield flush()

    return run


def dropped_lines(docs: DataFrame, policy: str = "frequent", min_docs: int = 10, parts: int | None = None) -> DataFrame:
    """(doc, pos) of each line to drop; ``doc`` is ``row_key`` of the row."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # first occurrences go by document id; how often a key stands does not depend on an order
    first = policy == "first"
    order = ["h", "h2", *(["id"] if first else []), "doc"]
    ranged = _lines(docs, first)
    if first:
        ranged = ranged.dropDuplicates([*order, "pos"])
    ranged = ranged.repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos")
    # checkpoint() keeps each sorted part whole and in order.
    shared_dir(spark)
    ranged = ranged.withColumn("part", F.spark_partition_id()).checkpoint()
    keys = F.struct("h", "h2")
    edges = ranged.groupBy("part").agg(F.min(keys).alias("low"), F.max(keys).alias("high"))
    crossing = edges.select(F.explode(F.array("low", "high")).alias("k"), "part").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first_part")).where("n > 1")
    # At most one key per border between parts: no more rows than parts.
    crossing = F.broadcast(crossing.select("k.h", "k.h2", "first_part"))
    counted = ranged.join(crossing, ["h", "h2"]).select("h", "h2", "doc", "first_part").distinct().groupBy("h", "h2", "first_part").agg(F.count(F.lit(1)).alias("border_docs"))
    rows = ranged.join(F.broadcast(counted), ["h", "h2"], "left").withColumn("begun", F.col("part") > F.col("first_part"))
    return rows.select("h", "h2", "doc", "pos", "border_docs", "begun").mapInArrow(task(_marked(policy, min_docs)), "doc long, pos int")


def bitmap(n_lines: int, dropped) -> bytes:
    """A compressed bitmap with a bit set for each kept line, lowest bit first."""
    bits = np.ones(n_lines, bool)
    if dropped is not None and len(dropped):
        bits[np.asarray(dropped, np.int64)] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines, bitorder="little").astype(bool)


@F.pandas_udf(T.BinaryType())
def _bitmaps(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([bitmap(n, d) for n, d in zip(n_lines, dropped, strict=True)])


@F.pandas_udf(T.StringType())
def apply_bitmap(text: pd.Series, keep: pd.Series) -> pd.Series:
    """Kept lines, joined by newlines."""

    def one(t, k):
        lines = (t or "").split("\n")
        return "\n".join(x for x, ok in zip(lines, unpack(k, len(lines)), strict=True) if ok)

    return pd.Series([one(t, k) for t, k in zip(text, keep, strict=True)])


def keep_bitmaps(docs: DataFrame, policy: str = "frequent", min_docs: int = 10, parts: int | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with n_lines, n_dropped and ``keep``, the compressed bitmap of its kept lines.

    A document is a distinct (doc_id, text); repeated rows count once and share
    a bitmap.  Null or empty text: one empty line, kept.  Lines that are blank
    are never dropped, and ties between documents are no matter: a key goes from
    all of them or from none.  An empty table gives an empty table.  Null ids
    are ids like any other.  Columns of ``docs`` with an output's name are
    replaced, unless ``prefix`` gives the outputs other names.
    """
    n_lines, n_dropped, keep = (f"{prefix}{c}" for c in ("n_lines", "n_dropped", "keep"))
    docs = docs.drop(n_lines, n_dropped, keep)
    found = dropped_lines(docs.select("doc_id", "text"), policy, min_docs, parts).groupBy(F.col("doc").alias("_ld_doc")).agg(F.collect_set("pos").alias("_ld_pos"))
    lines = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("long")
    joined = docs.withColumn("_ld_key", row_key("doc_id", "text")).join(found, F.col("_ld_key") == F.col("_ld_doc"), "left")
    return (
        joined.withColumn(n_lines, lines)
        .withColumn(n_dropped, F.when(F.col("_ld_pos").isNull(), F.lit(0)).otherwise(F.size("_ld_pos")).cast("long"))
        .withColumn(keep, _bitmaps(n_lines, "_ld_pos"))
        .drop("_ld_key", "_ld_doc", "_ld_pos")
    )


def line_dedup(docs: DataFrame, policy: str = "frequent", min_docs: int = 10) -> DataFrame:
    """``docs`` with the text of its kept lines (null text stays null); rows and all other columns stay, whatever their names."""
    names = docs.columns
    out = keep_bitmaps(docs, policy, min_docs, prefix="_ld_")
    text = F.when(F.col("_ld_n_dropped") > 0, apply_bitmap("text", "_ld_keep")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*names)
