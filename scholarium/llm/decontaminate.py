"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A first pass over the documents counts, for each n-gram of a test item, the
documents that hold it.  An item's seeds are its rare n-grams: those not much
more frequent than its rarest quarter, or seldom in the whole corpus.  A second
pass cuts the surroundings of seeds into passages of bounded size; passages
join the seeds' items on the n-gram, and each passage is aligned with the items
it shares a seed with, unless its words rule out the least score.  Both passes
hold a bit filter of bounded size, so the number of items doesn't add passes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, row_key, small_batches, task, text_bytes
from .shingles import windows
from .vocab import Cache

#: Bits of the n-gram filter: so many an n-gram, and at most (16 MB); a fuller one lets more passages through, and the join drops them.
BITS_A_GRAM, FILTER_BITS = 1024, 1 << 27
#: Words of a passage beside its margins, which the longest item sets.
PASSAGE_WORDS = 1024
#: N-grams that a task counts at a time.
COUNTED_AT_A_TIME = 1_500_000
_OTHER = re.compile(r"[\W_]+")
#: ASCII in lower case, and its marks, which \\W and _ mean there.
_LOWER = bytes(range(256)).lower()
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum() and c not in b" \t\n\x0b\x0c\r")
#: Characters of scripts without spaces between words: each is a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003134f])")


def normal(word: bytes) -> str:
    """A word in lower case, without marks."""
    return _OTHER.sub("", word.decode("utf-8", "replace").lower())


@dataclass(frozen=True)
class Settings:
    gram: int = 3
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    #: Least alignment score, as a part of the score of an exact copy of the whole item.
    min_score: float = 0.5
    #: Shorter items are too common as phrases to tell a copy.
    min_words: int = 6
    #: N-grams up to so many times as frequent as the lower quartile of their item's are rare,
    rare_ratio: float = 4.0
    #: and so are those in at most this share of documents, or in ``rare_documents``.
    rare_share: float = 1e-5
    rare_documents: int = 8


def align(item: np.ndarray, text: np.ndarray, s: Settings) -> tuple[int, int, int]:
    """Best local score of ``item`` in ``text``, with the first and last word of ``text`` in it (end exclusive)."""
    n = len(text)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1) * -s.gap
    best, at = 0, (0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(text == word, s.match, s.mismatch)
        up = row[1:] + s.gap
        new, source = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diagonal >= up
        new[1:] = np.where(take, diagonal, up)
        source[1:] = np.where(take, begin[:-1], begin[1:])
        reset = new <= 0
        new[reset] = 0
        source[reset] = np.flatnonzero(reset)
        raised = new + steps
        high = np.maximum.accumulate(raised)
        where = np.maximum.accumulate(np.where(raised == high, np.arange(n + 1), 0))
        new, source = high - steps, source[where]
        row, begin = new, source
        j = int(np.argmax(row))
        if row[j] > best:
            best, at = int(row[j]), (int(begin[j]), j)
    return best, *at


def may_reach(item: np.ndarray, text: np.ndarray, least: float, s: Settings) -> bool:
    """False only if no alignment of ``item`` in ``text`` scores ``least``: words of the item that the text lacks can't match."""
    gain = np.where(np.isin(item, text), s.match, max(s.mismatch, s.gap))
    total = np.append(0, np.cumsum(gain))
    return bool((total - np.minimum.accumulate(total)).max() >= least)


def _hashed(word: bytes) -> tuple[int, ...]:
    return tuple(xxhash.xxh3_64_intdigest(w) >> 1 or 1 for w in _UNSPACED.split(normal(word)) if w)


def _number(word: bytes) -> int:
    """Hash of a word; -1 where it is several, 0 where it is none."""
    found = _hashed(word)
    return found[0] if len(found) == 1 else -1 if found else 0


def word_numbers(text: bytes, read: Cache) -> np.ndarray:
    """63-bit hashes of the words of a text, marks and case aside."""
    words = text.translate(_LOWER, _MARKS).split()
    if text.isascii():
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)
        return np.maximum(ids, 1).view(np.int64)
    ids = np.fromiter(map(read.__getitem__, words), np.int64, len(words))
    if (ids == -1).any():
        ids = np.array([h for w, k in zip(words, ids.tolist(), strict=True) for h in (_hashed(w) if k == -1 else (k,))], np.int64)
    return ids[ids != 0]


def _grams(ids: np.ndarray, gram: int) -> np.ndarray:
    return windows(ids.view(np.uint64), gram).view(np.int64)


def _prepared(s: Settings):
    names = ["item_id", "item", "n", "words", "grams"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        read = Cache(_number)
        for batch in batches:
            rows = []
            for item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = word_numbers(text, read)
                if len(ids) >= max(s.min_words, s.gram):
                    digest = xxhash.xxh3_64_intdigest(ids.tobytes())
                    rows.append((item_id, digest - (1 << 64) if digest >> 63 else digest, len(ids), ids.tobytes(), _grams(ids, s.gram).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


class GramFilter:
    """Two bits for each n-gram; holds all of a table's and few others."""

    def __init__(self, grams: DataFrame, distinct: int):
        self.bits = min(FILTER_BITS, max(1 << 15, 1 << (BITS_A_GRAM * distinct).bit_length()))
        places = grams.select(F.explode(F.array("gram", F.shiftright("gram", 32))).alias("g")).select(F.pmod("g", F.lit(self.bits)).alias("place"))
        cells = places.select(F.shiftright("place", 15).alias("cell"), F.col("place").bitwiseAND(F.lit((1 << 15) - 1).cast("long")).alias("at"))
        cells = cells.groupBy("cell").agg(F.bitmap_construct_agg("at").alias("part"))
        self.table = np.zeros(self.bits >> 3, np.uint8)
        for r in cells.collect():  # FILTER_BITS bound it
            self.table[r["cell"] << 12 : (r["cell"] + 1) << 12] = np.frombuffer(r["part"], np.uint8)

    def _set(self, places: np.ndarray) -> np.ndarray:
        at = places & (self.bits - 1)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out = self._set(grams)
        hit = np.flatnonzero(out)
        out[hit] = self._set(grams[hit] >> 32)
        return out


def _count(s: Settings, shared):
    """Rows (gram, documents of the task that hold it), and (null, documents)."""

    def batch_of(grams, counts):
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["gram", "n"])

    def run(batches):
        read, known, held, n, docs = Cache(_number), shared.value, [], 0, 0
        for batch in batches:
            docs += batch.num_rows
            for text in batch.column(0).to_pylist():
                grams = _grams(word_numbers(text, read), s.gram)
                held.append(np.unique(grams[known(grams)]))
                n += len(held[-1])
                if n > COUNTED_AT_A_TIME:
                    yield batch_of(*np.unique(np.concatenate(held), return_counts=True))
                    held, n = [], 0
        if held:
            yield batch_of(*np.unique(np.concatenate(held), return_counts=True))
        yield batch_of([None], [docs])

    return run


def passages(ids: np.ndarray, hits: np.ndarray, margin: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, words, hits in it) of each stretch that owns hits; margins reach as far as an item around a hit."""
    out, stride = [], max(PASSAGE_WORDS, margin)
    owner = hits // stride
    for k in np.unique(owner).tolist():
        begin = max(0, k * stride - margin)
        out.append((begin, ids[begin : (k + 1) * stride + margin], hits[owner == k] - begin))
    return out


def _cut(s: Settings, margin: int, shared):
    names = ["doc_id", "key", "row", "begin", "words", "grams", "places"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches):
        read, known = Cache(_number), shared.value
        for batch in batches:
            rows = []
            for doc, key, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = word_numbers(text, read)
                grams = _grams(ids, s.gram)
                for begin, words, hits in passages(ids, np.flatnonzero(known(grams)), margin):
                    rows.append((doc, key, row, begin, words.tobytes(), grams[hits + begin].tolist(), hits.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


def best_alignment(item: np.ndarray, text: np.ndarray, starts: list[int], s: Settings) -> tuple[int, int, int]:
    """Best of ``align`` around places where the item's first word would stand; score 0 where the words rule out the least."""
    slack, best = len(item) // 2 + 4, (0, 0, 0)
    lo = hi = None
    for start in [*sorted(starts), None]:
        if lo is not None and (start is None or start - slack > hi):
            if may_reach(item, text[lo:hi], s.min_score * s.match * len(item), s):
                got = align(item, text[lo:hi], s)
                best = max(best, (got[0], got[1] + lo, got[2] + lo), key=lambda x: x[0])
            lo = None
        if start is not None:
            lo = max(0, start - slack) if lo is None else lo
            hi = min(len(text), max(start, 0) + len(item) + slack)
    return best


_FOUND = "doc_id long, key long, row long, item long, score double, start int, end int"


def _aligned(s: Settings):
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "key", "row", "begin", "words", "items")]
            for doc, key, row, begin, words, items in zip(*columns, strict=True):
                text = np.frombuffer(words, np.int64)
                for x in items:
                    item = np.frombuffer(x["item_words"], np.int64)
                    points, first, end = best_alignment(item, text, x["starts"], s)
                    score = points / (s.match * len(item))
                    if score >= s.min_score:
                        rows.append((doc, key, row, x["item"], score, first + begin, end + begin))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


def rare_seeds(spark: SparkSession, seeds: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Those of ``seeds`` (item, gram, place) that are rare in ``texts`` (bytes).

    At least the quarter of an item's n-grams that is the rarest stays, so each
    item has seeds, however common its words are.
    """
    known = spark.sparkContext.broadcast(GramFilter(seeds, seeds.count()))  # FILTER_BITS bound it
    counts = materialize(texts.mapInArrow(task(_count(s, known)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counts.where("gram is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    counted = seeds.join(counts.where("gram is not null"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    limit = counted.groupBy("item").agg(F.expr("percentile(n, 0.25)").alias("quartile"))
    least = max(s.rare_documents, s.rare_share * total)
    rare = (F.col("n") <= F.greatest(F.col("quartile") * s.rare_ratio, F.lit(least))) & (F.col("n") > 0)
    return counted.join(limit, "item").where(rare).select("item", "gram", "place")


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per document and test item that it copies: doc_id, key, item_id, score, start, end.

    start and end are places of the copy among the document's words; in scripts
    without spaces each character is a word.  Null or empty texts and items
    shorter than ``min_words`` match nothing; each row of a repeated document or
    item gets its own rows; equal scores take the first place.  Texts of any
    length are cut into passages of bounded size.  Columns other than doc_id,
    item_id and text are not read.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), text_bytes().alias("bytes"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("bytes"))
    items = materialize(items.mapInArrow(task(_prepared(s)), "item_id long, item long, n int, words binary, grams array<long>"), "items")
    unique = items.dropDuplicates(["item"])  # items of the same words are searched once
    longest = unique.agg(F.max("n").alias("n")).first()["n"] or 0
    seeds = materialize(unique.select("item", F.posexplode("grams").alias("place", "gram")), "seeds")
    rare = materialize(rare_seeds(spark, seeds, source.select("bytes"), s), "rare")

    known = spark.sparkContext.broadcast(GramFilter(rare, rare.count()))  # FILTER_BITS bound it
    cut = source.select("doc_id", "key", F.monotonically_increasing_id().alias("row"), "bytes").mapInArrow(
        task(_cut(s, longest + longest // 2 + 4, known)), "doc_id long, key long, row long, begin int, words binary, grams array<long>, places array<int>"
    )
    # written, so that numbers of rows and passages stay as they are
    cut = materialize(cut.withColumn("passage", F.monotonically_increasing_id()), "passages")
    hits = cut.select("passage", F.explode(F.arrays_zip("grams", "places")).alias("h")).select("passage", F.col("h.grams").alias("gram"), F.col("h.places").alias("at"))
    pairs = hits.join(rare, "gram").groupBy("passage", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))
    pairs = pairs.join(unique.select("item", F.col("words").alias("item_words")), "item")
    grouped = pairs.groupBy("passage").agg(F.collect_list(F.struct("item", "item_words", "starts")).alias("items"))
    found = cut.select("passage", "doc_id", "key", "row", "begin", "words").join(grouped, "passage").mapInArrow(task(_aligned(s)), _FOUND)
    best = found.groupBy("doc_id", "key", "row", "item").agg(F.max(F.struct("score", (-F.col("start")).alias("before"), "end")).alias("b"))
    best = best.join(items.select("item", "item_id"), "item")
    return best.select("doc_id", "key", "item_id", F.col("b.score").alias("score"), (-F.col("b.before")).alias("start"), F.col("b.end").alias("end"))


def decontaminate(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` without the documents that copy a test item; other rows and all columns, whatever their names, stay as they are."""
    name = fresh(docs, "key")
    found = contaminated(docs, items, settings).select(F.col("key").alias(name)).distinct()
    return docs.join(found, row_key("doc_id", "text") == F.col(name), "left_anti")
