"""Removal of repeated byte strings, by a column-wise suffix order over all texts.

Where two equal strings of ``short`` bytes stand, they hold the same anchor: a
gram whose hash is least in some window, chosen from the bytes alone.  Anchors
that stand once in the corpus can't belong to a repeated string.  Around each
other anchor a read is cut, ``length`` bytes to the right and as many to the left
as a window may reach, and the reads of an anchor meet in a task.  Strings of
``length`` bytes that repeat are removed, those of ``short`` are only told.

There the order of all suffixes is built column by column: every round inserts
one symbol in front of each read; a stable sort by that symbol of the previous
order gives the new one (the symbols in this order are the column's
Burrows-Wheeler transform), and the common prefixes of neighbours follow from
the previous column's.  A neighbour with a common prefix of ``short`` bytes or
more is a repeated string, one of ``length`` or more a string to remove.  A round reads one column and the two arrays of the
round before, never an older one.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_bytes
from .runs import repeated_groups

LENGTH = 400
#: Least bytes of the repeats that are told but not removed: 50 words of four bytes, blanks included.
SHORT = 200
#: A passage has more words than this.
PASSAGE_WORDS = 50
GRAM = 32
#: Reads of one anchor up to which they are ordered in one task; more go the way of ``_hot_windows``.
MOST_READS = 4096
#: Reads that a task orders together.
BLOCK_READS = 8192
#: Windows of hot anchors that a task compares with each other before the shuffle.
BLOCK_WINDOWS = 500_000
#: Neighbouring windows of a hot anchor that are dealt to the same task.
TOGETHER = 32
#: Times an anchor stands in a batch from which on its rows are known to repeat and are dealt at random.
HOT_IN_BATCH = 64
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = 256


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Grams:
    """Hashes of all strings of a fixed width in a text: polynomials mod 2^64, then mixed."""

    def __init__(self, size: int = CHUNK + 2 * LENGTH):
        self.up, self.down = _powers(size + 1)

    def __call__(self, raw: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        values = (raw.astype(np.uint64) + np.uint64(1 + seed)) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        np.cumsum(values * self.up[:n], out=sums[1:])
        h = (sums[width:] - sums[: n - width + 1]) * self.down[: n - width + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def _sliding(h: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``w`` neighbours, by prefixes and suffixes of blocks."""
    n = len(h)
    f = np.minimum if least else np.maximum
    fill = np.iinfo(np.uint64).max if least else 0
    padded = np.full(-(-n // w) * w, fill, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    front = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], front[w - 1 : n])


def anchors(raw: np.ndarray, grams: Grams, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of grams that are least in some window of ``length`` bytes; ties all count."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = length - gram + 1
    found_at, found = [], []
    for start in range(0, len(raw) - length + 1, CHUNK):
        part = raw[start : start + CHUNK + length - 1]
        h = grams(part, gram)
        low = _sliding(h, w, True)
        # a gram is an anchor if one of the windows that hold it has it as least
        edge = np.zeros(w - 1, np.uint64)
        high = _sliding(np.concatenate([edge, low, edge]), w, False)
        at = np.flatnonzero(high == h)
        found_at.append(at + start)
        found.append(h[at])
    at, index = np.unique(np.concatenate(found_at), return_index=True)
    return at, np.concatenate(found)[index]


def _known(anchor: np.ndarray, hot_in_batch: int) -> np.ndarray:
    """Rows of very common anchors of a batch, but for the first two of each, which tell other tasks of it."""
    _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
    hot = np.flatnonzero(count[group] >= hot_in_batch)
    hot = hot[np.argsort(group[hot], kind="stable")]
    begin = np.flatnonzero(np.append(True, group[hot][1:] != group[hot][:-1])) if len(hot) else hot
    rank = np.arange(len(hot)) - np.repeat(begin, np.diff(np.append(begin, len(hot))))
    known = np.zeros(len(anchor), bool)
    known[hot[rank >= 2]] = True
    return known


def _find(length: int, gram: int):
    """Anchors of each distinct text of a task.  ``again``: the anchor repeats for certain; ``deal`` spreads such rows."""

    def run(batches):
        grams, seen = Grams(), set()
        for batch in batches:
            keys, texts, places = [], [], []
            for key, text in zip(batch.column("t").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if len(text) < length or key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                at, h = anchors(np.frombuffer(text, np.uint8), grams, length, gram)
                keys.append(h.view(np.int64))
                texts.append(np.full(len(at), key, np.int64))
                places.append(at)
            if keys:
                anchor, t, pos = (np.concatenate(x) for x in (keys, texts, places))
                again = _known(anchor, HOT_IN_BATCH)
                deal = np.where(again, t ^ (pos * np.int64(0x9E3779B1)), anchor)
                columns = [pa.array(x) for x in (anchor, t, pos, again, deal)]
                yield from pa.table(columns, ["anchor", "t", "pos", "again", "deal"]).to_batches(max_chunksize=200_000)

    return run


def _aside(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows whose anchor may stand once, and those known to repeat, each once."""
    names, again = ["anchor", "t", "pos"], batch.column("again")
    known = batch.filter(again).select(names)
    v = [known.column(c).to_numpy() for c in names]
    fresh = np.ones(known.num_rows, bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in v], axis=0)
    return batch.filter(pc.invert(again)).select(names), known.filter(pa.array(fresh))


def _cut(length: int, short: int, gram: int):
    """Reads around the anchors of each text: ``left`` bytes before, ``length`` from the anchor on."""
    left = short - gram

    def run(batches):
        last = None
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["anchor", "t", "pos", "before", "read"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            rows = []
            for t, text, places in zip(*(batch.column(c).to_pylist() for c in ("t", "bytes", "places")), strict=True):
                if t == last:
                    continue
                last = t
                for p in places:
                    at = p["pos"]
                    start = max(0, at - left)
                    rows.append((p["anchor"], t, at, at - start, text[start : at + length]))
                    if len(rows) >= 4096:
                        yield out(rows)
                        rows = []
            yield out(rows)

    return run


def column_order(columns: np.ndarray, bucket: np.ndarray, lengths: tuple[int, ...], starts: int) -> list[np.ndarray]:
    """Which windows repeat: for each of ``lengths`` a boolean per (start column, read), for the first ``starts`` columns.

    ``columns``: symbols by (column, read), _NONE outside the text.  ``bucket``:
    ascending numbers of groups of reads that are compared with each other.
    """
    n = columns.shape[1]
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # with the one before, in this order; a last 0 ends it
    repeated = [np.zeros((starts, n), bool) for _ in lengths]
    edge = np.ones(n, bool)
    edge[1:] = bucket[1:] != bucket[:-1]
    base = bucket.astype(np.int64) * (_NONE + 1)
    for c in range(len(columns) - 1, -1, -1):
        symbol = columns[c][order].astype(np.int64)
        key = base + symbol  # buckets keep their places
        if (key[1:] < key[:-1]).any():
            turn = np.argsort(key, kind="stable")
            order, key = order[turn], key[turn]
            new = common[turn]
            gap = np.flatnonzero(turn[1:] != turn[:-1] + 1)
            same = gap[key[gap + 1] == key[gap]]
            if len(same):
                bounds = np.stack([turn[same] + 1, turn[same + 1] + 1], 1).ravel()
                new[same + 1] = np.minimum.reduceat(common, bounds)[::2]
        else:
            new = common[:n].copy()
        new += 1
        new[edge] = 0
        new[1:][key[1:] != key[:-1]] = 0
        new[key - base == _NONE] = 0
        common = np.append(new, np.int32(0))
        if c < starts:
            for length, on in zip(lengths, repeated, strict=True):
                long = common >= length
                on[c, order] = long[:-1] | long[1:]
    return repeated


def _spans(repeated: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated starts per read: read, first and last start column."""
    on = np.zeros((repeated.shape[1], repeated.shape[0] + 2), np.int8)
    on[:, 1:-1] = (repeated & valid).T
    change = np.diff(on, axis=1)
    reads, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    return reads, first, last - 1


def _span_batch(t: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t), pa.array(start), pa.array(end), pa.array(np.full(len(t), size, np.int32))], ["t", "start", "end", "size"])


def _order(length: int, short: int, gram: int):
    left = short - gram

    def solve(rows):
        anchor = np.array([r[0] for r in rows], np.int64)
        bucket = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        before = np.array([r[3] for r in rows], np.int64)
        table = np.full((len(rows), left + length), _NONE, np.uint16)
        for i, r in enumerate(rows):
            at = left - r[3]
            table[i, at : at + len(r[4])] = np.frombuffer(r[4], np.uint8)
        valid = np.arange(left + 1)[:, None] >= (left - before)[None, :]
        t, pos = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        for size, repeated in zip((length, short), column_order(np.ascontiguousarray(table.T), bucket, (length, short), left + 1), strict=True):
            reads, first, last = _spans(repeated, valid)
            begin = pos[reads] - left + first
            yield _span_batch(t[reads], begin, begin + (last - first) + size, size)

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "t", "pos", "before", "read")), strict=True):
                if held and held[-1][1:3] == row[1:3] and held[-1][0] == row[0]:
                    continue
                if held and held[-1][0] != row[0]:
                    if len(held) >= BLOCK_READS:
                        yield from solve(held)
                        held = []
                held.append(row)
        if held:
            yield from solve(held)

    return run


def _starts(runs, least: int) -> np.ndarray:
    """First and last of the runs of at least ``least`` neighbouring starts that a list of such runs makes together."""
    on = np.array(sorted((r["start"], r["last"]) for r in runs), np.int64).reshape(-1, 2)
    last = np.maximum.accumulate(on[:, 1])
    fresh = np.append(True, on[1:, 0] > last[:-1] + 1)[: len(on)]
    joined = np.stack([on[fresh, 0], last[np.append(fresh[1:], True)[: len(on)]]], 1)
    return joined[joined[:, 1] - joined[:, 0] + 1 >= least]


def _hot_windows(size: int, short: int, gram: int):
    """For anchors with very many reads: windows of ``size`` bytes whose first ``short`` have such an anchor as least gram.

    Spark groups them.  Rows with ``end`` are spans that repeat already within
    the texts of a task's block; the others are one window of each two hashes in
    the block.  ``deal`` is the same for equal windows, and for neighbours but
    for one in TOGETHER, so that runs of them meet in a task.  With a column ``runs``, the starts of repeated strings of
    ``short`` bytes, only windows are taken whose every such string repeats: no
    other can repeat as a whole.
    """
    w = short - gram + 1
    names = ["w", "w2", "t", "start", "end", "size", "deal"]

    def blocks(batches):
        """Windows of whole texts, each text once in a block: t, start and two hashes of each."""
        grams, held, seen, n = Grams(), [], set(), 0
        for batch in batches:
            runs = batch.column("runs").to_pylist() if "runs" in batch.schema.names else [None] * batch.num_rows
            for t, text, places, within in zip(*(batch.column(c).to_pylist() for c in ("t", "bytes", "places")), runs, strict=True):
                if t in seen:
                    continue
                seen.add(t)
                raw = np.frombuffer(text, np.uint8)
                hot = np.unique(np.array([p["anchor"] for p in places], np.int64)).view(np.uint64)
                open_ = None if within is None else _starts(within, size - short + 1)
                for begin in range(0, len(raw) - size + 1, CHUNK):
                    if open_ is not None and not ((open_[:, 0] < begin + CHUNK) & (open_[:, 1] - (size - short) >= begin)).any():
                        continue
                    part = raw[begin : begin + CHUNK + size - 1]
                    own = grams(part, gram)
                    low = _sliding(own, w, True)
                    on = np.flatnonzero(np.isin(low[:CHUNK], hot))
                    on = on[on <= len(part) - size]
                    if open_ is not None:
                        run = np.searchsorted(open_[:, 0], on + begin, side="right") - 1
                        on = on[(run >= 0) & (on + begin + size - short <= open_[run, 1])]
                    if len(on):
                        deal = low[on] + (_first_place(own, low[on], on) - on).astype(np.uint64) // np.uint64(TOGETHER) * _BASE
                        held.append((np.full(len(on), t, np.int64), on + begin, grams(part, size)[on], grams(part, size, 1000)[on], deal.view(np.int64)))
                        n += len(on)
                if n >= BLOCK_WINDOWS:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held, seen, n = [], set(), 0
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches):
        for t, start, one, two, deal in blocks(batches):
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            again = np.zeros(len(t), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            first = order[np.concatenate([[True], ~same])]
            on = np.flatnonzero(again)
            fresh = np.ones(len(on), bool)
            fresh[1:] = (t[on][1:] != t[on][:-1]) | (start[on][1:] != start[on][:-1] + 1)
            begin = on[fresh]
            last = on[np.append(fresh[1:], True)] if len(on) else on
            nothing, sizes = pa.nulls(len(first), pa.int64()), np.full(max(len(first), len(begin)), size, np.int32)
            yield from pa.table([pa.array(one[first].view(np.int64)), pa.array(two[first].view(np.int64)), pa.array(t[first]), pa.array(start[first]), nothing, pa.array(sizes[: len(first)]), pa.array(deal[first])], names).to_batches(max_chunksize=200_000)
            yield pa.RecordBatch.from_arrays([pa.array(t[begin] ^ start[begin]), pa.array(np.zeros(len(begin), np.int64)), pa.array(t[begin]), pa.array(start[begin]), pa.array(start[last] + size), pa.array(sizes[: len(begin)]), pa.array(t[begin] ^ start[begin])], names)

    return run


def _hot_spans():
    """Spans of windows that stand in several blocks, and the spans that the blocks found themselves."""

    def run(batches):
        ready = []

        def windows():
            for batch in batches:
                own = batch.column("end").is_null()
                ready.append(batch.filter(batch.column("end").is_valid()).select(["t", "start", "end", "size"]))
                yield batch.filter(own).select(["size", "w", "w2", "t", "start"])

        held, n = [], 0
        for batch in repeated_groups(("w", "w2", "size"), ("t", "start"))(windows()):
            yield from ready
            ready.clear()
            held.append(tuple(batch.column(c).to_numpy() for c in ("size", "t", "start")))
            n += batch.num_rows
            if n >= BLOCK_WINDOWS:
                yield _runs(held)
                held, n = [], 0
        yield from ready
        if held:
            yield _runs(held)

    return run


def _first_place(values: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each wanted value stands first in ``values`` from ``at`` on; it must stand there."""
    known, group = np.unique(values, return_inverse=True)
    n = len(values)
    places = np.sort(group.astype(np.int64) * n + np.arange(n))
    return places[np.searchsorted(places, np.searchsorted(known, wanted) * n + at)] % n


def _runs(windows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Windows (size, t, start) as spans; neighbouring starts of a text are one span."""
    size, t, start = (np.concatenate(x) for x in zip(*windows, strict=True))
    order = np.lexsort((start, t, size))
    size, t, start = size[order], t[order], start[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (size[1:] != size[:-1]) | (t[1:] != t[:-1]) | (start[1:] > start[:-1] + 1)
    last = np.append(fresh[1:], True)
    columns = [t[fresh], start[fresh], start[last] + size[last], size[fresh].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["t", "start", "end", "size"])


def _places(found: DataFrame, many: DataFrame) -> DataFrame:
    """Anchors by text: ``few`` and ``hot``, those with very many reads."""
    marked = found.join(many.withColumn("is_hot", F.lit(True)), "anchor", "left")
    place = F.struct("anchor", "pos")
    few, hot = (F.collect_list(F.when(c, place)) for c in (F.col("is_hot").isNull(), F.col("is_hot").isNotNull()))
    return materialize(marked.groupBy("t").agg(few.alias("few"), hot.alias("hot")), "places")


def _with_places(texts: DataFrame, places: DataFrame, kind: str) -> DataFrame:
    return texts.join(places.where(F.size(kind) > 0).select("t", F.col(kind).alias("places")), "t")


def _hot_repeats(texts: DataFrame, size: int, short: int, gram: int, parts: int) -> DataFrame:
    """Spans of repeated strings of ``size`` bytes at the very common anchors of ``texts``."""
    hot = texts.mapInArrow(_hot_windows(size, short, gram), "w long, w2 long, t long, start long, end long, size int, deal long")
    hot = hot.repartition(parts, "deal").sortWithinPartitions("w", "w2", "size", "t", "start")
    return hot.mapInArrow(_hot_spans(), "t long, start long, end long, size int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, short: int = SHORT) -> DataFrame:
    """(t, copies, spans, passages): per distinct text, by its hash, how often it stands and which bytes repeat.

    ``spans`` cover what repeats over ``length`` bytes, ``passages`` over ``short``.
    A text of that many bytes that stands twice repeats as a whole; its spans
    then tell only what other texts share with it.
    """
    if not gram <= short <= length:
        raise ValueError("gram <= short <= length must hold")
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.xxhash64(text_bytes()).alias("t"), text_bytes().alias("bytes"))
    long = source.where(F.octet_length("bytes") >= short)
    found = long.mapInArrow(_find(short, gram), "anchor long, t long, pos long, again boolean, deal long")
    found = found.repartition(parts, "deal").sortWithinPartitions("anchor", "t", "pos")
    found = materialize(found.mapInArrow(repeated_groups("anchor", ("t", "pos"), _aside), "anchor long, t long, pos long"), "anchors")
    many = found.groupBy("anchor").agg(F.count("t").alias("n")).where(F.col("n") > MOST_READS).select("anchor")
    many = materialize(many, "many")
    places = _places(found, many)
    few = _with_places(long, places, "few").mapInArrow(_cut(length, short, gram), "anchor long, t long, pos long, before int, read binary")
    few = few.repartition(parts, "anchor").sortWithinPartitions("anchor", "t", "pos")
    spans = few.mapInArrow(_order(length, short, gram), "t long, start long, end long, size int")
    if not many.isEmpty():
        spans = materialize(spans, "few_spans")
        texts = _with_places(long, places, "hot")
        told = materialize(_hot_repeats(texts, short, short, gram, parts), "hot_spans")
        spans = spans.union(told)
        if length > short:
            # a string of ``length`` bytes repeats only where all its strings of ``short`` do
            starts = spans.where(F.col("size") == short).select("t", "start", (F.col("end") - short).alias("last"))
            runs = starts.groupBy("t").agg(F.collect_set(F.struct("start", "last")).alias("runs"), F.sum(F.expr("last - start + 1")).alias("n"))
            runs = runs.where(F.col("n") > length - short).drop("n")
            spans = spans.union(_hot_repeats(texts.join(runs, "t"), length, short, gram, parts))
    of = lambda size: F.collect_set(F.when(F.col("size") == size, F.struct("start", "end")))
    by_text = spans.groupBy("t").agg(of(length).alias("spans"), of(short).alias("passages"))
    copies = long.groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    return copies.join(by_text, "t", "left").where("copies > 1 or spans is not null")


def runs_of(size: int, copies: int, spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of repeated bytes in a text of ``size`` bytes that stands ``copies`` times."""
    if copies > 1 and size >= length:
        return [(0, size)]
    runs: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [tuple(r) for r in runs]


def remove(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text."""
    left, at = [], 0
    for s, e in runs:
        left.append(text[at:s])
        at = e
    return b"".join([*left, text[at:]])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, short: int = SHORT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (array of start, end), kept (binary), n_passages.

    Removed is each byte inside a string of ``length`` bytes that starts
    anywhere else too, in the same text or another; judged on the input.  Null,
    empty or shorter texts lose nothing.  Equal texts of ``length`` bytes or
    more, repeated rows included, lose all.  Null ids are ids like any other.
    n_passages counts the maximal runs of more than PASSAGE_WORDS words that
    strings of ``short`` bytes cover which start elsewhere too; such runs stay
    unless they are removed as above.  Very long texts are read in pieces of
    CHUNK bytes; an empty table gives an empty table; other columns are not read.
    """
    repeated = materialize(repeated_spans(docs, length, gram, short), "spans")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_bytes()).alias("t"), text_bytes().alias("bytes")).join(repeated, "t", "left")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans, kept, removed, sizes, passages = [], [], [], [], []
            for text, copies, found, told in zip(*(batch.column(c).to_pylist() for c in ("bytes", "copies", "spans", "passages")), strict=True):
                r = runs_of(len(text), copies or 1, found, length)
                k = remove(text, r)
                spans.append([{"start": s, "end": e} for s, e in r])
                kept.append(k)
                sizes.append(len(text))
                removed.append(len(text) - len(k))
                passages.append(sum(len(text[s:e].split()) > PASSAGE_WORDS for s, e in runs_of(len(text), copies or 1, told, short)))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept", "n_passages"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, n_passages long")
