"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are quantised to integers and dealt into blocks.  A block's index holds
posting segments: for a dimension and an impact (the quantised component), the
rows of the block that have it.  Segments stand by descending size of their
impact.  A search walks them in this order for many queries at once and adds
query component times impact to its rows' accumulators.  After segments down to
a certain impact, what is missing of a row's score is at most the length of the
query times the length of the row's components not yet seen (Cauchy and
Schwarz).  The walk stops only where this bound proves that few rows can still
be among the k best; those are rescored exactly from their whole vectors.

Blocks are searched in rounds, each of three times as many blocks as all before,
and each round starts from the k-th score that the rounds before have proved.
So a query gets about k candidates from a block of the first round and few from
those that follow, while every block is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, task

#: Vectors in a block, queries in a batch, queries whose accumulators are held at once.
BLOCK = 4096
BATCH = 1024
AT_ONCE = 256
#: Blocks of the first round.
FIRST_BLOCKS = 4
#: Shares of a block's squared length that may be unseen when it is tested whether the walk can stop.
STOPS = (0.03,)
_MOST = (1 << 63) - 1


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as long (beyond its range: its ends); null where a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, dims)


_INDEX = "block int, ids binary, dims int, vectors binary, seg_dim binary, seg_impact binary, seg_start binary, seg_rows binary, n_queries int, query_rows binary"
_INDEX_TYPES = [pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 5, pa.int32(), pa.binary()]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def segments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """dim, impact and first place of each posting segment, by descending size of impact; the rows of all, one after the other.

    Impacts of 0 add nothing and have no segment.
    """
    rows, dims = np.nonzero(vectors)
    impact = vectors[rows, dims]
    size = np.maximum(impact, -impact.clip(min=-_MOST))
    order = np.lexsort((rows, impact, dims, -size))
    rows, dims, impact = rows[order], dims[order], impact[order]
    start = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (impact[1:] != impact[:-1])])) if len(rows) else np.zeros(0, np.int64)
    return dims[start].astype("<i4"), impact[start].astype("<i8"), np.append(start, len(rows)).astype("<i4"), rows.astype("<u2")


def _indexer(block: int, blocks: int):
    """Rows (part, vec_id, vector, query) to rows of the index; a block is cut from consecutive rows of a task."""

    def run(batches):
        held: list[tuple[int, np.ndarray, bool]] = []
        part = number = 0

        def flush():
            nonlocal held, number
            held.sort(key=lambda r: r[0])  # ties in score go to the smaller id: the earlier row
            ids = np.array([r[0] for r in held], "<i8")
            dims = max(1, max(len(r[1]) for r in held))
            vectors = np.zeros((len(held), dims), "<i8")
            for i, (_, v, _) in enumerate(held):
                vectors[i, : len(v)] = v
            asked = np.flatnonzero([r[2] for r in held]).astype("<i4")
            values = [part + number * blocks, ids.tobytes(), dims, vectors.tobytes(), *(x.tobytes() for x in segments(vectors)), len(asked), asked.tobytes()]
            held, number = [], number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _INDEX_TYPES, strict=True)], _names(_INDEX))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            for i, v, q in zip(batch.column("vec_id").to_pylist(), np.split(flat, ends[:-1]), batch.column("query").to_pylist(), strict=True):
                held.append((i, v, q))
                if len(held) == block:
                    yield flush()
        if held:
            yield flush()

    return run


def _parts(rows: int, most: int) -> int:
    """Parts to deal ``rows`` to, with some room, so that hardly one holds over ``most``."""
    return max(1, -(-10 * rows // (9 * most)))


def build_index(table: DataFrame, queries: Column, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """The index in the shared folder, one row per block.

    Rows without an id or a whole vector are left out.  Rows are dealt round
    robin, so neither repeated ids nor equal vectors make a large block.
    """
    small_batches(table.sparkSession)
    blocks = _parts(table.count(), block)
    whole = table.select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding"), scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("query"))
    whole = whole.where("vec_id is not null and vector is not null").repartition(blocks).select(F.spark_partition_id().alias("part"), "*")
    return materialize(whole.mapInArrow(task(_indexer(block, blocks)), _INDEX), "topk-index")


_BATCH = "batch int, qdims int, qvectors binary, qids binary, qplaces binary, taus binary"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each block: its number, row, id and vector."""
    for b in batches:
        for block, ids, dims, vectors, rows in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "dims", "vectors", "query_rows")), strict=True):
            at = np.frombuffer(rows, "<i4")
            if len(at):
                v = _matrix(vectors, dims)[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int32)), pa.array(at), pa.array(np.frombuffer(ids, "<i8")[at]), pa.array([x.tobytes() for x in v], pa.binary())], ["block", "row", "query_id", "vector"])


def _packed(batch: int, n_parts: int):
    """Queries to batches; a batch is cut from consecutive rows of a task."""

    def run(batches):
        held: list[tuple] = []
        number, part = 0, 0

        def flush():
            nonlocal held, number
            dims = max(len(r[3]) // 8 for r in held)
            vectors = b"".join(r[3].ljust(8 * dims, b"\0") for r in held)
            ids, places = np.array([r[2] for r in held], "<i8"), np.array([(r[0], r[1]) for r in held], "<i4")
            taus = np.array([-_MOST if r[4] is None else r[4] for r in held], "<i8")
            values = [part + number * n_parts, dims, vectors, ids.tobytes(), places.tobytes(), taus.tobytes()]
            held, number = [], number + 1
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], _names(_BATCH))

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("block", "row", "query_id", "vector", "tau", "part")), strict=True):
                part = row[5]
                held.append(row[:5])
                if len(held) == batch:
                    yield flush()
        if held:
            yield flush()

    return run


def search(vectors: np.ndarray, postings: tuple, queries: np.ndarray, taus: np.ndarray, own: np.ndarray, k: int, stops: tuple[float, ...] = STOPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of up to k best rows for each query, of those with a score of at least its tau.

    Ties go to the earlier row.  ``own`` is the row that a query must not find,
    or -1.  Scores beyond the range of a long become its ends.
    """
    n, dims = vectors.shape
    high = [max(int(m.max()), -int(m.min())) if m.size else 0 for m in (vectors, queries)]
    most = high[0] * high[1] * dims
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else object  # the least in which no sum can overflow
    q, v = queries.astype(kind), vectors.astype(kind)
    acc = np.zeros((n, len(q)), kind)
    masked = np.flatnonzero(own >= 0)
    lengths = np.sqrt((q.astype(float) ** 2).sum(1)) * (1 + 1e-9)
    squares = vectors.astype(float) ** 2
    seg_dim, seg_impact, start, rows = postings
    sizes = np.abs(seg_impact.astype(float))
    total, unseen_at = squares.sum(), []
    for share in stops:  # the impact down to which segments must be seen for this share to be left
        by_size = np.sort(squares[squares > 0])
        at = np.searchsorted(np.cumsum(by_size), share * total)
        unseen_at.append(np.sqrt(by_size[at - 1]) if at else 0.0)
    columns = np.ascontiguousarray(q.T)
    done, pairs = 0, None
    for level in [*(unseen_at if kind is not object else []), 0.0]:  # scores beyond 64 bits have no bound in floats
        end = int(np.searchsorted(-sizes, -level, "left"))  # all with a larger impact
        for s in range(done, end):
            at = rows[start[s] : start[s + 1]]
            acc[at] += columns[seg_dim[s]] * kind(seg_impact[s]) if kind is not object else columns[seg_dim[s]] * int(seg_impact[s])
        done = max(done, end)
        if not level:  # all is seen: accumulators are scores
            if kind is object:
                acc = np.minimum(np.maximum(acc, -_MOST), _MOST).astype(np.int64)
            pairs = _best(acc, taus, own, k)
            break
        rest = np.sqrt(np.where(squares <= level * level, squares, 0).sum(1))
        # room for the rounding of 32-bit floats, so that no row is lost to it
        reach = (lengths[:, None] * rest[None, :] * (1 + 1e-5) + 1).astype(np.float32)
        partial = np.ascontiguousarray(acc.T).astype(np.float32)
        reach += np.abs(partial) * np.float32(1e-5)
        floor = np.where(taus > -_MOST, taus * (1 - np.sign(taus) * 1e-5) - 1, -np.inf).astype(np.float32)
        if n > k + 1:
            low = partial - reach
            low[masked, own[masked]] = -np.inf
            floor = np.maximum(floor, np.partition(low, n - k, axis=1)[:, n - k])
        partial += reach
        maybe = partial >= floor[:, None]
        maybe[masked, own[masked]] = False
        # rescoring costs a few times what a posting does
        if 4 * dims * int(maybe.sum()) < (len(rows) - int(start[done])) * len(q):
            pairs = np.nonzero(maybe)
            break
    which, row = pairs
    exact = acc[row, which] if not level else np.concatenate([np.einsum("ij,ij->i", v[r], q[w]) for r, w in _chunks(row, which)] or [np.zeros(0, kind)])
    exact = exact.astype(np.int64)
    order = np.lexsort((row, -exact, which))
    which, row, exact = which[order], row[order], exact[order]
    begin = np.searchsorted(which, np.arange(len(q)))
    keep = (np.arange(len(which)) - begin[which] < k) & (exact >= taus[which])
    return which[keep], row[keep], exact[keep]


def _best(acc: np.ndarray, taus: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all rows that score at least a query's k-th best, and its tau."""
    which, found = [], []
    for j in range(acc.shape[1]):
        scores = acc[:, j]
        floor = max(taus[j], np.partition(scores, -k - 1)[-k - 1]) if len(scores) > k + 1 else taus[j]  # one more: its own row may be among them
        at = np.flatnonzero(scores >= floor)
        at = at[at != own[j]]
        which.append(np.full(len(at), j))
        found.append(at)
    return np.concatenate(which), np.concatenate(found)


def _chunks(row: np.ndarray, which: np.ndarray, most: int = 1 << 17):
    for a in range(0, len(row), most):
        yield row[a : a + most], which[a : a + most]


_FOUND = "qblock int, qrow int, query_id long, block int, row int, vec_id long, score long"


def _searcher(k: int):
    def run(batches):
        for b in batches:
            cells = zip(*(b.column(c).to_pylist() for c in (*_names(_INDEX)[:8], *_names(_BATCH)[1:])), strict=True)
            for block, ids, dims, vectors, seg_dim, seg_impact, seg_start, seg_rows, qdims, qvectors, qids, qplaces, taus in cells:
                ids, v, qs = np.frombuffer(ids, "<i8"), _matrix(vectors, dims), _matrix(qvectors, qdims)
                qids, places, taus = np.frombuffer(qids, "<i8"), np.frombuffer(qplaces, "<i4").reshape(-1, 2), np.frombuffer(taus, "<i8")
                postings = (np.frombuffer(seg_dim, "<i4"), np.frombuffer(seg_impact, "<i8"), np.frombuffer(seg_start, "<i4"), np.frombuffer(seg_rows, "<u2"))
                if qdims < dims:  # what a shorter vector lacks counts as 0
                    qs = np.pad(qs, ((0, 0), (0, dims - qdims)))
                own = np.where(places[:, 0] == block, places[:, 1], -1)
                for a in range(0, len(qs), AT_ONCE):
                    part = slice(a, a + AT_ONCE)
                    w, r, s = search(v, postings, qs[part, :dims], taus[part], own[part], k)
                    w = w + a
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (places[w, 0], places[w, 1], qids[w], np.full(len(w), block, np.int32), r.astype(np.int32), ids[r], s)], _names(_FOUND))

    return run


def top_k(table: DataFrame, queries: Column, k: int = 20, scale: int = 64, block: int = BLOCK, batch: int = BATCH, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of ``table`` where ``queries`` holds, its k best other rows.

    ``table`` has vec_id and embedding (an array of numbers); other columns are
    read only by ``queries``, so their names are no matter.  The score is the
    inner product of floor(scale * x); ties go to the smaller vec_id.  Rows
    whose vec_id or vector is null, or whose vector holds a null or a number
    that is not finite, take no part.  An empty vector scores 0 with all; what a
    shorter vector lacks counts as 0.  Rows are told apart by their place, not
    their id: a row that stands twice is a candidate of its copy, and gives two
    queries.  Scores beyond the range of a long become its ends.  An empty
    table, or no query, gives an empty result.

    Block and batch sizes bound what a task holds.  The pairing of blocks with
    query batches is a join by (block, batch), dealt over all tasks.
    """
    spark = table.sparkSession
    if not 0 < block <= 1 << 16:
        raise ValueError("a block's rows are numbered in 16 bits")
    index = build_index(table, queries, scale, block)
    n_queries, last = index.agg(F.coalesce(F.sum("n_queries"), F.lit(0)), F.coalesce(F.max("block"), F.lit(-1))).first()
    blocks = last + 1 if n_queries else 0
    asked = index.where("n_queries > 0").select("block", "ids", "dims", "vectors", "query_rows").mapInArrow(task(_asked), "block int, row int, query_id long, vector binary")
    asked = materialize(asked, "topk-queries")
    n_parts = _parts(n_queries, batch)
    best = spark.createDataFrame([], _FOUND)
    place = Window.partitionBy("qblock", "qrow").orderBy(F.col("score").desc(), "vec_id", "block", "row")
    at, upto = 0, first_blocks
    while at < blocks:
        upto = min(upto, blocks)
        taus = best.groupBy(F.col("qblock").alias("block"), F.col("qrow").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("tau"))
        packed = asked.join(taus, ["block", "row"], "left").repartition(n_parts).select("*", F.spark_partition_id().alias("part"))
        packed = materialize(packed.mapInArrow(task(_packed(batch, n_parts)), _BATCH), "topk-batches")
        batches = packed.agg(F.max("batch")).first()[0] + 1
        cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (upto - at) * batches)
        numbers = F.sequence(F.lit(0), F.lit(batches - 1))
        # a block goes to each batch, a batch to each block of the round
        left = index.where((F.col("block") >= at) & (F.col("block") < upto)).drop("n_queries", "query_rows").withColumn("batch", F.explode(numbers))
        right = packed.withColumn("block", F.explode(F.sequence(F.lit(at), F.lit(upto - 1))))
        found = left.repartition(cells, "block", "batch").join(right.hint("shuffle_hash"), ["block", "batch"]).mapInArrow(task(_searcher(k)), _FOUND)
        ranked = best.unionAll(found).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        best = materialize(ranked.drop("rank"), "topk-best")
        at, upto = upto, 4 * upto
    return best.withColumn("rank", F.row_number().over(place)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
