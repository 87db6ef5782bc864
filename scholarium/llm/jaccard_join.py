"""Exact Jaccard self-join on word shingles, size-aware, with the components of its links.

Documents with equal sets are one node.  Nodes find candidates by the size of
their sets: small ones enumerate all subsets of two from their prefix, large
ones put every shingle of their prefix into an inverted list; the boundary
between them is where the estimated cost is least.  Prefixes follow an order
that puts shingles known to be frequent last, which keeps shared passages out
of the lists.  Sets at or above the boundary, and those below it that could
still match one above, meet in the lists; so each pair that links has a bucket
in common.

Buckets are never expanded into all pairs.  Each bucket tests its members
against a pivot; what is linked falls into one component; large buckets that
still hold several components test other pivots.  What is then left of a bucket
is compared inside tasks, in cells of bounded size, by signatures of two to four
bits a shingle, which tell a lower bound of how many shingles two sets do not
share.  Alike buckets become one there, so that a document's signature is not sent
once for each shingle of a passage.  Members with a pair that may still link,
and whose ends lie in different components, get their texts and meet in their cell again; links that join two
components leave it, so no step has a row for each pair.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, small_batches, task, text_bytes
from .components import connected_components
from .runs import pairs_and_groups
from .shingles import shingle_set

#: At most so many frequent shingles are sent to all tasks (8 bytes each).  There are no more than
#: (all shingles) / threshold of them, and the threshold grows with the corpus accordingly.
MOST_FREQUENT = 2_000_000
LEAST_FREQUENCY = 64
#: Shingles that a task sorts at a time to find those that repeat.
COUNTED_AT_A_TIME = 1_500_000
#: Boundaries that the cost model weighs, as set sizes.
BOUNDARIES = tuple(range(3, 65))
#: Rounds of pivots at most, and the bucket size from which they are used.
PIVOT_ROUNDS, PIVOT_FROM = 4, 9
#: Comparisons a bucket member that the closing step may take; while there are more, pivots go on.
CLOSING_COST = 1000
#: Members of a bucket that meet each other in one cell of the closing step.
CELL = 1024
#: Keys of a node, the least ones, that a cell looks at to tell whether another cell has the same pair.
FIRST_KEYS = 64
#: Lists longer than this have a shingle that no single task saw often; it then counts as frequent too.
LONGEST_LIST = 4096
#: Bits of the filter that keeps other texts out of a shuffle: 1 MB, whatever the size of the corpus.
FILTER_BITS = 1 << 23


def _need(size: int, percent: int) -> int:
    """Least overlap of a set of ``size`` with any set it links to: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_of(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=7))


def signature(shingles: np.ndarray) -> bytes:
    """A bit for each residue of hashes, set where an odd number of them has it; twice as many bits as shingles at least."""
    n = max(64, 2 << (len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(n - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n) & 1).astype(bool), bitorder="little").tobytes()


def may_link(p: bytes, n: int, q: bytes, m: int, percent: int) -> bool:
    """False only if sets of ``n`` and ``m`` shingles with signatures ``p`` and ``q`` can't link.

    Each bit that differs stands for a shingle that only one set has.  Of
    signatures of different length the longer is folded.
    """
    x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return (100 + percent) * (n + m - apart) >= 2 * percent * (n + m)


def _scan(width: int):
    """Rows of documents (kind 0: doc_id, key, node, size, signature) and of shingles repeated in a task (kind 1: shingle, count)."""
    names = ["kind", "a", "b", "c", "size", "sig"]
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        held: list[np.ndarray] = []
        n, seen = 0, set()

        def counted():
            if not held:
                return
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1].view(np.int64), c[c > 1]
            nothing = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int8)), pa.array(u), nothing, nothing, pa.array(c), pa.nulls(len(u), pa.binary())], names)

        for batch in batches:
            rows = []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(text, width)
                node = node_of(s) if len(s) else None
                new = node is not None and node not in seen
                rows.append((0, doc, key, node, len(s), signature(s) if new else None))
                if new:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    held.append(s)
                    n += len(s)
                if n > COUNTED_AT_A_TIME:
                    yield from counted()
                    held, n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
        yield from counted()

    return run


def prefix(shingles: np.ndarray, frequent: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` shingles in the global order: infrequent ones by value, then frequent ones by value."""
    if not len(frequent):
        return shingles[:length]
    at = np.searchsorted(frequent, shingles)
    at[at == len(frequent)] = 0
    hot = frequent[at] == shingles
    return np.concatenate([shingles[~hot], shingles[hot]])[:length]


def bucket_keys(shingles: np.ndarray, frequent: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """Keys of the buckets of a set; sets that link share at least one, unless they are equal.  Keys of subsets have the highest bit."""
    size = len(shingles)
    need = _need(size, percent)
    keys = []
    if size < boundary and need >= 2:
        p = prefix(shingles, frequent, size - need + 2)
        i, j = np.triu_indices(len(p), 1)
        lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
        keys.append(((lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi + (lo >> np.uint64(31)))) | np.uint64(1 << 63))
    if size >= _need(boundary, percent):
        keys.append(prefix(shingles, frequent, size - need + 1))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def least_size(percent: int) -> int:
    """Size of the smallest set that can link to another one."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def _emit(width: int, percent: int, boundary: int, frequent):
    def run(batches):
        hot, seen = frequent.value, set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, width)
                if len(s) < least_size(percent):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                k = bucket_keys(s, hot, boundary, percent)
                keys.append(k)
                nodes.append(np.full(len(k), node, np.int64))
                sizes.append(np.full(len(k), len(s), np.int32))
            if keys:
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(sizes)]
                table = pa.table([pa.array(c) for c in columns], ["key", "node", "size"])
                yield from table.to_batches(max_chunksize=200_000)

    return run


def choose_boundary(sizes: list[tuple[int, int]], per_list: float, percent: int, test_cost: float = 4.0) -> int:
    """The set size from which inverted lists are used.

    ``sizes``: (set size, nodes).  A subset costs one row; a list entry costs
    one row and ``test_cost`` for each other entry that its list should hold.
    Where sets of one or two could link, they have no subsets of two; all then
    use lists.
    """
    if least_size(percent) < 3:
        return 1

    def cost(b: int) -> float:
        total = 0.0
        for size, n in sizes:
            need = _need(size, percent)
            if size < b:
                p = size - need + 2
                total += n * p * (p - 1) / 2
            if size >= _need(b, percent):
                total += n * (size - need + 1) * (1 + test_cost * per_list)
        return total

    return min(BOUNDARIES, key=cost)


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is in ``wanted``, and some others: a filter of FILTER_BITS bits, in cells of 2^15."""
    place = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    cell, at = F.shiftright(place, 15).alias("_cell"), place.bitwiseAND(F.lit((1 << 15) - 1).cast("long"))
    cells = wanted.select(cell, at.alias("_at")).groupBy("_cell").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (at % 8).cast("int") + F.lit(1)))
    # FILTER_BITS bound the cells
    return rows.withColumn("_cell", cell).join(F.broadcast(cells), "_cell").where(bit != 0).drop("_cell", "_bits")


class _Sets(OrderedDict):
    def of(self, node: int, text: bytes, width: int) -> np.ndarray:
        if node not in self:
            if len(self) >= 64:
                self.popitem(last=False)
            self[node] = shingle_set(text, width)
        return self[node]


def _may_link(percent: int):
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("pa", "na", "pb", "nb")]
            ok = [may_link(p, n, q, m, percent) for p, n, q, m in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def close_pairs(a: dict, b: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of members in different components whose sizes and signatures leave a link possible.

    ``a``, ``b``: arrays ``size`` and ``comp``, and the signatures by their length in words, ``sigs``: {words: (places, rows)}.
    """
    left, right = [], []
    for wa, (pa_, ra) in a["sigs"].items():
        for wb, (pb_, rb) in b["sigs"].items():
            words = min(wa, wb)
            y, n_b, comp_b = _folded(rb, words), b["size"][pb_], b["comp"][pb_]
            step = max(1, (1 << 21) // max(1, len(pb_) * words))
            for at in range(0, len(pa_), step):
                own = pa_[at : at + step]
                n_a = a["size"][own][:, None]
                ok = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (a["comp"][own][:, None] != comp_b)
                if not ok.any():
                    continue
                x = _folded(ra[at : at + step], words)
                apart = np.bitwise_count(x[:, None, :] ^ y[None]).sum(2, dtype=np.int64)
                ok &= (100 + percent) * (n_a + n_b - apart) >= 2 * percent * (n_a + n_b)
                i, k = np.nonzero(ok)
                left.append(own[i])
                right.append(pb_[k])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *left]), np.concatenate([nothing, *right])


def _close(percent: int):
    """Over rows sorted by cell (key, i, j): the members that may link to one of another component.

    Members of side 0 meet those of side 1, or each other where there is no side
    1.  A pair that stands in several buckets counts in that of the least key, as
    far as FIRST_KEYS tell.
    """
    columns = ["node", "size", "comp", "side"]

    def side(t: pa.Table, which: np.ndarray) -> dict:
        at = np.flatnonzero(which)
        sig = [x.as_py() for x in t.column("sig").take(pa.array(at))]
        words = np.array([len(x) >> 3 for x in sig], np.int64)
        sigs = {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            sigs[w] = own, np.frombuffer(b"".join(sig[i] for i in own.tolist()), np.uint64).reshape(len(own), w)
        return {c: t.column(c).to_numpy()[at] for c in columns} | {"at": at, "sigs": sigs, "keys": t.column("keys").take(pa.array(at)).to_pylist()}

    def solve(held):
        t = pa.concat_tables(held).combine_chunks()
        key = t.column("key")[0].as_py()
        second = t.column("side").to_numpy() == 1
        a = side(t, ~second)
        b = side(t, second) if second.any() else a
        i, k = close_pairs(a, b, percent)
        # two members count in the bucket of the least key that they share
        before = [frozenset(z for z in keys if z < key) for keys in a["keys"]]
        after = before if a is b else [frozenset(z for z in keys if z < key) for keys in b["keys"]]
        new = np.fromiter((before[p].isdisjoint(after[q]) for p, q in zip(i.tolist(), k.tolist(), strict=True)), bool, len(i))
        at = np.concatenate([a["at"][i[new]], b["at"][k[new]]])
        return t.select(["key", "i", "j", "side", "node", "comp"]).take(pa.array(np.unique(at))).to_batches()

    def run(batches):
        for cell in _cells(batches):
            yield from solve(cell)

    return run


def _cells(batches, prepare=pa.table):
    """Lists of tables, a list for each cell (key, i, j) of rows sorted by it."""
    held, cell = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = prepare(batch)
        ids = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in ids], axis=0)) + 1
        edges = [0, *change.tolist(), t.num_rows]
        for begin, end in zip(edges, edges[1:], strict=False):
            own = tuple(int(v[begin]) for v in ids)
            if held and own != cell:
                yield held
                held = []
            cell = own
            held.append(t.slice(begin, end - begin))
    if held:
        yield held


def _join_components(width: int, percent: int):
    """Over rows sorted by cell, with texts: links (a, b) of nodes, enough of them to join what links in the cell join."""

    def with_sets(batch: pa.RecordBatch) -> pa.Table:
        # a cell holds sets, not texts
        sets = [shingle_set(x, width) for x in batch.column("text").to_pylist()]
        return pa.table(batch).drop_columns(["text"]).append_column("set", pa.array([x.tobytes() for x in sets], pa.large_binary()))

    def side(t: pa.Table, which: np.ndarray) -> dict:
        at = np.flatnonzero(which)
        sets = [np.frombuffer(t.column("set")[i].as_py(), np.uint64) for i in at.tolist()]
        sig = [signature(x) for x in sets]
        words = np.array([len(x) >> 3 for x in sig], np.int64)
        sigs = {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            sigs[w] = own, np.frombuffer(b"".join(sig[i] for i in own.tolist()), np.uint64).reshape(len(own), w)
        size = np.array([len(x) for x in sets], np.int64)
        return {"node": t.column("node").to_numpy()[at], "comp": t.column("comp").to_numpy()[at], "size": size, "sets": sets, "sigs": sigs}

    def run(batches):
        for held in _cells(batches, with_sets):
            t = pa.concat_tables(held)
            second = t.column("side").to_numpy() == 1
            a = side(t, ~second)
            b = side(t, second) if second.any() else a
            parent: dict[int, int] = {}

            def top(c: int) -> int:
                while (up := parent.get(c, c)) != c:
                    parent[c] = c = parent.get(up, up)  # noqa: B023
                return c

            links = []
            for i, k in zip(*(x.tolist() for x in close_pairs(a, b, percent)), strict=True):
                if a is b and i >= k:
                    continue
                one, other = top(int(a["comp"][i])), top(int(b["comp"][k]))
                if one == other:
                    continue
                p, q = a["sets"][i], b["sets"][k]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    parent[max(one, other)] = min(one, other)
                    links.append((int(a["node"][i]), int(b["node"][k])))
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], ["a", "b"])

    return run


def _test(width: int, percent: int):
    def run(batches):
        sets = _Sets()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for x, y, tx, ty in zip(a, b, batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                p, q = sets.of(x, tx, width), sets.of(y, ty, width)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def similar_documents(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_shingles, node, component_id, first_key.

    Words are runs of characters other than space and \\x09-\\x0D, A-Z in lower
    case; a set holds the distinct windows of ``width`` words, or the whole
    sequence where there are fewer.  Documents link when 100 * intersection >=
    percent * union.  component_id is the smallest doc_id that links reach
    (null ids count only where a component has no other); first_key is the
    ``row_key`` of that document.  Null, empty or blank text: an empty set,
    linked with nothing, its own id.  Repeated rows are equal sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("key"), text_bytes().alias("bytes"))
    scanned = materialize(source.mapInArrow(task(_scan(width)), "kind byte, a long, b long, c long, size long, sig binary"), "scan")
    rows = scanned.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), F.col("c").alias("node"), "size")
    totals = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    least = max(LEAST_FREQUENCY, -(-totals // MOST_FREQUENT))
    counts = scanned.where("kind = 1").groupBy(F.col("a").alias("shingle")).agg(F.sum("size").alias("n"))
    hot = counts.where(F.col("n") >= least).select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)
    repeats = counts.where(F.col("n") < least).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("n")).first()["n"] or 0
    histogram = rows.where("size between 3 and 64").groupBy("size").count().collect()
    boundary = choose_boundary([(r["size"], r["count"]) for r in histogram], repeats / max(1, totals), percent)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fits = lambda a, b: 100 * np.minimum(a, b).astype(np.int64) >= percent * np.maximum(a, b).astype(np.int64)

    def listed(hot: np.ndarray) -> DataFrame:
        frequent = spark.sparkContext.broadcast(np.sort(hot))  # MOST_FREQUENT bounds it, once for each way of counting
        entries = source.select("bytes").mapInArrow(task(_emit(width, percent, boundary, frequent)), "key long, node long, size int")
        entries = entries.repartition(parts, "key").sortWithinPartitions("key", "node")
        return materialize(entries.mapInArrow(task(pairs_and_groups(fits)), "key long, node long, size int, other long"), "lists")

    lists = listed(hot)
    # Exact counts: a shingle that stands in many tasks, but seldom in each, shows as a long list.
    longest = max(LONGEST_LIST, least)
    long = lists.where("other is null and key >= 0").groupBy("key").count().where(F.col("count") > longest).select("key")
    more = np.setdiff1d(long.toPandas()["key"].to_numpy(np.int64).view(np.uint64), hot)
    if len(more):
        lists = listed(np.concatenate([hot, more]))
    signatures = scanned.where("sig is not null").select(F.col("c").alias("node"), "size", "sig")
    components = _link(docs, rows, signatures, lists, percent, width)

    members = rows.join(components, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = materialize(members.select("doc_id", "key", "node", "size", "comp"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("f")
    firsts = members.where("comp is not null").groupBy("comp").agg(first).select("comp", "f.doc_id", "f.key")
    firsts = materialize(firsts.withColumnsRenamed({"doc_id": "component_id", "key": "first_key"}), "firsts")
    return members.join(firsts, "comp", "left").select(
        "doc_id",
        "key",
        F.col("size").alias("n_shingles"),
        "node",
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("comp").isNull(), F.col("key")).otherwise(F.col("first_key")).alias("first_key"),
    )


def _link(docs: DataFrame, rows: DataFrame, signatures: DataFrame, lists: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, comp) of nodes with a link."""
    from pyspark.sql import Window

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    twos = lists.where("other is not null").select(F.col("node").alias("x"), F.col("other").alias("y")).distinct()
    groups = lists.where("other is null").select("key", "node", "size")
    # Buckets with the same members test the same pairs: one of them stays.
    shape = groups.groupBy("key").agg(F.count("node").alias("n"), F.bit_xor(F.xxhash64("node")).alias("m"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "node"), 16)).alias("m2"))
    stay = materialize(shape.groupBy("n", "m", "m2").agg(F.min("key").alias("key")).select("key", "n"), "stay")
    groups = materialize(groups.join(stay, "key"), "groups")

    needed = twos.select(F.col("x").alias("node")).union(twos.select("y")).union(groups.select("node")).distinct()
    keys = rows.join(needed, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    keys = materialize(keys, "keys")
    signatures = materialize(signatures.join(needed, "node", "left_semi").groupBy("node").agg(F.max("size").alias("size"), F.max("sig").alias("sig")), "signatures")
    fits = lambda a, b: F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)

    def texts_of(nodes: DataFrame) -> DataFrame:
        own = materialize(nodes.distinct().join(keys, "node"), "own")
        # repeated rows share a key; any of them has the node's text
        texts = _likely(docs.select(row_key("doc_id", "text").alias("key"), text_bytes().alias("text")), own).join(own, "key").select("node", "text")
        return materialize(texts.dropDuplicates(["node"]), "texts")

    def test(pairs: DataFrame, tested: DataFrame | None = None) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        side = lambda s: signatures.select(F.col("node").alias(s), F.col("size").alias(f"n{s}"), F.col("sig").alias(f"p{s}"))
        close = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "pa", "na", "pb", "nb").mapInArrow(task(_may_link(percent)), "a long, b long")
        close = materialize(close, "close")
        texts = texts_of(close.select(F.explode(F.array("a", "b")).alias("node")))
        tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        linked = close.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(task(_test(width, percent)), "a long, b long, linked boolean")
        # pairs apart are kept too, so that no later turn tests them again
        linked = linked.where("linked").select("a", "b", "linked").distinct()
        return materialize(pairs.join(linked, ["a", "b"], "left").select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked")), "tested")

    def pivot_pairs(members: DataFrame, order) -> DataFrame:
        pivot = F.first(F.struct("node", "size", "comp")).over(Window.partitionBy("key").orderBy(order, "node"))
        apart = members.withColumn("p", pivot).where((F.col("p.comp") != F.col("comp")) & fits(F.col("size"), F.col("p.size")))
        return apart.select(F.col("p.node").alias("x"), F.col("node").alias("y"))

    tested = test(twos.union(pivot_pairs(groups.withColumn("comp", F.col("node")), F.col("node"))))
    components = connected_components(tested.where("linked").select("a", "b"))
    for turn in range(1, PIVOT_ROUNDS + 1):
        # Buckets whose members are not yet all in one component.
        groups = groups.drop("comp").join(components, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = materialize(_mixed(groups), "mixed")
        groups = materialize(groups.select("key", "node", "size", "n", "comp").join(mixed, "key"), "groups")
        work = mixed.agg(F.sum(F.col("few") * (F.col("few") + F.col("in_main"))).alias("work"), F.sum(F.col("few") + F.col("in_main")).alias("members")).first()
        large = groups.where(F.col("n") >= PIVOT_FROM)
        if turn == PIVOT_ROUNDS or (work["work"] or 0) <= CLOSING_COST * (work["members"] or 0):
            break
        # each turn another order, so that a member that missed one pivot meets others
        new = test(pivot_pairs(large, F.xxhash64("node", F.lit(turn), *(["key"] if turn > 1 else []))), tested)
        tested = tested.union(new)
        if new.where("linked").isEmpty():
            break
        components = connected_components(tested.where("linked").select("a", "b"))

    apart = materialize(_apart(_merged(groups, mixed), signatures, percent), "apart")
    cells = apart.join(texts_of(apart.select("node")), "node").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    new = materialize(cells.mapInArrow(task(_join_components(width, percent)), "a long, b long"), "joined")
    if new.isEmpty():
        return components
    return connected_components(tested.where("linked").select("a", "b").union(new))


def _mixed(groups: DataFrame) -> DataFrame:
    """Buckets with members in several components: the largest component, the members outside and inside it, the least hash of a member."""
    shares = groups.groupBy("key", "comp").agg(F.count("node").alias("c"), F.min(F.xxhash64("node")).alias("least"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("members"), F.count("comp").alias("comps"), F.min("least").alias("least"))
    return mixed.where("comps > 1").select("key", F.col("m.comp").alias("main"), (F.col("members") - F.col("m.c")).alias("few"), F.col("m.c").alias("in_main"), "least")


def _merged(groups: DataFrame, mixed: DataFrame) -> DataFrame:
    """``groups`` (joined with ``mixed``) with alike buckets made one: each pair that meets in a bucket meets in what it became.

    Documents that share a passage meet in a bucket for each of its shingles, and
    each bucket's rows carry signatures.  Buckets that agree in the least hash of
    a member, as alike ones mostly do, become one where its members squared are
    no more than those of the single buckets summed, so that merging never adds
    comparisons.
    """
    square = lambda c: c.cast("double") * c.cast("double")
    sizes = groups.select("least", "node").distinct().groupBy("least").agg(F.count("node").alias("n"))
    single = mixed.groupBy("least").agg(F.sum(square(F.col("few") + F.col("in_main"))).alias("cost"), F.count("key").alias("buckets"))
    alike = materialize(sizes.join(single, "least").where((F.col("buckets") > 1) & (square(F.col("n")) <= F.col("cost"))).select("least", F.col("least").alias("one")), "alike")
    rows = groups.select("key", "node", "size", "comp", "least").join(alike, "least", "left").select(F.coalesce("one", "key").alias("key"), "node", "size", "comp").distinct()
    rows = materialize(rows, "merged")
    return rows.join(_mixed(rows), "key")


def _apart(groups: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Members of buckets that may link to one of another component, by the cell where they meet: key, i, j, side, node, comp.

    One end of such a pair lies outside the bucket's largest component.  Both
    parts of a bucket are dealt into chunks of about CELL members, and each cell
    holds two chunks, so a bucket of any size is spread over tasks.  A bucket of up
to CELL members is one cell, and each member goes there once.
    """
    spark = groups.sparkSession
    chunks = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    in_few = F.col("comp") != F.col("main")
    rows = groups.withColumn("gf", chunks("few")).withColumn("gm", chunks("in_main"))
    rows = rows.withColumn("r", F.pmod(F.xxhash64("node"), F.when(in_few, F.col("gf")).otherwise(F.col("gm"))).cast("int"))
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    among_few = F.transform(upto("gf"), lambda j: cell(F.least(F.col("r"), j), F.greatest(F.col("r"), j), F.col("r") > j))
    with_main = F.transform(upto("gm"), lambda s: cell(F.col("r"), -1 - s, F.lit(0)))
    from_main = F.transform(upto("gf"), lambda i: cell(i, -1 - F.col("r"), F.lit(1)))
    alone = F.array(cell(F.lit(0), F.lit(0), F.lit(0)))
    cells = F.explode(F.when(F.col("few") + F.col("in_main") <= CELL, alone).when(in_few, F.concat(among_few, with_main)).otherwise(from_main)).alias("cell")
    rows = rows.select("key", "node", "size", "comp", cells).select("key", "cell.*", "node", F.col("size").cast("long").alias("size"), "comp")
    first_keys = groups.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("keys"))
    # a cell asks only for the keys below its own
    below = F.filter("keys", lambda z: z < F.col("key")).alias("keys")
    rows = rows.join(signatures.select("node", "sig").join(first_keys, "node"), "node").select("key", "i", "j", "side", "node", "size", "comp", "sig", below)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(task(_close(percent)), "key long, i int, j int, side int, node long, comp long")


def drop_similar(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component (that of its smallest doc_id); rows with empty sets all stay."""
    found = similar_documents(docs, percent, width).select(F.col("key").alias("_key"), "n_shingles", "first_key").distinct()
    stay = found.where("n_shingles = 0 or _key = first_key").select("_key", F.col("n_shingles").alias("_n"))
    joined = docs.withColumn("_key", row_key("doc_id", "text")).join(stay, "_key")
    apart = F.when(F.col("_n") == 0, F.monotonically_increasing_id()).otherwise(F.lit(0))
    return joined.withColumn("_u", apart).dropDuplicates(["_key", "_u"]).select(*docs.columns)
