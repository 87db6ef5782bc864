"""A trie of conversations by shared first turns, from an LCP-aware external mergesort.

A conversation is a path of turn digests.  Equal paths become one sequence with
the number, the smallest and the digest of its conversations.  The sort then
runs in Spark's own steps:

1. each task sorts batches of its sequences into runs; a run carries for each
   sequence the number of turns it shares with the one before it (LCP);
2. runs are written to the shared folder, then dealt by ranges of paths, so a
   task has a contiguous slice of every run;
3. a loser tree merges the slices of a range.  It compares LCPs first and turns
   only beyond a shared LCP, so no turn that is known to agree is compared
   again, and the LCP of each output with the one before it falls out;
4. the merged stream drives a stack of open nodes: a sequence closes all nodes
   deeper than its LCP, and a closed node is finished.

Nodes on the first or last path of a range may go on in a neighbouring range.
They leave the task as two *spines*, one row each, with what the range adds to
their nodes; one pass over the spines, two rows a range, finishes these nodes
with the same kind of stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, task

#: Bytes of a turn's digest.
WIDTH = 16
#: Bytes of paths in a sorted run, and in a range that one task merges.
RUN_BYTES = 8 << 20
RANGE_BYTES = 8 << 20

_EMPTY = hashlib.sha256(b"").hexdigest()


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each as its digest and number of words.

    Turns go by ``turn``, null first; turns that agree in it by their digest.
    Repeated rows are turns of their own.  Null role or text is empty.  Rows
    without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text).cast("binary")
    digest = F.unhex(F.substring(F.sha2(named, 256), 1, 2 * WIDTH))
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("k"), "turn", digest.alias("digest"), n_words(text).alias("words")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].cast("int").alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(seqs: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % group, h = crc32(decimal c) % (most + 1)."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    heads = seqs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    own = seqs.withColumn("_h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % group)
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.expr("slice(_head, 1, _h)"))
    rest = F.expr("slice(turns, _h + 1, greatest(size(turns) - _h, 0))")
    return own.join(heads, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, conv_id): one row per key, with the SHA-256 of its comma-joined ids.  Only the running hash is held."""
    key, sha, keys, out = None, None, [], []
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key:
                if sha:
                    keys.append(key)
                    out.append(sha.digest())
                key, sha = k, hashlib.sha256(b"%d" % c)
            else:
                sha.update(b",%d" % c)
        if len(keys) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["key", "ends"])
            keys, out = [], []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([*keys, key], pa.binary()), pa.array([*out, sha.digest()], pa.binary())], ["key", "ends"])


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(path, words, n, first, ends): one row per distinct path, combined before the shuffle; only ids go to the task that hashes them."""
    digests = F.transform("turns", lambda t: t["digest"])
    path = F.aggregate(digests, F.lit(b"").cast("binary"), lambda a, d: F.concat(a, d))
    rows = seqs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = rows.withColumn("key", F.unhex(F.sha2("path", 256)))
    paths = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.select("key", "conv_id").repartition(parts, "key").sortWithinPartitions("key", "conv_id").mapInArrow(task(_ended), "key binary, ends binary")
    return paths.join(ends, "key").drop("key")


def common_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two paths share, of which ``start`` are known to."""
    most = min(len(a), len(b)) // WIDTH
    while start < most and a[start * WIDTH : (start + 1) * WIDTH] == b[start * WIDTH : (start + 1) * WIDTH]:
        start += 1
    return start


_RUN = "run string, pos int, path binary, lcp int, words array<int>, n long, first long, ends binary"


def _runs(run_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        part, number, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, rows, held
            rows.sort(key=lambda r: r[0])
            lcps = [0] + [common_turns(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
            names = [x.split()[0] for x in _RUN.split(", ")]
            types = [pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary()]
            path, words, n, first, ends = zip(*rows, strict=True)
            columns = [[f"{part}-{number}"] * len(rows), list(range(len(rows))), path, lcps, words, n, first, ends]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            number, rows, held = number + 1, [], 0
            return out

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "n", "first", "ends")), strict=True):
                rows.append(r)
                held += 64 + 2 * len(r[0])
                if held > run_bytes:
                    yield flush()
        if rows:
            yield flush()

    return run


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, position, LCP with the output before) in path order, from sorted runs of (paths, LCPs), by a loser tree.

    Every path that waits in the tree has an LCP with the last output.  Of two,
    the longer LCP is the smaller path; only where they are equal are turns
    compared, from there on, and the loser's LCP with the winner is what the
    comparison found.
    """
    k = max(1, len(runs))
    at, lcp = [0] * k, [0] * k
    done = lambda r: r >= len(runs) or at[r] >= len(runs[r][0])

    def beats(a: int, b: int) -> bool:
        """Whether a's path goes first; the loser then knows its LCP with the winner."""
        if done(a) or done(b):
            return not done(a)
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        x, y = runs[a][0][at[a]], runs[b][0][at[b]]
        same = common_turns(x, y, lcp[a])
        first = x[same * WIDTH :] <= y[same * WIDTH :]
        lcp[b if first else a] = same
        return first

    losers = [0] * k
    # play bottom up: node i has children 2i and 2i + 1; leaves are k to 2k - 1
    winner = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while not done(top):
        yield top, at[top], lcp[top]
        at[top] += 1
        if not done(top):
            lcp[top] = runs[top][1][at[top]]  # with the one before it in its run, the last output
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                top, losers[node] = losers[node], top
            node //= 2


class _Node:
    """An open node: what is known so far of the conversations below it."""

    __slots__ = ("children", "ends", "leaves", "left", "n", "first", "saved", "waiting", "words")

    def __init__(self, words: int, left: bool):
        self.words, self.left, self.ends = words, left, None
        self.n, self.first, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.waiting: list[int] = []  # rows of finished children, which still lack this node's conv_id

    def add(self, n: int, first: int | None) -> None:
        self.n += n
        if first is not None and (self.first is None or first < self.first):
            self.first = first

    def close(self) -> None:
        """All of its conversations are known."""
        self.leaves += self.children == 0
        self.saved += (self.n - 1) * self.words


_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, side int"
_SPINE = "path binary, n array<long>, first array<long>, children array<long>, leaves array<long>, saved array<long>, words array<int>, ends array<binary>"
_NODE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
_SPINE_TYPES = [pa.binary(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.int32()), pa.list_(pa.binary())]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _out(nodes: list[list], spines: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Node rows and spine rows under one schema: a spine has null node columns but part and side, a node no path."""
    names, types = _names(_NODE) + _names(_SPINE), _NODE_TYPES + _SPINE_TYPES
    for a in range(0, len(nodes), 10_000):
        columns = list(zip(*nodes[a : a + 10_000], strict=True))
        n = len(columns[0])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, *[[None] * n] * len(_SPINE_TYPES)], types, strict=True)], names)
    if spines:
        columns = [[None] * len(spines)] * 8 + list(zip(*spines, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a range's slices of runs; gives its finished nodes, and its first and last paths as spines."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    slices: dict[str, tuple[list, list, list]] = {}
    for batch in batches:
        for run, path, lcp, *rest in zip(*(batch.column(c).to_pylist() for c in ("run", "path", "lcp", "words", "n", "first", "ends")), strict=True):
            paths, lcps, more = slices.setdefault(run, ([], [], []))
            lcps.append(lcp if paths else 0)  # the one before it may be in another range
            paths.append(path)
            more.append(rest)
    runs = list(slices.values())
    nodes: list[list] = []
    stack: list[_Node] = []
    left: list[_Node] = []

    def pop() -> None:
        node = stack.pop()
        if node.left:
            left.append(node)
            return
        node.close()
        parent = stack[-1]
        row = len(nodes)
        nodes.append([node.first, len(stack), None, node.n, node.children, node.leaves, node.saved, node.ends.hex() if node.ends else _EMPTY, None, None])
        for child in node.waiting:
            nodes[child][2] = node.first
        parent.add(node.n, node.first)
        parent.children += 1
        parent.leaves += node.leaves
        parent.saved += node.saved
        parent.waiting.append(row)

    first_path = path = b""
    for run, pos, lcp in merge([(paths, lcps) for paths, lcps, _ in runs]):
        path, (words, n, first, ends) = runs[run][0][pos], runs[run][2][pos]
        begins = not stack
        if begins:
            stack.append(_Node(0, True))
            first_path = path
        while len(stack) > lcp + 1:
            pop()
        for w in words[lcp:]:
            stack.append(_Node(w, begins))
        stack[-1].add(n, first)
        stack[-1].ends = ends
    if not stack:
        return
    # what is open lies on the last path; nodes of the first path that are closed already are in left, deepest first
    right = [_Node(x.words, False) if x.left else x for x in stack]
    lefts = [x for x in stack if x.left] + left[::-1]

    spines = []
    for side, (spine, held) in enumerate(((first_path, lefts), (path, right))):
        for depth, node in enumerate(held):
            for row in node.waiting:
                nodes[row][8:] = part, side
        spines.append((part, side, spine, *([getattr(x, c) for x in held] for c in ("n", "first", "children", "leaves", "saved", "words", "ends"))))
    yield from _out(nodes, spines)


def _spine_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all spines in path order: the nodes on them, and for each (part, side, depth) the conv_id of its node.

    The result has the columns of a node; a row with a part names a node for
    the children that wait for it, the others are nodes.
    """
    rows: list[list] = []
    stack: list[_Node] = []
    where: list[list[tuple[int, int]]] = []  # the spines on which each open node lies
    last = b""

    def pop() -> None:
        node = stack.pop()
        spines = where.pop()
        node.close()
        row = [node.first, len(stack), None, node.n, node.children, node.leaves, node.saved, node.ends.hex() if node.ends else _EMPTY, None, None]
        for child in node.waiting:
            rows[child][2] = node.first
        at = len(rows)
        rows.append(row)
        rows.extend([node.first, len(stack), None, None, None, None, None, None, part, side] for part, side in spines)
        if stack:
            parent = stack[-1]
            parent.add(node.n, node.first)
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.waiting.append(at)

    columns = ("part", "side", "path", "n", "first", "children", "leaves", "saved", "words", "ends")
    for batch in batches:
        for part, side, path, n, first, children, leaves, saved, words, ends in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            keep = common_turns(last, path) + 1
            while len(stack) > keep:
                pop()
            for depth in range(len(n)):
                if depth == len(stack):
                    stack.append(_Node(words[depth], True))
                    where.append([])
                node = stack[depth]
                node.add(n[depth], first[depth])
                node.children += children[depth]
                node.leaves += leaves[depth]
                node.saved += saved[depth]
                node.ends = node.ends or ends[depth]
                where[depth].append((part, side))
            last = path
    while stack:
        pop()
    yield from _out(rows, [])


def prefix_trie(seqs: DataFrame, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id long, turns array<struct<digest, words>>).

    A node is a distinct sequence of first ``depth`` turns, the root has none.
    conv_id: its smallest member, so that a node's turns are the first ``depth``
    ones of that conversation; parent_conv_id (root: null); n_convs, members;
    n_children; n_leaves, childless nodes of its subtree; saved_tokens, over the
    subtree, (n_convs - 1) times the words of each node's last turn; ends_sha256,
    the SHA-256 of the decimal ids that end at the node, ascending and
    comma-joined.

    Other columns are not read, so their names are no matter.  Conversations
    without turns are members of the root.  A conv_id that stands twice is two
    members.  An empty table gives no node, not even a root.  A conversation is
    one row, so its turns' digests must fit in one; texts of any length do, as
    only digests travel.
    """
    spark = seqs.sparkSession
    small_batches(spark)
    one = materialize(distinct_sequences(seqs).mapInArrow(task(_runs(run_bytes)), _RUN), "runs")
    size = one.agg(F.sum(F.octet_length("path") + F.lit(64))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    ranged = one.repartitionByRange(parts, "path").sortWithinPartitions("run", "pos")
    found = materialize(ranged.mapInArrow(task(_range_nodes), f"{_NODE}, {_SPINE}"), "nodes")
    # two rows a range
    spines = found.where("path is not null").select("part", "side", *_names(_SPINE)).repartition(1).sortWithinPartitions("part", "side")
    ends = materialize(spines.mapInArrow(task(_spine_nodes), f"{_NODE}, {_SPINE}").select(*_names(_NODE)), "spines")
    nodes = found.where("path is null")
    # children of a spine's nodes wait under (part, side, depth), so those of one node are spread over its ranges
    names = ends.where("part is not null").select("part", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("named"))
    waiting = nodes.where("part is not null").join(names, ["part", "side", "depth"]).withColumn("parent_conv_id", F.col("named"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = [x.select(*out) for x in (nodes.where("part is null"), waiting, ends.where("part is null"))]
    return whole[0].unionAll(whole[1]).unionAll(whole[2]).withColumn("depth", F.col("depth").cast("long"))
