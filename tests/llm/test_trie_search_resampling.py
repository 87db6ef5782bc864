"""The prefix trie, exact top-k search and importance resampling against brute force, on registered queries and odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarium.llm import prefix_trie, resampling, topk_search
from scholarium.llm import queries as Q

from . import brute

SF = "/root/testdata/sf0.001"


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# conversations


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()[:32]
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in convs.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out.append((c, own.get(c - c % 20, [])[:h] + turns[h:]))
    return out


def trie(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        words = len(brute.WORD.findall(path[-1][1])) if path else 0
        saved[path] = sum(saved[x] for x in children[path]) + (len(members[path]) - 1) * words
    digest = lambda path: hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sizes", [{}, {"run_bytes": 1500, "range_bytes": 700}])
def test_trie_of_small_tables(spark, sizes):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
        got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(rows)), **sizes)
        same(got.collect(), trie(rebuilt(map(tuple, rows.collect()))))


def test_trie_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    same(Q.op11_prefix_trie(spark, SF).collect(), trie(rebuilt(map(tuple, rows))))


def test_trie_of_random_sequences(spark):
    r = np.random.default_rng(3)
    for n, letters, longest in ((300, 2, 9), (80, 3, 4), (40, 1, 30), (1, 1, 3)):
        convs = [(int(c), [("u", f"w{r.integers(letters)} " * int(r.integers(1, 4))) for _ in range(r.integers(0, longest))]) for c in range(n)]
        rows = [(c, k, role, text) for c, turns in convs for k, (role, text) in enumerate(turns)]
        got = prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)), run_bytes=900, range_bytes=300)
        same(got.collect(), trie([(c, turns) for c, turns in convs if turns]))


def test_trie_of_odd_rows(spark):
    long = "word " * 200_000
    rows = [(20, None, None, None), (20, 1, "user", "a b"), (20, 1, "user", "a b"), (20, 1, None, "c"), (21, 0, "user", ""), (22, 5, None, None), (40, 1, "x", long), (41, 1, "x", long), (None, 1, "u", "lost"), (39, -1, "é", "  b\tc"), (-1, 0, "u", "n"), (-20, 0, "u", "n"), (61, 0, "u", "own"), (61, 1, "u", "own")]
    df = spark.createDataFrame([(*x, "k", 1, "p") for x in rows], TURNS + ", path string, n long, run string")
    same(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(df).withColumn("key", F.lit(1)))).collect(), trie(spark_rebuilt(rows)))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(df.limit(0)))).count() == 0
    turnless = spark.createDataFrame([(7, []), (3, []), (7, [])], "conv_id long, turns array<struct<digest binary, words int>>")
    assert [tuple(r) for r in prefix_trie.prefix_trie(turnless).collect()] == [(3, 0, None, 3, 0, 1, 0, hashlib.sha256(b"3,7,7").hexdigest())]


def spark_rebuilt(rows):
    """``rebuilt`` with the remainder's sign of SQL."""
    out = dict(rebuilt(rows))
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn, role or "", text or ""))
    for c in (-1,):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        heads = [x[1:] for x in own.get(base, [])][:h]
        out[c] = heads + [x[1:] for x in own[c]][h:]
    return list(out.items())


def test_loser_tree():
    r = np.random.default_rng(5)
    for k in (1, 2, 3, 5, 8):
        paths = sorted({b"".join(bytes([r.integers(2)]) * prefix_trie.WIDTH for _ in range(r.integers(0, 7))) for _ in range(60)})
        runs = [[p for p in paths if hash((p, k)) % k == i] for i in range(k)]
        with_lcp = [(x, [0] + [prefix_trie.common_turns(a, b) for a, b in zip(x, x[1:], strict=False)]) for x in runs]
        out = list(prefix_trie.merge(with_lcp))
        merged = [runs[i][at] for i, at, _ in out]
        assert merged == paths
        assert [lcp for *_, lcp in out] == [0] + [prefix_trie.common_turns(a, b) for a, b in zip(merged, merged[1:], strict=False)]
    assert list(prefix_trie.merge([])) == [] and list(prefix_trie.merge([([], [])])) == []


# embeddings


def best(rows, k=20, scale=64):
    whole = [(i, [math.floor(scale * float(np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(whole):
        if i % 20:
            continue
        clip = lambda s: min(max(s, -(2**63 - 1)), 2**63 - 1)
        scored = [(-clip(sum(a * b for a, b in zip(q, v, strict=False))), j) for other, (j, v) in enumerate(whole) if other != at]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return out


EMBEDDED = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("sizes", [{}, {"block": 70, "batch": 8, "first_blocks": 1}])
def test_search_of_a_small_table(spark, sizes):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    want = best(map(tuple, df.collect()))
    same(topk_search.top_k(df, F.col("vec_id") % 20 == 0, **sizes).collect(), want)
    if not sizes:
        same(Q.op12_topk_search(spark, SF).collect(), want)


def test_search_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (20, [1.0]), (40, []), (60, None), (80, [None, 1.0]), (100, [nan]), (120, [inf, 0.0]), (None, [1.0]), (7, [0.0, 0.0]), (5, [0.5, -0.25]), (6, [0.5, -0.25, 9.0]), (-20, [-0.001, -3.0]), (140, [3e38, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], EMBEDDED + ", block int, row string, query boolean")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=3, block=4, batch=2, first_blocks=1).collect()
    most = 2**63 - 1
    plain = [(i, v) if i != 140 else (i, [most / 64, 1.0]) for i, v in rows]  # components beyond a long become its ends
    want = best(plain, 3)
    assert {(q, r, j) for q, r, j, _ in got} == {(q, r, j) for q, r, j, _ in want}
    same([r for r in got if 140 not in (r[0], r[2])], [r for r in want if 140 not in (r[0], r[2])])
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk_search.top_k(df, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("high", [3, 40, 1 << 20, 1 << 34])
@pytest.mark.parametrize("copies", [0, 300])
def test_walk_is_exact(high, copies):
    r = np.random.default_rng(high % 1000 + copies)
    v = r.integers(-high, high + 1, (500, 24))
    v[:copies] = v[0]
    q = np.concatenate([v[:30], r.integers(-high, high + 1, (10, 24))])
    own = np.array([*range(30), *[-1] * 10])
    scores = v.astype(object) @ q.astype(object).T
    for taus in (np.full(40, -topk_search._MOST), np.array([min(int(sorted(scores[:, j])[-25]), topk_search._MOST) for j in range(40)])):
        which, row, got = topk_search.search(v, topk_search.segments(v), q, taus, own, 20)
        for j in range(40):
            clip = lambda s: min(max(int(s), -topk_search._MOST), topk_search._MOST)
            want = sorted((-clip(scores[i, j]), i) for i in range(500) if i != own[j])[:20]
            assert [(-s, i) for s, i in zip(got[which == j].tolist(), row[which == j].tolist(), strict=True)] == [x for x in want if -x[0] >= taus[j]]


# resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate(brute.UPPER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(docs, target):
    rows = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for d, n, f in rows:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(order[: 5 * len(order) // 100], 1):
        r[5] = place
    return [tuple(r) for r in out]


@pytest.mark.parametrize("sizes", [{}, {"long_bytes": 300, "chunk_bytes": 64}, {"long_bytes": 0, "chunk_bytes": 1}])
def test_resampling_of_a_small_table(spark, sizes):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    same(resampling.resample(docs, target, **sizes).collect(), want)
    if not sizes:
        same(Q.op13_resampling(spark, SF).collect(), [(d, n, w, s, r) for d, _, n, w, s, r in want])


@pytest.mark.parametrize("sizes", [{}, {"long_bytes": 40, "chunk_bytes": 16}])
def test_resampling_of_odd_rows(spark, sizes):
    many = " ".join(f"w{i % 97}" for i in range(120_000))  # over half a megabyte
    texts = [None, "", " \n", "One", "one TWO", "ÄÖ straße x", "a" * 70_000, "é" * 100 + " b", many, many, "x-y_z 1.5\x7f q", " ".join(["same"] * 25), *(" ".join(f"v{(i * k) % 31}" for i in range(22)) for k in range(30))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(8, many), (8, many), (None, texts[-1]), (11, texts[11])]
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], "doc_id long, text string, id string, piece long, carry long, score long")
    target = spark.createDataFrame([(1, "v1 v2 v3 one two"), (2, None), (3, many)], "item_id long, text string")
    got = resampling.resample(df, target, **sizes).collect()
    same(got, resampled(rows, [r["text"] for r in target.collect()]))
    none = resampling.resample(df, target.limit(0), **sizes).collect()
    same(none, resampled(rows, []))
    assert resampling.resample(df.limit(0), target, **sizes).count() == 0


def test_crc_of_joined_words():
    words = [b"a", b"", b"bc" * 31, b"d" * 63, b"e" * 64, b"f" * 65, b"g" * 5000, "é".encode()]
    for a in words:
        for b in words:
            got = resampling.crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
            assert got[0] == zlib.crc32(a + b)
