"""The registered queries on whole small tables, held against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholarium.llm import queries as Q
from scholarium.llm import suffix_dedup

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_quality_counts(spark, docs):
    got = Q.op1_quality_rules(spark, SF).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r["doc_id"], *(r[n] for n in names)) for r in got) == sorted((d, *brute.counts(t)) for d, t in docs)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_personal_spans(spark, docs):
    got = {r["doc_id"]: r for r in Q.op3_pii(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        spans = brute.personal(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        counted = Counter(k for k, *_ in spans)
        assert all(got[d][f"n_{k}"] == counted[k] for k in ("email", "ip", "card", "phone"))
        assert got[d]["spans"].startswith(joined)


def test_jaccard_components(spark, docs):
    got = Q.op4_jaccard_join(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute.components(docs)


def test_quality_classifier_held_out(spark):
    got = {r["doc_id"]: r for r in Q.op5_line_crf(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    good = [got[d]["score"] for d, q in labels.items() if q == 1 and d in got and got[d]["held_out"]]
    bad = [got[d]["score"] for d, q in labels.items() if q == 0 and d in got and got[d]["held_out"]]
    area = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert area > 0.9


@pytest.mark.parametrize(("most_reads", "block_windows", "hot_in_batch"), [(4096, 500_000, 64), (1, 500_000, 3), (1, 2000, 64)])
def test_suffix_removal(spark, docs, monkeypatch, most_reads, block_windows, hot_in_batch):
    monkeypatch.setattr(suffix_dedup, "HOT_IN_BATCH", hot_in_batch)
    monkeypatch.setattr(suffix_dedup, "MOST_READS", most_reads)
    monkeypatch.setattr(suffix_dedup, "BLOCK_WINDOWS", block_windows)
    got = Q.op6_suffix_dedup(spark, SF).collect()
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got]
    assert sorted(rows, key=repr) == brute.suffix_removed(docs)
    assert sorted(((r["doc_id"], r["n_passages"]) for r in got), key=repr) == brute.repeated_passages(docs)


def test_frequent_lines(spark, docs):
    got = Q.op7_line_dedup(spark, SF).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got), key=repr) == brute.frequent_lines(docs)


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in Q.op8_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == ids.keys()
    for d, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            part = np.array(ids[d][at : at + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[d])
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 1024 * max(2, 0.02 * len(sequences))


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    digest = {r["page_id"]: hashlib.sha256((r["html"] or "").encode()).hexdigest() for r in pages}
    size = {r["page_id"]: len((r["html"] or "").encode()) for r in pages}
    first = {}
    for p in sorted(digest):
        first.setdefault(digest[p], p)
    want = []
    for p in digest:
        again = size[p] >= 100 and first[digest[p]] != p
        want.append((p, size[p], digest[p], "revisit" if again else "response", first[digest[p]] if again else None))
    got = Q.op9_warc(spark, SF).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want)


def test_sharding_law(spark, docs):
    got = {r["doc_id"]: r for r in Q.op10_sharding(spark, SF).collect()}
    slots = defaultdict(list)
    for d, t in docs:
        r, raw = got[d], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == brute.jump(d, 8) and r["grown_shard"] == brute.jump(d, 9)
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination_finds_planted(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in Q.op2_decontaminate(spark, SF).collect()}
    exact = {(d, i["item_id"]) for d, t in docs for i in items if t and i["text"] and len(i["text"].split()) >= 6 and i["text"] in t}
    assert exact <= got
