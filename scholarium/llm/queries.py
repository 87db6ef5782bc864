"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, line_crf, line_dedup, packing, pii, prefix_trie, quality_rules, resampling, sharding, suffix_dedup, topk_search, warc
from .common import shared_dir, table, text_bytes


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", F.col("start").alias("first_word"), F.col("end").alias("end_word"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = pii.spans_text(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE)))
    return found.select("doc_id", *(number(k) for k in pii.BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score_documents(docs, model)
    return scored.select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "bad_share", "n_lines")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.keep_bitmaps(table(spark, sf_dir, "documents"), "frequent", 10)
    text = line_dedup.apply_bitmap(F.coalesce("text", F.lit("")), "keep")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/scholarium/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SHARDS = 8


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_bytes()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_bytes()).alias("text_crc32"),
        F.lit("key").alias("law"),
        sharding.jump_hash(F.col("doc_id"), SHARDS).alias("shard"),
        sharding.jump_hash(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
    out = sharding.number_slots(rows, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules,
            op2_decontaminate,
            op3_pii,
            op4_jaccard_join,
            op5_line_crf,
            op6_suffix_dedup,
            op7_line_dedup,
            op8_packing,
            op9_warc,
            op10_sharding,
            op11_prefix_trie,
            op12_topk_search,
            op13_resampling,
        )
    }


_OP7 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key
GROUP BY k.doc_id
"""

_OP4 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)
), edges AS (
  SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT d.doc_id, coalesce(max(sizes.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
GROUP BY d.doc_id
"""


#: The nibble table of CRC-32, and its step over the hex digits of a text's bytes.
_CRC_TABLE = """nibble AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM (SELECT unnest(range(16)) AS i))
)"""
_CRC = """xor(4294967295, list_reduce([4294967295] || range(2 * strlen({text})),
      lambda c, i: xor(t[(xor(c, strpos('0123456789ABCDEF', substr(hex(encode({text})), xor(i, 1) + 1, 1)) - 1) & 15) + 1], c >> 4)))"""

_OP11 = f"""
WITH {_CRC_TABLE}, turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, {_CRC.format(text="conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), nibble
), kept AS (
  SELECT c.conv_id, 0 AS own, b.pos, b.role, b.text FROM convs c JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN turns o ON o.conv_id = c.conv_id AND o.pos > c.h
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d FROM kept
), paths AS (
  SELECT conv_id, d, text, list(sha256(length(role) || ':' || role || ':' || text)) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, '', [] FROM convs
), lengths AS (
  SELECT conv_id, max(d) AS n FROM paths GROUP BY conv_id
), nodes AS (
  SELECT path, p.d AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS words,
         sha256(coalesce(string_agg(p.conv_id, ',' ORDER BY p.conv_id) FILTER (WHERE l.n = p.d), '')) AS ends_sha256
  FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY path, p.d
), children AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT list_slice(x.path, 1, a.depth) AS path, sum((x.n_convs - 1) * x.words) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes x LEFT JOIN children c ON c.path = x.path, LATERAL (SELECT unnest(range(0, x.depth + 1)) AS depth) a GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves,
       b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children c ON c.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""

_OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score, a.place
  FROM v a JOIN v b ON a.place <> b.place WHERE a.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY a.place ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id) <= 20
)
SELECT query_id, (row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM ranked
"""

_OP13 = f"""
WITH {_CRC_TABLE}, texts AS (
  SELECT 1 AS corpus, row_number() OVER () AS place, doc_id, text FROM documents
  UNION ALL SELECT 0, -row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT corpus, place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), features AS (
  SELECT corpus, place, array_to_string(list_slice(w, i, i + n - 1), ' ') AS f
  FROM words, (SELECT unnest([1, 2, 3]) AS n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), bucket AS (
  SELECT f, {_CRC.format(text="f")} % 10000 AS b FROM (SELECT DISTINCT f FROM features), nibble
), counted AS (
  SELECT b, count(*) FILTER (WHERE corpus = 1) AS s, count(*) FILTER (WHERE corpus = 0) AS t
  FROM features JOIN bucket USING (f) GROUP BY b
), gains AS (
  SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), weights AS (
  SELECT place, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM features JOIN bucket USING (f) JOIN gains USING (b) WHERE corpus = 1 GROUP BY place
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (place) WHERE corpus = 1
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND row_number() OVER w <= 5 * (count(*) FILTER (WHERE n_words >= 20) OVER ()) // 100 THEN row_number() OVER w END AS rank
FROM scored WINDOW w AS (ORDER BY n_words < 20, score DESC, doc_id NULLS FIRST)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": _OP4, "op7_line_dedup": _OP7, "op11_prefix_trie": _OP11, "op12_topk_search": _OP12, "op13_resampling": _OP13}
