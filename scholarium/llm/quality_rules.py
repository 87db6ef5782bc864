"""Quality rules: tokeniser fertility beside plain counts.

Each document is measured against two public vocabularies, word by word:
characters per token and the entropy of its token ids (byte-level BPE), and the
share of byte-fallback pieces (BPE with byte fallback).  One map over the
documents measures; a task holds one batch and two bounded caches.  One small
aggregate then takes median and quartiles of each language or script by length
class, and what lies far outside its group is rejected, as is what lies outside
the wide fixed ``bands``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import materialize, small_batches, task, text_bytes
from .shingles import windows

_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_SCRIPTS = {
    "latin": "A-Za-zÀ-ÖØ-öø-ɏ",
    "greek": "Ͱ-Ͽ",
    "cyrillic": "Ѐ-ӿ",
    "arabic": "؀-ۿ",
    "devanagari": "ऀ-ॿ",
    "han_kana": "぀-ヿ㐀-鿿",
    "hangul": "가-힯",
}
_SCRIPT_RX = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}


@dataclass(frozen=True)
class Band:
    """Accepted ranges, ends included.  Entropy is in bits, over the ids of a document."""

    chars_per_token: tuple[float, float] = (1.0, 12.0)
    byte_fallback: float = 0.05
    entropy: tuple[float, float] = (2.0, 14.0)


@dataclass(frozen=True)
class Rules:
    byte_path: str = field(default_factory=lambda: vocab.default_path("byte_bpe_50k.tiktoken"))
    piece_path: str = field(default_factory=lambda: vocab.default_path("piece_bpe_32k.model"))
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Texts with fewer tokens are too short for a stable rate; the plain rules alone judge them.
    min_tokens: int = 40
    #: Share beyond either end of a group's band, were its measures normal with the group's median and quartiles.
    tail_share: float = 0.001
    #: Smaller groups, counted without near copies, are too small for quartiles; the fixed bands alone judge them.
    min_group: int = 100
    #: Outer limits that hold in any corpus.
    bands: dict[str, Band] = field(
        default_factory=lambda: {
            "en": Band((1.5, 6.5), 0.02, (4.2, 13.0)),
            "de": Band((1.45, 6.5), 0.02, (4.2, 13.0)),
            "fr": Band((1.45, 6.5), 0.02, (4.0, 13.0)),
            "es": Band((1.35, 6.5), 0.02, (4.0, 13.0)),
            "latin": Band((1.3, 7.5), 0.05, (3.5, 13.5)),
            "han_kana": Band((0.3, 3.0), 0.6, (3.0, 13.5)),
            "hangul": Band((0.3, 3.0), 0.6, (3.0, 13.5)),
            "other": Band((0.3, 12.0), 0.9, (2.0, 14.0)),
        }
    )


def script_of(text: str) -> str:
    """The script of most letters of a text; 'other' without any."""
    counts = {k: len(rx.findall(text)) for k, rx in _SCRIPT_RX.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def repeated_words(words: list[bytes], width: int = 5) -> tuple[int, int]:
    """Words inside windows of ``width`` words that stand twice or more in the text, and the least hash of a window, which near copies mostly share."""
    if len(words) < width:
        return 0, 0
    h = windows(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), width)
    ordered = np.sort(h)
    least = int(ordered[:1].view(np.int64)[0])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0, least
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(np.isin(h, twice))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum()), least


def plain_counts(text: bytes) -> dict:
    words = text.split()
    seen: set[bytes] = set()
    duplicate = 0
    for line in text.split(b"\n"):
        if line.strip():
            duplicate += line in seen
            seen.add(line)
    repeated, least = repeated_words(words)
    return {
        "words": words,
        "n_words": len(words),
        "word_chars": len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, _BLANK))),
        "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)),
        "n_dup_lines": duplicate,
        "n_repeat_words": repeated,
        "least": least,
    }


class Fertility:
    """Token measures of a document: ids of its words, each taken after a space, and pieces of its text."""

    def __init__(self, rules: Rules):
        self.byte, self.piece = vocab.byte_bpe(rules.byte_path), vocab.piece_bpe(rules.piece_path)

    def __call__(self, text: bytes, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, byte-fallback share, entropy; zeros without words."""
        if not words:
            return 0, 0.0, 0.0, 0.0
        ids = np.sort(self.byte.word_ids(words))
        ends = np.flatnonzero(np.append(ids[1:] != ids[:-1], True))
        share = np.diff(ends, prepend=-1) / len(ids)
        fallback = self.piece.fallback_share(text.decode("utf-8", "replace"))
        return len(ids), chars / len(ids), fallback, float(-(share * np.log2(share)).sum())


def verdict(rules: Rules, lang: str | None, text: bytes, tokens: int, rate: float, fallback: float, entropy: float) -> tuple[str, str]:
    """The band's name, and the first measure outside it ('' if none)."""
    name = lang if lang in rules.bands else script_of(text.decode("utf-8", "replace"))
    band = rules.bands.get(name, rules.bands["other"])
    if tokens < rules.min_tokens:
        return name, ""
    if not band.chars_per_token[0] <= rate <= band.chars_per_token[1]:
        return name, "chars_per_token"
    if fallback > band.byte_fallback:
        return name, "byte_fallback"
    if not band.entropy[0] <= entropy <= band.entropy[1]:
        return name, "entropy"
    return name, ""


OUTPUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, byte_fallback_share double, token_entropy double, band string, reason string, "
    "base_failed boolean, kept boolean"
)


def _length_class():
    return F.floor(F.log2("n_tokens")).cast("int")


def group_bands(measured: DataFrame, rules: Rules) -> list[tuple]:
    """Ranges by band name and length class: (band, class, lowest and highest rate, highest fallback share, lowest and highest entropy).

    Of near copies, rows that share their least window, one counts, so that no
    large group of them narrows the range.  None stands for a measure that does
    not vary in its group.
    """
    usable = measured.where(~F.col("base_failed") & (F.col("n_tokens") >= rules.min_tokens)).withColumn("_class", _length_class())
    single = usable.groupBy("band", "_class", "_least").agg(F.min(F.struct("chars_per_token", "byte_fallback_share", "token_entropy")).alias("m"))
    quartiles = [F.percentile_approx(f"m.{c}", [0.25, 0.5, 0.75], 10_000).alias(c) for c in ("chars_per_token", "byte_fallback_share", "token_entropy")]
    normal = NormalDist()
    reach = normal.inv_cdf(1 - rules.tail_share) / (2 * normal.inv_cdf(0.75))

    def ends(q):
        wide = reach * (q[2] - q[0])
        return (q[1] - wide, q[1] + wide) if wide else (None, None)

    groups = single.groupBy("band", "_class").agg(F.count(F.lit(1)).alias("n"), *quartiles).where(F.col("n") >= rules.min_group).collect()  # band names by powers of two
    return [(r["band"], r["_class"], *ends(r["chars_per_token"]), ends(r["byte_fallback_share"])[1], *ends(r["token_entropy"])) for r in groups]


def quality_rules(docs: DataFrame, rules: Rules | None = None, keep_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id`` (and, with ``keep_text``, all of its columns), counts, measures and ``kept``.

    The measures are written once to the shared folder, with the kept columns.
    Null or empty text: all counts 0, base_failed.  Null or unknown language:
    the band of the main script.  Repeated rows are judged alike.  Columns of
    ``docs`` that clash with an output column are replaced by the output's.
    """
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    have = [c for c in docs.columns if c not in names]
    if "lang" not in have:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    keep = have if keep_text else ["doc_id"]
    # the text goes to Python once
    source = docs.select(*keep, *([] if "text" in keep else [text_bytes().alias("_bytes")]), F.col("lang").cast("string").alias("_lang"))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), OUTPUT, "_least long"])

    def run(batches):
        fertility = Fertility(rules)
        try:
            for batch in batches:
                yield judged_batch(fertility, batch)
        finally:
            del fertility
            vocab.release()

    def judged_batch(fertility, batch):
        rows = []
        texts = batch.column("text").cast(pa.binary()) if "text" in keep else batch.column("_bytes")
        for text, lang in zip(texts, batch.column("_lang").to_pylist(), strict=True):
            text = text.as_py() or b""
            c = plain_counts(text)
            least = c.pop("least")
            tokens, rate, fallback, entropy = fertility(text, c.pop("words"), c["word_chars"])
            failed = c["n_words"] < rules.min_words or 100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"]
            band, reason = verdict(rules, lang, text, tokens, rate, fallback, entropy)
            rows.append((*c.values(), tokens, rate, fallback, entropy, band, reason, failed, not failed and not reason, least))
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
        columns = [pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(OUTPUT.split(", "))]
        columns.append(pa.array([r[-1] for r in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *names, "_least"])

    measured = materialize(source.mapInArrow(task(run), schema), "measures")
    found = group_bands(measured, rules)
    if not found:
        return measured.drop("_least")
    bands = docs.sparkSession.createDataFrame(found, "band string, _class int, _r0 double, _r1 double, _f1 double, _e0 double, _e1 double")
    reason = (
        F.when((F.col("reason") != "") | (F.col("n_tokens") < rules.min_tokens), F.col("reason"))
        .when((F.col("chars_per_token") < F.col("_r0")) | (F.col("chars_per_token") > F.col("_r1")), "chars_per_token")
        .when(F.col("byte_fallback_share") > F.col("_f1"), "byte_fallback")
        .when((F.col("token_entropy") < F.col("_e0")) | (F.col("token_entropy") > F.col("_e1")), "entropy")
        .otherwise("")
    )
    judged = measured.withColumn("_class", _length_class()).join(F.broadcast(bands), ["band", "_class"], "left").withColumn("reason", reason)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("reason") == "")).select(*keep, *names)
