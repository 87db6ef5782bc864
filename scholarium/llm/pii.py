"""Personal data by weak supervision, in DataFrame functions alone.

Regular expressions propose spans.  Three labelers vote on each (a strict form,
a gazetteer, words before the span); expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is, without any labelled
text; a logistic classifier learns from the resulting probabilities and decides
on the spans beyond the four base kinds.  Only pattern counts, whose number is
bounded by the kinds, votes and features, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("spelled_email", "iban", "ssn", "name", "secret")
KINDS = BASE + ADDED
CONTEXT = 32
#: Spans that are placed together.
PIECE = 128

# The patterns of the base kinds.  Quantifiers are possessive where nothing that follows could take
# characters back, and a look-behind skips starts inside a run that already failed; matches stay the same.
_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",  # runs of fewer digits are dropped by length in any case
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "spelled_email": r"\b[A-Za-z0-9._%+-]{1,64} ?[\(\[]at[\)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\(\[]dot[\)\]]|\.) ?[A-Za-z]{2,63}){1,4}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.? \p{Lu}\p{Ll}{1,40}+(?: \p{Lu}\p{Ll}{1,40}+)?",
    "secret": r"\b(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key)[\"']? ?[=:] ?[\"'][^\s\"']{8,512}+[\"']|\b(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36})\b",
}
#: A text without this cannot match.
HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]", "spelled_email": "[\\(\\[]at[\\)\\]]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "name": "(?:M[rs]s?|Dr|Prof|Herr|Frau|Mme|Mlle|Sra?)\\.? \\p{Lu}", "secret": "[=:] ?[\"']|AKIA|gh[opsu]_"}
STRICT = {
    # no label begins or ends with a hyphen; look-aheads over classes alone, since Java's matcher recurses on repeated groups
    "email": r"^(?!.*@-)(?!.*-\.)(?!.*\.-)(?!.*-$)[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*\.[A-Za-z]{2,63}$",
    "ip": r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -]?[0-9]{1,3})?)$",
    "phone": r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]+(?:[ .-][0-9]+){0,4}$",
    "spelled_email": r"[\(\[]dot[\)\]]",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?)$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "name": r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
    "secret": r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_.=-]{16,}",
}
# Public code tables that the gazetteer labeler looks a part of each span up in.
TOP_DOMAINS = "com org net edu gov mil int io info biz app dev ai me co eu de at ch fr be lu nl es pt it uk ie dk se no fi pl cz sk hu ro bg gr tr ru ua us ca mx br ar cl pe au nz jp cn kr in za il".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 852 886 961 962 966 971 972".split()
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
CARD_PREFIXES = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 35 6011 65 36 38 62".split()
GIVEN_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Anna "
    "Peter Maria Hans Ursula Klaus Monika Wolfgang Petra Stefan Sabine Andreas Claudia Pierre Marie Jean Nathalie Philippe Isabelle Nicolas Camille Antonio Carmen Manuel Josefa Francisco Isabel Carlos Ana Luis Pilar"
).split()
SECRET_NAMES = "token secret password passwd api_key api-key apikey access_key access-key private_key".split()


def _in_gazetteer(kind: str, m: Column) -> Column:
    """Whether a code table holds the part of a span that it knows."""
    if kind in ("email", "spelled_email"):
        # an unanchored X+$ starts anew at each character, so it sees no more than a label can hold
        return F.lower(F.regexp_extract(F.right(m, F.lit(64)), r"([A-Za-z]{1,63})$", 1)).isin(TOP_DOMAINS)
    if kind == "ip":
        return ~m.rlike(r"^0*(?:0|10|127|2[2-5][0-9])\.|^192\.168\.|^169\.254\.")  # ranges not for public hosts
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.left(digits, F.lit(1)).isin(CARD_PREFIXES) | F.left(digits, F.lit(2)).isin(CARD_PREFIXES) | F.left(digits, F.lit(4)).isin(CARD_PREFIXES)
    if kind == "phone":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.left(digits, F.lit(1)).isin(CALLING_CODES) | F.left(digits, F.lit(2)).isin(CALLING_CODES) | F.left(digits, F.lit(3)).isin(CALLING_CODES)
    if kind == "iban":
        lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
        return F.coalesce(F.try_element_at(lengths, F.left(m, F.lit(2))) == F.length(F.regexp_replace(m, " ", "")), F.lit(False))
    if kind == "ssn":
        return m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")  # areas, groups and serials that are issued
    if kind == "name":
        return F.regexp_extract(m, r" (\p{Lu}\p{Ll}+)", 1).isin(GIVEN_NAMES)
    return F.lower(F.regexp_extract(m, r"^([A-Za-z_-]+)", 1)).isin(SECRET_NAMES) | m.rlike("^(?:AKIA|gh[opsu]_)")


WORDS_BEFORE = {
    "email": r"(?i)e-?mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|addr|login",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|mobile|fax|anruf",
    "spelled_email": r"(?i)e-?mail|contact|write|kontakt|correo|courriel",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social",
    "name": r"(?i)name|from|by|von|par|por|dear|signed",
    "secret": r"(?i)key|login|auth|config|export|user",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - F.lit(48))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _vote(kind: str, m: Column, before: Column) -> list[Column]:
    """1: personal, 0: not, 2: no opinion."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    return [
        yes(m.rlike(STRICT[kind])).alias("v1"),
        yes(_in_gazetteer(kind, m)).alias("v2"),
        F.when(before.rlike(WORDS_BEFORE[kind]), 1).otherwise(2).alias("v3"),
    ]


_FOUND = "array<struct<start:int,end:int,m:string,before:string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: an array of candidate spans with kind, place, votes and features, per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<string>")
    cut = rows
    for k in KINDS:
        hint = F.col("text").contains("@") if k == "email" else F.col("text").rlike(HINT[k])
        cut = cut.withColumn(f"p_{k}", F.when(hint, F.split("text", PATTERN[k], -1)).otherwise(none))
        cut = cut.withColumn(f"m_{k}", F.when(hint, F.regexp_extract_all("text", F.lit(PATTERN[k]), F.lit(0))).otherwise(none))
    cut = cut.drop("text")
    placed = ["doc_id"]
    for k in KINDS:
        pairs = F.arrays_zip(F.slice(f"p_{k}", F.lit(1), F.size(f"m_{k}")).alias("p"), F.col(f"m_{k}").alias("m"))

        def step(a: Column, x: Column) -> Column:
            start = a["pos"] + F.length(x["p"])
            end = start + F.length(x["m"])
            span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["p"], F.lit(CONTEXT)).alias("before"))
            return F.struct(end.alias("pos"), F.array_append(a["out"], span).alias("out"))

        # A fold that appends copies its array each time, so it runs within pieces of PIECE spans and then over the pieces.
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(_FOUND).alias("out"))
        n = F.size(f"m_{k}")
        numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))
        def shift(a: Column, x: Column) -> Column:
            moved = F.transform(x["out"], lambda s: F.struct((s["start"] + a["pos"]).alias("start"), (s["end"] + a["pos"]).alias("end"), s["m"].alias("m"), s["before"].alias("before")))
            return F.struct((a["pos"] + x["pos"]).alias("pos"), F.array_append(a["out"], moved).alias("out"))

        whole = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_FOUND}>").alias("out"))
        placed_in = lambda z: F.transform(numbers, lambda b: F.aggregate(F.slice(z, b * PIECE + 1, F.lit(PIECE)), start, step))
        # the one-element array binds the pairs to a name, so that they are made once
        spans = F.element_at(F.transform(F.array(pairs), lambda z: F.flatten(F.aggregate(placed_in(z), whole, shift, lambda a: a["out"]))), 1)

        def judged(s: Column) -> Column:
            size = F.length(s["m"])
            return F.struct(
                F.lit(k).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                *_vote(k, s["m"], s["before"]),
                F.when(s["before"].rlike(r"(?:^|[\s\"'(:])$"), 1).otherwise(0).alias("f1"),
                F.when(size >= 12, 1).otherwise(0).alias("f2"),
                F.when(s["m"].rlike("[0-9]"), 1).otherwise(0).alias("f3"),
            )

        placed.append(F.transform(F.filter(spans, lambda s: _valid(k, s["m"])), judged).alias(f"s_{k}"))
    return cut.select(*placed).select("doc_id", F.concat(*(F.col(f"s_{k}") for k in KINDS)).alias("found"))


@dataclass
class Pattern:
    kind: str
    votes: tuple[int, ...]
    features: tuple[int, ...]
    count: int
    probability: float = 0.5


def estimate(patterns: list[Pattern], turns: int = 30) -> dict:
    """Labeler reliabilities P(vote | truth) and priors by kind, by expectation-maximisation; sets each probability."""
    n = len(patterns[0].votes) if patterns else 3
    for p in patterns:
        said = [v for v in p.votes if v != 2]
        p.probability = (sum(said) + 1) / (len(said) + 2)
    prior, rate = {}, []
    for _ in range(turns if patterns else 0):
        for kind in {p.kind for p in patterns}:
            own = [p for p in patterns if p.kind == kind]
            prior[kind] = (sum(p.count * p.probability for p in own) + 1) / (sum(p.count for p in own) + 2)
        rate = []
        for j in range(n):
            table = {}
            for truth in (0, 1):
                weight = [0.2, 0.2, 0.2]
                weight[truth] += 1.0  # a labeler is presumed better than chance
                for p in patterns:
                    weight[p.votes[j]] += p.count * (p.probability if truth else 1 - p.probability)
                total = sum(weight)
                table[truth] = [w / total for w in weight]
            rate.append(table)
        for p in patterns:
            logit = math.log(prior[p.kind] / (1 - prior[p.kind]))
            for j, v in enumerate(p.votes):
                logit += math.log(rate[j][1][v] / rate[j][0][v])
            p.probability = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    return {"prior": prior, "labelers": rate}


def _inputs(p: Pattern) -> list[float]:
    return [1.0, *(float(p.kind == k) for k in KINDS), float(p.votes[0] == 1), float(p.votes[1] == 1), float(p.votes[2] == 1), *map(float, p.features)]


def train(patterns: list[Pattern], turns: int = 150, step: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier for the probabilities of the patterns, weighted by their counts."""
    rows = [(_inputs(p), p.probability, math.log1p(p.count)) for p in patterns]
    weights = [0.0] * (1 + len(KINDS) + 6)
    total = sum(c for *_, c in rows) or 1.0
    for _ in range(turns if rows else 0):
        slope = [decay * w for w in weights]
        for x, y, c in rows:
            z = sum(w * v for w, v in zip(weights, x, strict=True))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * c / total
            for i, v in enumerate(x):
                if v:
                    slope[i] += error * v
        weights = [w - step * 4 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and ``spans`` (array of kind, start, end, probability), one row per input row.

    Places count code points, end exclusive; spans stand by kind as in KINDS,
    then by start.  Base kinds always stay; others if the classifier gives
    ``threshold`` or more.  Null or empty text: no spans; an empty table: no
    rows.  Repeated rows are rows of their own and count so in what is learned.
    Spans of two kinds may overlap; of one kind they don't, and the leftmost
    stands.  Only doc_id and text are read, so other columns' names are no
    matter; null ids are ids like any other.  Time grows in proportion to a
    text's length, whatever it holds: every pattern is anchored, bounded or
    skips starts inside a run that has failed.
    """
    found = materialize(candidates(docs), "pii")
    votes, features = ["v1", "v2", "v3"], ["f1", "f2", "f3"]
    one = found.select(F.explode("found").alias("s")).select("s.*")
    counts = one.groupBy("kind", *votes, *features).count().collect()  # at most kinds x 12 votes x 8 features
    patterns = sorted((Pattern(r["kind"], tuple(r[v] for v in votes), tuple(r[f] for f in features), r["count"]) for r in counts), key=lambda p: (p.kind, p.votes, p.features))
    estimate(patterns)
    weights = train(patterns)

    def scored(s: Column) -> Column:
        z = F.lit(weights[0])
        for w, k in zip(weights[1:], KINDS, strict=False):
            z = z + F.when(s["kind"] == k, F.lit(w)).otherwise(F.lit(0.0))
        for w, v in zip(weights[1 + len(KINDS) :], [*votes, *features], strict=True):
            z = z + F.when(s[v] == 1, F.lit(w)).otherwise(F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), p.alias("probability"))

    spans = F.filter(F.transform("found", scored), lambda s: s["kind"].isin(*BASE) | (s["probability"] >= threshold))
    return found.select("doc_id", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
