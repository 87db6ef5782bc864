"""The edit distance join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from scholarium.operators.matching import _by_prefix, candidates, fuzzy_match


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def all_pairs(left, right, most, least):
    out = []
    for i, a in left:
        scored = sorted((distance(a.strip(" ").upper(), b.strip(" ").upper()), j, b) for j, b in right if b is not None) if a is not None else []
        if scored and scored[0][0] <= most:
            d, j, b = scored[0]
            longer = max(len(a.strip(" ")), len(b.strip(" ")))
            similarity = 1.0 if not longer else 1 - d / longer
            if round(similarity, 4) >= least:
                out.append((i, j, d))
    return sorted(out)


@pytest.mark.parametrize(("most", "least", "letters", "longest"), [(5, 0.8, "abc", 30), (5, 0.5, "ab", 9), (3, 0.25, "abcdefgh", 6), (0, 1.0, "ab", 4), (2, 1.0, "ab", 4)])
def test_against_all_pairs(spark, most, least, letters, longest):
    r = np.random.default_rng(len(letters) + most)
    word = lambda: "".join(r.choice(list(letters), r.integers(0, longest)))
    right = [(k, word()) for k in range(300)] + [(1000, None)]
    left = []
    for k in range(300):
        name = list(right[r.integers(300)][1])
        for _ in range(r.integers(0, 7)):
            at, what = r.integers(0, len(name) + 1), r.integers(3)
            name[at : at + (what > 0)] = [str(r.choice(list(letters)))] * int(what < 2)
        left.append((k, " " * int(r.integers(2)) + "".join(name)))
    left += [(500, None), (501, ""), (502, left[0][1])]
    a = spark.createDataFrame(left, "i long, a string")
    b = spark.createDataFrame(right, "j long, b string")
    got = fuzzy_match(a, b, "i", "a", "j", "b", most, least).collect()
    assert sorted((x["i"], x["j"], x["distance"]) for x in got) == all_pairs(left, right, most, least)


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, "x")], "i long, a string"), spark.createDataFrame([], "j long, b string")
    assert fuzzy_match(a, b, "i", "a", "j", "b").count() == 0 and fuzzy_match(b, a, "j", "b", "i", "a").count() == 0


@pytest.mark.parametrize(("most", "least", "letters"), [(5, 0.8, "01"), (5, 0.5, "012"), (3, 0.25, "01")])
def test_pieces_that_very_many_names_share(spark, most, least, letters):
    """With at most four names compared one by one, nearly all pairs come from the search by prefixes."""
    r = np.random.default_rng(most + len(letters))
    word = lambda n: "".join(r.choice(list(letters), n))
    right = [(k, "school#00" + word(r.integers(1, 7)) + "x" * int(r.integers(0, 3))) for k in range(150)]
    left = []
    for k in range(150):
        name = list(right[r.integers(150)][1])
        for _ in range(r.integers(0, 7)):
            at, what = r.integers(0, len(name) + 1), r.integers(3)
            name[at : at + (what > 0)] = [str(r.choice(list(letters + "S")))] * int(what < 2)
        left.append((k, "".join(name)))
    a, b = spark.createDataFrame(left, "i long, a string"), spark.createDataFrame(right, "j long, b string")
    got = fuzzy_match(a, b, "i", "a", "j", "b", most, least, most_sharing=4).collect()
    assert sorted((x["i"], x["j"], x["distance"]) for x in got) == all_pairs(left, right, most, least)


def test_nearest_counts_though_a_longer_one_is_similar(spark):
    """At distance 4 no length is similar enough, at 5 one is; the name at distance 4 is the nearest."""
    a = spark.createDataFrame([(1, "abcdefghijklmno")], "i long, a string")
    b = spark.createDataFrame([(1, "abcdefghijkWXYZ"), (2, "abcdefghijklmno12345")], "j long, b string")
    assert fuzzy_match(a, b, "i", "a", "j", "b", 5, 0.75).count() == 0


def test_no_pairs_of_all_for_numbered_names(spark):
    """Names that differ in their last digits: pairs compared grow with the names, not with their square."""
    name = F.format_string("SUPPLIER#%09d", "id")
    right = spark.range(4000).select(name.alias("_r"), F.col("id").alias("_key"))
    left = spark.range(0, 4000, 8).select(F.concat(F.lit("QQQ"), name, F.lit("W")).alias("_l"), F.lit(18).alias("_n"))
    shared = right.select("_r", "_key", F.length("_r").alias("_n"), F.lit("").alias("_class"))
    assert candidates(left, right, 4).count() == 500
    assert _by_prefix(left.withColumn("_class", F.lit("")), shared, 4).count() <= 500 * 400


def test_search_by_prefixes_is_dealt_over_tasks(spark):
    """Few bytes and much work: Spark alone would leave all names to one task."""
    name = F.format_string("SUPPLIER#%09d", "id")
    right = spark.range(2000).select(name.alias("_r"), F.col("id").alias("_key"))
    left = spark.range(0, 2000, 8).select(F.concat(F.lit("QQQ"), name, F.lit("W")).alias("_l"), F.lit(18).alias("_n"))
    got = candidates(left, right, 4, tasks=8).select("_l", F.spark_partition_id().alias("task")).collect()
    assert len({x["_l"] for x in got}) == 250 and len({x["task"] for x in got}) > 4
