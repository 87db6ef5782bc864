"""Matching names by edit distance without comparing all pairs.

Distances are tried in turn: equal names first, then one edit, and so on.  A name
is settled by its nearest match, so each round has only the names that no
smaller distance has settled.  For distance d a candidate's name is cut into
d + 1 pieces; by the pigeonhole principle one of them stands unedited in the
other name, and counting the edits before and after it bounds where.  Pairs
come from an equi-join on (length, piece number, piece), and only they are
compared, with a banded distance.

A piece that very many names share would compare all of them.  Names with such
pieces are searched by their prefixes instead, from short to long: a left name
goes on to the longer prefixes of those only that it can still reach.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions.expr import rnd
from scholarium.operators.shared import cut_lineage


#: Names of a length that may share a piece and still be compared one by one.
MOST_SHARING = 1000
#: Prefixes of a name, of growing length, that the search by prefixes goes through; the last one is the name.
STEPS = 9
#: Left names of a task in the search by prefixes.  Their rows are few bytes and much work, so Spark, which
#: sizes tasks by bytes, would leave all of them to one.
NAMES_A_TASK = 400


def normal(name: str) -> Column:
    return F.upper(F.trim(F.col(name)))


def candidates(left: DataFrame, right: DataFrame, d: int, most_sharing: int = MOST_SHARING, tasks: int = 1) -> DataFrame:
    """(_l, _r, _key): pairs of a left and a right name at distance ``d`` exactly, some repeated; d = 0 is equality.

    ``left`` has rows (_l, _n), a left name and a length of right names that it
    is compared with.  A right name of ``d`` characters or less can't be cut into
    d + 1 pieces; it pairs by length alone.  ``fuzzy_match`` has such pairs only
    where it takes similarities under three quarters.  ``tasks`` share the search
    by prefixes.
    """
    if d == 0:
        return left.select("_l").distinct().join(right, F.col("_l") == F.col("_r"))
    pieces, size, own = d + 1, F.length("_r"), F.length("_l")
    edge = lambda i, n: F.floor(i * n / pieces).cast("int")
    number = F.explode(F.sequence(F.lit(0), F.lit(d)))
    cut = right.where(size > d).select("_r", "_key", size.alias("_n"), number.alias("_i"))
    at, end = edge(F.col("_i"), F.col("_n")), edge(F.col("_i") + 1, F.col("_n"))
    cut = cut.select("*", F.substring("_r", at + 1, end - at).alias("_piece"))

    probes = left.select("_l", own.alias("_m"), "_n")
    short = probes.where(F.col("_n") <= d).join(right.where(size <= d).withColumn("_n", size), "_n").select("_l", "_r", "_key")
    probes = probes.where(F.col("_n") > d).select("*", number.alias("_i"))
    at, end, i = edge(F.col("_i"), F.col("_n")), edge(F.col("_i") + 1, F.col("_n")), F.col("_i")
    moved = F.col("_m") - F.col("_n")
    # at most i edits before piece i shift it from its place, at most d - i after it
    low = F.greatest(at - i, at + moved - (d - i), F.lit(0))
    high = F.least(at + i, at + moved + (d - i), F.col("_m") - (end - at))
    probes = probes.select("*", low.alias("_low"), high.alias("_high"), (end - at).alias("_w")).where("_low <= _high")
    probes = probes.select("_l", "_n", "_i", F.explode(F.sequence("_low", "_high")).alias("_p"), "_w").select("_l", "_n", "_i", F.substring(F.col("_l"), F.col("_p") + 1, F.col("_w")).alias("_piece"))

    piece = ["_n", "_i", "_piece"]
    shared = cut_lineage(cut.groupBy(*piece).count().where(F.col("count") > most_sharing).drop("count"))
    near = short
    if not shared.isEmpty():
        # right names with the same shared pieces are one class, so a pair meets there once
        of = cut.join(shared, piece).groupBy("_r", "_key", "_n").agg(F.sort_array(F.collect_list(F.struct("_i", "_piece"))).alias("_pieces"))
        of = cut_lineage(of.select("_r", "_key", "_n", F.sha2(F.to_json("_pieces"), 256).alias("_class"), "_pieces"))
        classes = of.groupBy("_n", "_class").agg(F.first("_pieces").alias("_pieces")).select("_n", "_class", F.explode("_pieces").alias("_x"))
        starts = probes.join(classes.select("_n", "_class", "_x.*"), piece).select("_l", "_n", "_class").repartition(tasks, "_l").distinct()
        near = near.unionAll(_by_prefix(starts, of.drop("_pieces"), d))
        cut = cut.join(shared, piece, "left_anti")
    # a pair that meets in several pieces is compared as often, which costs less than another shuffle
    near = near.unionAll(probes.join(cut, piece).select("_l", "_r", "_key"))
    return near.where(F.levenshtein("_l", "_r", d) == d)


def _by_prefix(starts: DataFrame, right: DataFrame, d: int) -> DataFrame:
    """(_l, _r, _key): all pairs of a class up to distance ``d``, and some others.

    ``starts``: rows (_l, _n, _class); ``right``: rows (_r, _key, _n, _class).
    Cutting a right name after s characters cuts the left one after s + o for
    some o; the parts before have a distance, and those after one of at least
    their difference in length.
    """
    moved = F.length("_l") - F.col("_n")

    def within(prefix: Column, size: Column) -> Column:
        ways = []
        for o in range(-d, d + 1):
            spare = F.lit(d) - F.abs(moved - o)  # what the parts after leave to the parts before
            here = (spare >= abs(o)) & (size + o >= 0) & (size + o <= F.length("_l"))
            ways.append(here & (F.call_function("levenshtein", F.substring(F.col("_l"), F.lit(1), size + o), prefix, spare) >= 0))
        return reduce(lambda a, b: a | b, ways)

    cut_at = lambda step: F.ceil(F.col("_n") * step / STEPS).cast("int")
    before = lambda step: F.substring(F.col("_r"), F.lit(1), cut_at(step))
    # prefixes of no more than d characters rule out nothing or little
    states, last = starts.withColumn("_at", F.lit("")), None
    for step in range((STEPS + 1) // 2, STEPS):
        prefixes = right.select("_n", "_class", (F.lit("") if last is None else before(last)).alias("_at"), before(step).alias("_to")).distinct()
        states = states.join(prefixes, ["_n", "_class", "_at"]).where(within(F.col("_to"), cut_at(step))).select("_l", "_n", "_class", F.col("_to").alias("_at"))
        last = step
    return states.join(right.withColumn("_at", before(last)), ["_n", "_class", "_at"]).select("_l", "_r", "_key")


def _reach(names: DataFrame, known: DataFrame, most: int, least: float) -> DataFrame:
    """(_m, _n, _upto): lengths of left and right names, and the greatest distance at which a left name of that length may be similar enough to any.

    As many rows as lengths occur, not names.  The nearest name counts even if
    one farther off is more similar, so a left name is tried up to ``_upto``.
    """
    sizes = names.select(F.length("_l").alias("_m")).distinct()
    pairs = sizes.crossJoin(known.select(F.length("_r").alias("_n")).distinct()).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(most))))
    pairs = pairs.where(F.abs(F.col("_m") - F.col("_n")) <= F.col("_d"))
    longer = F.greatest("_m", "_n", F.lit(1))
    similar = rnd(F.lit(1.0) - F.col("_d") / longer, 4) >= least
    upto = F.max(F.when(similar, F.col("_d"))).over(Window.partitionBy("_m"))
    return pairs.select("_m", "_n", upto.alias("_upto")).where("_upto is not null").distinct()


def fuzzy_match(left: DataFrame, right: DataFrame, lkey: str, lname: str, rkey: str, rname: str, most: int = 5, least: float = 0.8, most_sharing: int = MOST_SHARING) -> DataFrame:
    """The nearest right name of each left one, up to ``most`` edits, where the similarity is ``least`` or more.

    Names are compared trimmed and in upper case; of equally near right names
    the one with the smallest key counts.  Similarity is 1 less the distance
    over the longer length.  Null names match nothing, an empty name only an
    empty one.  Equal names are matched once and shared out again, so repeated
    names cost no more than one.  A left name that could be that similar to no
    right name of any length at a distance drops out before it is tried.  Of
    names that share a piece, up to ``most_sharing`` are compared one by one.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and up to 1")
    names = left.select(normal(lname).alias("_l")).where("_l is not null").distinct()
    known = right.select(normal(rname).alias("_r"), F.col(rkey).alias("_key")).where("_r is not null").groupBy("_r").agg(F.min("_key").alias("_key"))
    known, names = cut_lineage(known), cut_lineage(names)
    reach = cut_lineage(_reach(names, known, most, least))
    farthest = reach.agg(F.max("_upto")).first()[0]
    empty = names.limit(0).select("_l", F.lit(None).cast(right.schema[rkey].dataType).alias("_key"), F.lit(0).cast("long").alias("distance"))
    matched, waiting = empty, names.count()
    for d in range((-1 if farthest is None else farthest) + 1):
        if not waiting:
            break
        near = F.broadcast(reach.where((F.col("_upto") >= d) & (F.abs(F.col("_m") - F.col("_n")) <= d)))
        rest = names.join(matched.select("_l"), "_l", "left_anti").withColumn("_m", F.length("_l")).join(near, "_m").select("_l", "_n")
        best = candidates(rest, known, d, most_sharing, math.ceil(waiting / NAMES_A_TASK)).groupBy("_l").agg(F.min("_key").alias("_key")).withColumn("distance", F.lit(d).cast("long"))
        best = cut_lineage(best)
        waiting -= best.count()
        matched = matched.unionAll(best)
    rows = left.select(lkey, lname, normal(lname).alias("_l")).join(matched, "_l")
    rows = rows.join(right.select(F.col(rkey), F.col(rname), normal(rname).alias("_r")), F.col("_key") == F.col(rkey))
    longer = F.greatest(F.length("_l"), F.length("_r"))
    similarity = F.when(longer == 0, F.lit(1.0)).otherwise(rnd(F.lit(1.0) - F.col("distance") / longer, 4))
    return rows.withColumn("similarity", similarity).where(F.col("similarity") >= least).select(lkey, lname, rkey, rname, "distance", "similarity")
