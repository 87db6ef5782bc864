"""School accountability over all domains: tables of unlike grain merged in one shuffle, with quality flags.

A domain has one row per school, year and reporting category; free-meal data
have none per category, the directory none per year.  All of them are stacked
and dealt once, by school.  Grouping by the full grain and spreading the coarser
rows over their finer ones then needs no other exchange, since rows that agree
in more columns already stand together.  Domains go in a few bundles whose rows
have the same columns, so that rows stay narrow and most of them are merged by
hashing, before the sort.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.functions import expr as E

GRAIN = ("cds_code", "academic_year", "reporting_category")


def _pairs(text: str) -> dict[str, str]:
    """'source>out other' as {out: source}."""
    return {p.split(">")[-1]: p.split(">")[0] for p in text.split()}


@dataclass(frozen=True)
class Source:
    """What a table adds: its measures, the columns of the grain it has, and the measure that tells whether it has data."""

    measures: dict[str, str]
    presence: str | None = None
    keys: tuple[str, ...] = GRAIN
    #: Whether its keys become rows of the result.
    anchors: bool = True
    #: Only rows of this aggregate level count.
    level: str | None = "S"


def _domain(prefix: str, text: str, presence: str, **more) -> Source:
    return Source({f"{prefix}_{o}": s for o, s in _pairs(text).items()}, f"{prefix}_{presence}", **more)


# Measures of the eleven domains.
SOURCES = {
    "chronic_absenteeism": _domain("ca", "eligible_enrollment chronic_absent_count chronic_absent_rate_pct", "eligible_enrollment"),
    "absenteeism_reason": _domain(
        "ar",
        "count_of_students_with_one_or_more_absences>students_with_absences average_days_absent>avg_days_absent total_days_absent excused_absences_percent>pct_excused unexcused_absences_percent>pct_unexcused "
        "out_of_school_suspension_absences_percent>pct_oss_absence incomplete_independent_study_absences_percent>pct_incomplete_is",
        "students_with_absences",
    ),
    "enrollment": _domain("en", "cumulative_enrollment", "cumulative_enrollment"),
    "suspension": _domain(
        "su",
        "total_suspensions unduplicated_count_of_students_suspended_total>unique_students_suspended suspension_rate_total>suspension_rate_pct suspension_count_violent_incident_injury>violent_injury "
        "suspension_count_violent_incident_no_injury>violent_no_injury suspension_count_weapons_possession>weapons suspension_count_illicit_drug_related>drug_related "
        "suspension_count_defiance_only>defiance_only suspension_count_other_reasons>other_reasons",
        "total_suspensions",
    ),
    "expulsion": _domain("ex", "total_expulsions unduplicated_count_of_students_expelled_total>unique_students_expelled expulsion_rate_total>expulsion_rate_pct", "total_expulsions"),
    "homeless_enrollment": _domain(
        "hs",
        "cumulative_enrollment homeless_student_enrollment>homeless_count temporarily_doubled_up_percent>doubled_up_pct temporary_shelters_percent>shelters_pct hotels_motels_percent>hotels_pct "
        "temporarily_unsheltered_percent>unsheltered_pct",
        "homeless_count",
    ),
    "frpm": _domain(
        "frpm",
        "enrollment_k12 free_meal_count_k12>free_count_k12 percent_eligible_free_k12>free_pct_k12 frpm_count_k12>reduced_count_k12 percent_eligible_frpm_k12>reduced_pct_k12",
        "enrollment_k12",
        keys=GRAIN[:2],
        anchors=False,
        level=None,
    ),
    "assessment_ela": _domain("ela", "curr_denom>currdenom curr_status>currstatus status_level>status", "currstatus", level=None),
    "assessment_elpac": _domain("elpac", "pct_curr_progressed>progressed_pct pct_curr_maintain_pl4>maintained_pl4_pct pct_curr_declined>declined_pct", "progressed_pct", level=None),
    "assessment_caspp": _domain(
        "sbac", "mean_scale_score pct_standard_exceeded pct_standard_met_and_above>pct_standard_met_above pct_standard_not_met students_tested", "mean_scale_score", level=None
    ),
    "restraint_seclusion": _domain(
        "rs", "count_of_mechanical_restraints>mechanical_restraints count_of_physical_restraints>physical_restraints count_of_seclusions>seclusions", "mechanical_restraints"
    ),
}
SCHOOLS = Source(_pairs("school_id school_name cde_district_name>district_name cde_county>county_name latitude longitude"), keys=GRAIN[:1], anchors=False, level=None)

# Codes of subgroups at risk.
AT_RISK = ("SE", "EL", "RFEP", "IFEP", "SWD", "HOM", "FOS", "MIL")


#: Kinds of measures that a hash aggregate updates in place.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


#: Measures in a bundle; a source with more is a bundle of its own.
BUNDLE = 28


def _bundles(sources: dict[str, Source], fixed: list[str]) -> dict[str, int]:
    """The bundle of each source: sources of one share a row in the first aggregate.  Those with texts stand apart, since their texts are keys there."""
    with_texts = {d: not set(s.measures) <= set(fixed) for d, s in sources.items()}
    out, number, held, last = {}, 0, 0, False
    for d in sorted(sources, key=with_texts.get):
        size = len(sources[d].measures)
        if held and (held + size > BUNDLE or with_texts[d] != last):
            number, held = number + 1, 0
        out[d], held, last = number, held + size, with_texts[d]
    return out


def _slots(sources: dict[str, Source], kinds: dict[str, T.DataType], bundles: dict[str, int]) -> dict[str, str]:
    """The column in which each measure travels: the i-th measures of a kind in each bundle share one."""
    order = list(dict.fromkeys(kinds.values()))
    used: Counter = Counter()
    out = {}
    for d, s in sources.items():
        for n in s.measures:
            if n in kinds:
                place = bundles[d], order.index(kinds[n])
                out[n] = f"_slot_{place[1]}_{used[place]}"
                used[place] += 1
    return out


def _stacked(tables: dict[str, DataFrame], sources: dict[str, Source], grain: tuple[str, ...], shared: tuple[str, ...], kinds: dict[str, T.DataType], slots: dict[str, str], bundles: dict[str, int]) -> DataFrame:
    """The rows of all sources, each with its bundle and measures: those with a slot in it, others in a column of their own."""
    key_kinds = {k: next(tables[d].schema[k].dataType for d, s in sources.items() if k in s.keys) for k in grain}
    columns = {slots.get(n, n): kinds[n] for n in kinds}

    def one(d: str, s: Source) -> DataFrame:
        df = tables[d].where(F.col("aggregate_level") == s.level) if s.level else tables[d]
        matches = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in s.keys])
        keys = [(F.col(k) if k in s.keys else F.lit(None)).cast(key_kinds[k]).alias(k) for k in grain]
        mine = {slots.get(n, n): F.when(matches, F.col(c)) for n, c in s.measures.items()}
        values = [mine.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
        present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in shared])
        return df.where(present).select(*keys, F.lit(len(s.keys)).alias("_width"), F.lit(bundles[d]).alias("_bundle"), F.lit(s.anchors).alias("_anchor"), *values)

    return reduce(DataFrame.unionAll, [one(d, s) for d, s in sources.items()])


def merge(tables: dict[str, DataFrame], sources: dict[str, Source], grain: tuple[str, ...] = GRAIN) -> DataFrame:
    """One row for each distinct grain of the anchoring sources, with the measures of all sources that match it.

    The left joins of the grain with every source, done in one exchange on the
    grain's columns that all sources have.  As in a join, a null key matches
    nothing: such a grain keeps its row, without measures; a null in the columns
    that all sources share gives no row.  Each source must have one row per key;
    of more, each measure's largest value stands.  Equal measure names of two
    sources are an error.
    """
    names = [n for s in sources.values() for n in s.measures]
    if len(names) != len(set(names)):
        raise ValueError("two sources have a measure of the same name")
    for name, s in sources.items():
        if tuple(s.keys) != tuple(grain[: len(s.keys)]):
            raise ValueError(f"{name}: keys must be the first columns of the grain")
        if s.anchors and tuple(s.keys) != tuple(grain):
            raise ValueError(f"{name}: only a source of the full grain can give rows")
    shared = grain[: min(len(s.keys) for s in sources.values())]
    kinds = {n: tables[d].schema[c].dataType for d, s in sources.items() for n, c in s.measures.items()}
    fixed = [n for n in names if isinstance(kinds[n], FIXED_WIDTH)]
    texts = [n for n in names if n not in fixed]
    bundles = _bundles(sources, fixed)
    slots = _slots(sources, {n: kinds[n] for n in fixed}, bundles)
    rows = _stacked(tables, sources, grain, shared, kinds, slots, bundles).repartition(*shared)
    # Rows become one a bundle by hashing, where texts must be keys, so that few are left to sort and to spread over all measures.
    few = rows.groupBy(*grain, "_width", "_bundle", *texts).agg(F.max("_anchor").alias("_anchor"), *(F.max(c).alias(c) for c in dict.fromkeys(slots.values())))
    bundle = {n: bundles[d] for d, s in sources.items() for n in s.measures}
    own = {n: F.when(F.col("_bundle") == bundle[n], F.col(slots[n])) if n in slots else F.col(n) for n in names}
    wide = few.groupBy(*grain, "_width").agg(F.max("_anchor").alias("_anchor"), *(F.max(c).alias(n) for n, c in own.items()))
    for d, s in sources.items():  # coarser rows reach the finer rows that stand with them
        if len(s.keys) < len(grain):
            whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in s.keys])
            together = Window.partitionBy(*s.keys)
            mine = F.col("_width") == len(s.keys)
            wide = wide.withColumns({n: F.when(whole, F.max(F.when(mine, F.col(n))).over(together)) for n in s.measures})
    return wide.where(F.col("_anchor")).select(*grain, *names)


def flags(rows: DataFrame, sources: dict[str, Source] = SOURCES, category: str = "reporting_category") -> DataFrame:
    """Adds suppression, the number of domains with data, kinds of subgroup and the level."""
    presence = [F.col(s.presence).isNotNull() for s in sources.values() if s.presence]
    code, no = F.col(category), F.lit(False)
    present: Column = reduce(lambda a, b: a + b, [p.cast("long") for p in presence])
    return rows.withColumns(
        {
            "is_suppressed": F.col("ca_eligible_enrollment").isNull() & F.col("ca_chronic_absent_count").isNotNull(),
            "data_domains_present": present,
            "has_cde_data": present > 0,
            "is_race_ethnicity_subgroup": F.coalesce(code.like("R%"), no),
            "is_gender_subgroup": F.coalesce(code.isin("GF", "GM", "GX"), no),
            "is_atrisk_subgroup": F.coalesce(code.isin(*AT_RISK), no),
            "is_grade_level_subgroup": F.coalesce(code.like("GR%"), no),
            "aggregate_level": F.lit("S"),
            "aggregate_level_label": F.lit("School"),
        }
    )


def school_accountability(staged: dict[str, DataFrame], schools: DataFrame) -> DataFrame:
    """The accountability table of staged domains (by name, as in ``SOURCES``) and the directory of mapped schools.

    A domain without a file can be passed as ``state.typed_empty`` gives it.
    """
    sources = {**SOURCES, "schools": SCHOOLS}
    merged = merge({**staged, "schools": schools}, sources)
    return flags(merged.withColumn("reporting_category_label", E.label("reporting_category", E.REPORTING_LABELS)))
