"""Normalising a school system's tables: codes decoded, ranges checked, defaults set, dates generalised; one spec a table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions.expr import label, ratio, rnd


def pairs(text: str) -> dict[str, str]:
    """'source>out other' as {out: source}."""
    return {p.split(">")[-1]: p.split(">")[0] for p in text.split()}


@dataclass(frozen=True)
class Codes:
    names: dict[str, str]
    #: What a null becomes; with ``closed``, what any code without a name becomes.
    default: str
    closed: bool = False


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    digits: int | None = None
    #: What a value outside becomes; null stays null.
    otherwise: float | None = None


@dataclass(frozen=True)
class Entity:
    #: Rows without one of these are left out.
    keys: tuple[str, ...]
    kept: str = ""
    codes: dict[str, Codes] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    trimmed: str = ""
    ranges: dict[str, Range] = field(default_factory=dict)
    #: Texts that are null unless they are one of these.
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    days: str = ""
    weeks: str = ""
    renamed: dict[str, str] = field(default_factory=dict)

    def source(self, out: str) -> str:
        return self.renamed.get(out, out)


# Codes, defaults and ranges of the five tables.
_NO = dict.fromkeys
_LETTERS = {g: g for g in "A A- B+ B B- C+ C C- D+ D D- F".split()} | {"I": "Incomplete", "W": "Withdrawn", "P": "Pass", "NP": "No Pass"}
_MARKS = tuple("ABCDFIW")
ENTITIES = {
    "students": Entity(
        ("student_id",),
        "email phone address created_date updated_date",
        {
            "gender": Codes({"M": "Male", "F": "Female", "O": "Other", "N": "Not Specified"}, "Not Specified"),
            "ethnicity": Codes({"HISP": "Hispanic", "AA": "African American", "W": "White", "AIAN": "American Indian/Alaska Native", "ASN": "Asian", "PI": "Native Hawaiian/Pacific Islander", "TMER": "Two or More Races"}, "Unknown"),
            "enrollment_status": Codes({"A": "Active", "G": "Graduated", "W": "Withdrawn", "T": "Transferred"}, "Unknown"),
            "academic_program": Codes({"CP": "College Prep", "VOC": "Vocational", "STEM": "STEM", "IB": "International Baccalaureate"}, "General"),
        },
        {"first_name": "UNKNOWN", "last_name": "UNKNOWN", "immigrant_status": "Unknown", "homeless_status": "Housed"} | _NO("special_education english_learner free_reduced_lunch gifted_status section_504_status".split(), False),
        "middle_name",
        {"grade_level": Range(0, 12, None, 0), "gpa": Range(0.0, 4.0, 2)},
        days="date_of_birth enrollment_date withdrawal_date",
    ),
    "courses": Entity(
        ("course_id",),
        "term meeting_schedule room_number prerequisites description instructor_name instructor_email instructor_id created_date updated_date",
        {"course_type": Codes({"AP": "Advanced Placement", "HON": "Honors", "REG": "Regular", "REM": "Remedial"}, "Regular")},
        {"course_name": "UNKNOWN", "department": "Unknown", "subject": "General", "capacity": 0, "current_enrollment": 0},
        "course_code",
        {"grade_level_min": Range(0, 12, None, 0), "grade_level_max": Range(0, 12, None, 12), "credit_hours": Range(0, 10, 2, 1.0)},
        renamed={"current_enrollment": "enrollment_count"},
    ),
    "enrollment": Entity(
        ("enrollment_id", "student_id", "course_id"),
        "term created_date updated_date",
        {"completion_status": Codes({"C": "Completed", "I": "In Progress", "W": "Withdrawn"}, "Unknown"), "letter_grade": Codes(_LETTERS, "Unknown", True)},
        {"advanced_placement": False, "honors_course": False, "accommodations": "None", "flag_for_intervention": False},
        ranges={
            "final_grade_percent": Range(0, 100, 1),
            "gpa_contribution": Range(0.0, 4.0, 2),
            "credit_earned": Range(0, 10, 2),
            "weighted_grade": Range(0.0, 5.0, 2),
            "assignment_completion_rate": Range(0, 1, 3),
            "quiz_average": Range(0, 100, 1),
            "test_average": Range(0, 100, 1),
            "participation_score": Range(0, 10, 1),
            "project_score": Range(0, 100, 1),
        },
        allowed={"midterm_grade": _MARKS, "finals_grade": _MARKS},
        days="enrollment_date withdrawal_date",
        renamed={"letter_grade": "grade", "honors_course": "honors"},
    ),
    "attendance": Entity(
        ("attendance_id", "student_id"),
        "course_id term created_date updated_date",
        {
            "attendance_status": Codes({"P": "Present", "A": "Absent", "T": "Tardy", "E": "Excused", "U": "Unexcused"}, "Unknown"),
            "warning_level": Codes({"GREEN": "Low Risk", "YELLOW": "Medium Risk", "RED": "High Risk"}, "Unknown", True),
            "trend": Codes({"IMP": "Improving", "STAB": "Stable", "DEC": "Declining"}, "Unknown", True),
        },
        {"reason_code": "Unknown", "reason_description": "", "chronically_absent": False} | _NO("present_count absent_count tardy_count excused_count unexcused_count".split(), 0),
        ranges={"attendance_rate": Range(0, 1, 4), "cumulative_absence_rate": Range(0, 1, 4)},
        weeks="attendance_date>attendance_week",
        renamed={"attendance_status": "status"},
    ),
    "academic_records": Entity(
        ("record_id", "student_id"),
        "course_id assignment_name assignment_type created_date updated_date",
        {"mastery_level": Codes({"A": "Advanced", "P": "Proficient", "D": "Developing", "B": "Beginning"}, "Unknown")},
        {"competency_id": "Unknown", "competency_name": "", "standard_code": "", "late_days": 0, "retake_count": 0} | _NO("feedback_provided remediation_offered enrichment_offered".split(), False),
        ranges={"max_points": Range(0, 10000, 2), "earned_points": Range(0, 10000, 2), "score_percent": Range(0, 100, 1), "original_score": Range(0, 100, 1)},
        days="assignment_date submission_date",
    ),
}
TIMELINESS = ("Early", "On Time", "Late (< 3 days)", "Late (< 7 days)", "Very Late")


def _extra(name: str, as_of: Column | None) -> dict[str, Column]:
    """What only one table derives, from its raw columns."""
    c = F.col
    if name == "students":
        out = {"birth_year": F.year("date_of_birth"), "birth_month": F.month("date_of_birth")}
        return out | ({"years_enrolled": F.floor(F.months_between(as_of, c("enrollment_date")) / 12).cast("long")} if as_of is not None else {})
    if name == "courses":
        return {"capacity_percent": F.when(c("capacity") == 0, 0.0).otherwise(rnd(ratio(c("enrollment_count"), c("capacity"), 100.0), 1))}
    if name == "academic_records":
        given, handed = c("assignment_date"), c("submission_date")
        early, on_time, three, seven, later = TIMELINESS
        late = F.when(handed < given, early).when(handed == given, on_time).when(handed <= given + F.expr("INTERVAL 3 DAYS"), three).when(handed <= given + F.expr("INTERVAL 7 DAYS"), seven).otherwise(later)
        return {"submission_timeliness": late, "on_time": F.coalesce(c("on_time"), c("late_days") == 0)}
    return {}


def normalize(rows: DataFrame, entity: str, as_of: Column | None = None) -> DataFrame:
    """``rows`` of an entity in its normal form; with ``as_of``, students get the years since they enrolled.

    A repeated row stays repeated; columns that the spec does not name are left
    out.  A submission without a date counts as very late.
    """
    e = ENTITIES[entity]
    src = lambda o: F.col(e.source(o))
    out: dict[str, Column] = {k: F.col(k) for k in e.keys}
    out |= {o: F.col(s) for o, s in pairs(e.kept).items()}
    out |= {o: label(src(o), k.names, k.default if k.closed else F.coalesce(src(o), F.lit(k.default))) for o, k in e.codes.items()}
    out |= {o: F.coalesce(src(o), F.lit(d)) for o, d in e.defaults.items()}
    out |= {o: F.trim(F.coalesce(src(o), F.lit(""))) for o in e.trimmed.split()}
    for o, r in e.ranges.items():
        value = src(o) if r.digits is None else rnd(src(o), r.digits)
        out[o] = F.when(~src(o).between(r.low, r.high), F.lit(r.otherwise)).otherwise(value)
    out |= {o: F.when(src(o).isin(*a), src(o)) for o, a in e.allowed.items()}
    out |= {o: src(o).cast("date") for o in e.days.split()}
    out |= {o: F.trunc(F.col(s), "week") for o, s in pairs(e.weeks).items()}
    out |= _extra(entity, as_of)
    held = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in e.keys])
    return rows.where(held).select(*(c.alias(o) for o, c in out.items()))


def completeness(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, normalized_count, source_count, percent_transformed) of raw tables, each read once.

    The source count is of rows with the first key, the normalized one of rows with all keys.
    """
    parts = []
    for name, rows in tables.items():
        keys = ENTITIES[name].keys
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        parts.append(rows.agg(F.lit(name).alias("entity"), F.count(F.when(whole, 1)).alias("normalized_count"), F.count(keys[0]).alias("source_count")))
    both = reduce(DataFrame.unionAll, parts)
    return both.withColumn("percent_transformed", rnd(ratio(F.col("normalized_count"), F.col("source_count"), 100.0), 1))
