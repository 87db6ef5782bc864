"""State accountability files: one declarative spec a domain, one function that stages any of them.

Raw files come as text columns whose headers drift from year to year.  A spec
names the source of each count, rate and text; ``stage`` casts, labels and
flags; a column that a year's file lacks is null, and ``typed_empty`` gives the
same schema where a whole file is missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.functions import expr as E


def _pairs(text: str) -> dict[str, str]:
    """'src>out other' as {out: src}: a name alone keeps its name."""
    return {p.split(">")[-1]: p.split(">")[0] for p in text.split()}


@dataclass(frozen=True)
class Domain:
    name: str
    counts: str = ""
    rates: str = ""
    texts: str = ""
    #: One column with the 14 digits, or county, district and school.
    cds: tuple[str, ...] = ("county_code", "district_code", "school_code")
    #: Candidates for the year, the first one that is not null counts.
    year: tuple[str, ...] = ("academic_year",)
    short_years: bool = False
    level: str | None = "aggregate_level"
    category: str | None = "reporting_category"
    #: Source columns whose '*' suppresses the row, and the count that makes it small.
    suppressed: tuple[str, ...] = ()
    small: str | None = None
    grade_groups: bool = False


_PLACE = "county_code district_code school_code county_name district_name school_name"
_CDS = ("c", "d", "s")
_SARC = {"cds": _CDS, "year": ("sarc_year",), "level": None, "category": None, "texts": "c>county_code d>district_code s>school_code"}
_BOTH = ("academic_year", "_academic_year")
_BOARD = {"cds": ("cds",), "year": ("reportingyear",), "level": "rtype", "category": "studentgroup"}
_BOARD_TEXTS = "schoolname>school_name districtname>district_name countyname>county_name charter_flag coe_flag dass_flag statuslevel>status_level"
_INCIDENTS = "violent_incident_injuryx violent_incident_no_injuryx weapons_possession illicit_drug_related defiance_only other_reasons".split()


def _conduct(kind: str, who: str) -> dict:
    """Suspension and expulsion files differ only in their words."""
    reasons = " ".join(f"{kind}_count_{x}>{kind}_count_{x.removesuffix('x')}" for x in _INCIDENTS)
    students = " ".join(f"unduplicated_count_of_students_{who}_{x}x>unduplicated_count_of_students_{who}_{x}" for x in ("total", "defiance_only"))
    return {
        "counts": f"cumulative_enrollment total_{kind}s {students} {reasons}",
        "rates": f"{kind}_rate_totalx>{kind}_rate_total",
        "texts": f"{_PLACE} charter_yn>charter_school",
        "year": _BOTH,
        "suppressed": ("cumulative_enrollment",),
        "small": "cumulative_enrollment",
    }


def _years(*names: str) -> str:
    return " ".join(f"{n}_y{k}" for n in names for k in (1, 2, 3))


_ABSENT = "excused_absences unexcused_absences out_of_school_suspension_absences incomplete_independent_study_absences".split()
_HOUSING = "temporarily_doubled_up temporary_shelters hotels_motels temporarily_unsheltered missing_unknown".split()

# Columns of the domains.
DOMAINS = {
    d.name: d
    for d in (
        Domain(
            "chronic_absenteeism",
            "chronic_absenteeism_eligible_cumulative_enrollment>eligible_enrollment chronic_absenteeism_count>chronic_absent_count",
            "chronic_absenteeism_rate>chronic_absent_rate_pct",
            f"{_PLACE} charter_school dass>dashboard_alternative_school_status",
            suppressed=("chronic_absenteeism_eligible_cumulative_enrollment", "chronic_absenteeism_count", "chronic_absenteeism_rate"),
            small="chronic_absenteeism_eligible_cumulative_enrollment",
            grade_groups=True,
        ),
        Domain(
            "absenteeism_reason",
            "eligible_cumulative_enrollment count_of_students_with_one_or_more_absences total_days_absent " + " ".join(f"{x}_countx>{x}_count" for x in _ABSENT),
            "average_days_absent " + " ".join(f"{x}_percentx>{x}_percent" for x in _ABSENT),
            f"{_PLACE} charter_school dass>dashboard_alternative_school_status",
            suppressed=("eligible_cumulative_enrollment",),
            small="eligible_cumulative_enrollment",
        ),
        Domain("assessment_ela", "currdenom>curr_denom", "currstatus>curr_status", _BOARD_TEXTS, **_BOARD, suppressed=("currdenom", "currstatus"), small="currdenom"),
        Domain(
            "assessment_elpac",
            "currnumer>curr_numer currdenom>curr_denom currprogressed>curr_progressed currmaintainpl4>curr_maintain_pl4 currmaintainoth>curr_maintain_oth currdeclined>curr_declined",
            "currstatus>curr_status pctcurrprogressed>pct_curr_progressed pctcurrmaintainpl4>pct_curr_maintain_pl4 pctcurrmaintainoth>pct_curr_maintain_oth pctcurrdeclined>pct_curr_declined",
            _BOARD_TEXTS,
            **_BOARD,
            suppressed=("currdenom", "currstatus", "currnumer"),
            small="currdenom",
        ),
        Domain(
            "cbedsora",
            "row_number american_indian asian pacific_islander filipino hispanic african_american white multor_no_resp>mult_or_no_resp total",
            texts="description level section",
            cds=("cdscode",),
            year=("year",),
            level=None,
            category=None,
        ),
        Domain("class_assignment", _years("pimel", "pinc"), **_SARC),
        Domain("enrollment", "cumulative_enrollment", texts=f"{_PLACE} charter>charter_school", year=_BOTH, suppressed=("cumulative_enrollment",), small="cumulative_enrollment"),
        Domain("enrollment_by_grade", "kdgn " + " ".join(f"gr{k}" for k in range(1, 13)) + " enrtotal>enr_total", **_SARC),
        Domain("enrollment_by_subgroup", rates=" ".join(f"per{x}>per_{x}" for x in "gf gm gx ai as aa fi hi pi multi wh el fy h mig sd di".split()), **_SARC),
        Domain("expulsion", **_conduct("expulsion", "expelled")),
        Domain("suspension", **_conduct("suspension", "suspended")),
        Domain(
            "frpm",
            "enrollment_k_12x>enrollment_k12 free_meal_count_k_12x>free_meal_count_k12 frpm_count_k_12x>frpm_count_k12 enrollment_ages_5_17x>enrollment_ages_5_17 free_meal_count_ages_5_17x>free_meal_count_ages_5_17 frpm_count_ages_5_17x>frpm_count_ages_5_17",
            "percent_eligible_free_k_12x>percent_eligible_free_k12 percent_eligible_frpm_k_12x>percent_eligible_frpm_k12 percent_eligible_free_ages_5_17x>percent_eligible_free_ages_5_17 percent_eligible_frpm_ages_5_17x>percent_eligible_frpm_ages_5_17",
            f"{_PLACE} school_type educational_option_type nslp_provision_status charter_school_y_nx>charter_school charter_school_number>charter_number charter_funding_type irc low_grade high_grade calpads_fall_1_certification_status>calpads_certification_status",
            short_years=True,
            level=None,
            category="=TA",
        ),
        Domain(
            "homeless_enrollment",
            "cumulative_enrollment homeless_student_enrollment " + " ".join(_HOUSING),
            " ".join(f"{x}_percentx>{x}_percent" for x in _HOUSING),
            f"{_PLACE} charter_school dass>dashboard_alternative_school_status",
            year=_BOTH,
            suppressed=("cumulative_enrollment",),
            small="cumulative_enrollment",
        ),
        Domain(
            "restraint_seclusion",
            "count_of_mechanical_restraints unduplicated_count_of_students_mechanically_restrained>unduplicated_count_of_students_mechanical count_of_physical_restraints "
            "unduplicated_count_of_students_physically_restrained>unduplicated_count_of_students_physical count_of_seclusions",
            texts=f"{_PLACE} nps",
            short_years=True,
        ),
        Domain("teacher_misassignment", _years("naapw", "naams", "naavp", "naatt"), **_SARC),
        Domain("teacher_out_of_field", _years("nicta", "nilao", "nioof"), **_SARC),
    )
}

# Grade spans of reporting categories.
GRADE_GROUPS = {"GRTKKN": "TK/Kindergarten", "GRKN": "TK/Kindergarten", "GR13": "Grades 1-3", "GR46": "Grades 4-6", "GR78": "Grades 7-8", "GR912": "Grades 9-12", "GRTK8": "TK-8", "GRK8": "TK-8"}


def _source(raw: DataFrame, name: str) -> Column:
    """A text column; null where this year's file lacks it."""
    return F.col(f"`{name}`").cast("string") if name in raw.columns else F.lit(None).cast("string")


def category_columns(category: Column) -> dict[str, Column]:
    flags = E.category_flags(category)
    return {
        "reporting_category_label": E.label(category, E.REPORTING_LABELS),
        "is_race_ethnicity_subgroup": flags["is_race_ethnicity"],
        "is_gender_subgroup": flags["is_gender"],
        "is_atrisk_subgroup": flags["is_program"],
    }


def stage(raw: DataFrame, domain: Domain | str) -> DataFrame:
    """A raw file of text columns as the typed, labelled and flagged table of its domain."""
    d = DOMAINS[domain] if isinstance(domain, str) else domain
    src = lambda name: _source(raw, name)
    year = F.coalesce(*(src(y) for y in d.year))
    out = {"academic_year": E.short_year(year) if d.short_years else year}
    out["cds_code"] = src(d.cds[0]) if len(d.cds) == 1 else E.cds_code(*(F.coalesce(src(c), F.lit("")) for c in d.cds))
    if d.level:
        out |= {"aggregate_level": src(d.level), "aggregate_level_label": E.label(src(d.level), E.LEVEL_LABELS)}
    if d.category:
        category = F.lit(d.category[1:]) if d.category.startswith("=") else src(d.category)
        out |= {"reporting_category": category} | category_columns(category)
    out |= {o: src(s) for o, s in _pairs(d.texts).items()}
    out |= {o: E.try_int(src(s)) for o, s in _pairs(d.counts).items()}
    out |= {o: E.try_double(src(s)) for o, s in _pairs(d.rates).items()}
    no = F.lit(False)
    if d.suppressed:
        out["is_suppressed"] = reduce(lambda a, b: a | b, [F.coalesce(src(s) == "*", no) for s in d.suppressed])
    if d.small:
        out["is_small_n"] = F.coalesce(E.try_int(src(d.small)) < 11, no)
    if d.grade_groups:
        out["grade_level_group"] = E.label(src(d.category), GRADE_GROUPS, F.lit(None).cast("string"))
    return raw.select(*(c.alias(o) for o, c in out.items()))


def typed_empty(spark: SparkSession, domain: Domain | str) -> DataFrame:
    """The domain's table without rows, for a year whose file is missing."""
    return stage(spark.createDataFrame([], "nothing string"), domain).where("false")


CASPP_SUMS = "total_tested_at_reporting_level total_tested_with_scores_at_reporting_level students_enrolled students_tested students_with_scores".split()
CASPP_MEANS = (
    "mean_scale_score",
    *(f"pct_standard_{x}" for x in ("exceeded", "met", "met_and_above", "nearly_met", "not_met")),
    *(f"area_{k}_pct_{x}_standard" for k in range(1, 5) for x in ("above", "near", "below")),
)


def stage_caspp(raw: DataFrame) -> DataFrame:
    """Test results with their grades rolled up: counts summed, scores and percents averaged over grades."""
    src = lambda name: _source(raw, name)
    named = raw.select(
        E.cds_code(*(F.coalesce(src(c), F.lit("")) for c in ("county_code", "district_code", "school_code"))).alias("cds_code"),
        *(src(c).alias(c) for c in ("county_code", "district_code", "school_code", "test_year", "test_type")),
        src("student_group_id").alias("reporting_category"),
        *(E.try_int(src(c)).alias(c) for c in CASPP_SUMS),
        *(E.try_double(src(c.replace("pct_", "percentage_"))).alias(c) for c in CASPP_MEANS),
    )
    keys = ["cds_code", "county_code", "district_code", "school_code", "reporting_category", "test_year", "test_type"]
    rolled = named.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in CASPP_SUMS), *(F.avg(c).alias(c) for c in CASPP_MEANS))
    return rolled.withColumns(category_columns(F.col("reporting_category")))


# Columns of the schools' directory.
SCHOOL_COLUMNS = _pairs(
    "CDSCode>cds_code NCESDist>nces_district_id NCESSchool>nces_school_id StatusType>status_type County>county_name District>district_name School>school_name Street>street_address City>city Zip>zip_code "
    "State>state_code Phone>phone_number WebSite>website_url OpenDate>open_date ClosedDate>closed_date Charter>is_charter CharterNum>charter_number DOC>doc_code DOCType>doc_type SOC>soc_code SOCType>soc_type "
    "EdOpsCode>ed_ops_code EdOpsName>ed_ops_name EILCode>eil_code EILName>eil_name GSoffered>grades_offered GSserved>grades_served Virtual>is_virtual Magnet>is_magnet Latitude>latitude Longitude>longitude "
    "AdmFName>admin_first_name AdmLName>admin_last_name LastUpDate>last_updated_date"
)


def stage_schools(raw: DataFrame) -> DataFrame:
    """The directory's active schools; dates that are no dates ('No Data') are null, coordinates are numbers."""
    kinds = {"latitude": "double", "longitude": "double", "open_date": "date", "closed_date": "date", "last_updated_date": "date"}
    cast = lambda o, s: _source(raw, s).try_cast(kinds[o]) if o in kinds else _source(raw, s)
    return raw.where(_source(raw, "StatusType") == "Active").select(*(cast(o, s).alias(o) for o, s in SCHOOL_COLUMNS.items()))


@dataclass(frozen=True)
class Board:
    """A dashboard indicator: what it has beside the columns that all indicators share."""

    name: str
    counts: str = ""
    rates: str = ""
    texts: str = ""
    #: Flags that are 'Y' or not; null counts as not.
    yes: str = ""
    change_level: str = "changelevel"


_NUMER = "currnumer>curr_numerator priornumer>prior_numerator"
_SMALL = "smalldenom>small_denominator dataerrorflag>data_error_flag"
_ELPAC = "progressed maintain_pl4 maintain_oth>maintain_other declined progressed_alternate maintain_pl3_alternate notprognotmain_alternate>notprog_notmain_alternate"


def _both(text: str) -> str:
    return " ".join(f"{when}{s}>{when}_{o}" for when in ("curr", "prior") for o, s in _pairs(text).items())


# Columns of the indicators.
BOARDS = {
    b.name: b
    for b in (
        Board("chronic_absenteeism", _NUMER, yes=_SMALL, change_level="change_level"),
        Board("suspension", _NUMER, yes=f"{_SMALL} certifyflag>certify_flag priorcertifyflag>prior_certify_flag"),
        Board(
            "ela",
            "currdenom_without_prloss>curr_denominator_without_prloss num_prloss " + _both("prate_enrolled prate_tested"),
            "currstatus_without_prloss>status_value_without_prloss currprate>curr_participation_rate priorprate>prior_participation_rate",
            "hscutpoints>hs_cutpoints pairshare_method",
        ),
        Board("elpac", f"{_NUMER} {_both(_ELPAC)} curr95>curr_95pct_adjustment prior95>prior_95pct_adjustment", yes="flag95pct>participation_rate_penalty"),
    )
}


def dashboard_export(raw: DataFrame, board: Board | str) -> DataFrame:
    """Schools' and districts' rows of a dashboard file with names for group, status, change and colour."""
    b = BOARDS[board] if isinstance(board, str) else board
    src = lambda name: _source(raw, name)
    met = lambda name: src(name) == "Y"
    level, group = src("rtype"), src("studentgroup")
    out = {
        "cds_code": src("cds"),
        "school_name": src("schoolname"),
        "district_name": src("districtname"),
        "county_name": src("countyname"),
        "aggregate_level_code": level,
        "aggregate_level": E.label(level, E.LEVEL_LABELS),
        "student_group_code": group,
        "student_group": E.label(group, E.GROUP_LABELS),
        "student_group_type": E.group_type(group),
        "academic_year": src("reportingyear"),
        "curr_denominator": E.try_int(src("currdenom")),
        "status_value": E.try_double(src("currstatus")),
        "status_level_code": src("statuslevel"),
        "status_level": E.label(src("statuslevel"), E.STATUS_LEVELS, "No Data"),
        "prior_denominator": E.try_int(src("priordenom")),
        "prior_status_value": E.try_double(src("priorstatus")),
        "change_value": E.try_double(src("change")),
        "change_level_code": src(b.change_level),
        "change_level": E.label(src(b.change_level), E.CHANGE_LEVELS, "No Data"),
        "color_code": src("color"),
        "performance_color": E.label(src("color"), E.COLORS, "No Performance Color"),
        "five_by_five_box": src("box"),
        "curr_n_size_met": met("currnsizemet"),
        "prior_n_size_met": met("priornsizemet"),
        "accountability_met": met("accountabilitymet"),
    }
    out |= {o: E.try_int(src(s)) for o, s in _pairs(b.counts).items()}
    out |= {o: E.try_double(src(s)) for o, s in _pairs(b.rates).items()}
    out |= {o: src(s) for o, s in _pairs(b.texts).items()}
    yes = _pairs(f"{b.yes} charter_flag>is_charter dass_flag>is_dass coe_flag>is_county_office")
    out |= {o: F.coalesce(met(s), F.lit(False)) for o, s in yes.items()}
    out |= {"indicator": F.lit(b.name), "indicator_code": src("indicator")}
    return raw.where(level.isin("S", "D")).select(*(c.alias(o) for o, c in out.items()))
