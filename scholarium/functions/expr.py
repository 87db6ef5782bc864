"""Column helpers: rounding, safe casts, hashing, masks, labels and flags.

All of them are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and codes of the two subgroup vocabularies, levels and dashboard scales.
REPORTING_LABELS = {
    "TA": "Total (All Students)",
    "RA": "Asian",
    "RB": "African American",
    "RD": "Did not Report",
    "RF": "Filipino",
    "RH": "Hispanic or Latino",
    "RI": "American Indian or Alaska Native",
    "RP": "Pacific Islander",
    "RT": "Two or More Races",
    "RW": "White",
    "GM": "Male",
    "GF": "Female",
    "GX": "Non-Binary Gender",
    "GZ": "Missing Gender",
    "SE": "English Learners",
    "SD": "Students with Disabilities",
    "SS": "Socioeconomically Disadvantaged",
    "SM": "Migrant",
    "SF": "Foster",
    "SH": "Homeless",
    "GRKN": "Kindergarten",
    "GR13": "Grades 1-3",
    "GR46": "Grades 4-6",
    "GR78": "Grades 7-8",
    "GRK8": "Grades K-8",
    "GR912": "Grades 9-12",
    "GRTK8": "TK-8",
    "GRTKKN": "TK/Kindergarten",
}
LEVEL_LABELS = {"T": "State", "C": "County", "D": "District", "S": "School"}
GROUP_LABELS = {
    "ALL": "All Students",
    "AA": "African American / Black",
    "AI": "American Indian or Alaska Native",
    "AS": "Asian",
    "FI": "Filipino",
    "HI": "Hispanic or Latino",
    "MR": "Two or More Races",
    "PI": "Pacific Islander",
    "WH": "White",
    "EL": "English Learners",
    "LTEL": "Long-Term English Learners",
    "SED": "Socioeconomically Disadvantaged",
    "SWD": "Students with Disabilities",
    "HOM": "Homeless",
    "FOS": "Foster Youth",
    "CAA": "California Alternate Assessments",
    "EO": "English Only",
    "ELO": "English Learner (Current)",
    "RFP": "Reclassified Fluent-English Proficient",
    "SBA": "Smarter Balanced Assessments",
}
GROUP_TYPES = {
    "all": ["ALL"],
    "race_ethnicity": ["AA", "AI", "AS", "FI", "HI", "MR", "PI", "WH"],
    "program": ["EL", "LTEL", "SED", "SWD", "HOM", "FOS"],
    "ela_additional": ["CAA", "EO", "ELO", "RFP", "SBA"],
}
COLORS = {"1": "Red", "2": "Orange", "3": "Yellow", "4": "Green", "5": "Blue"}
STATUS_LEVELS = {"1": "Very Low", "2": "Low", "3": "Medium", "4": "High", "5": "Very High"}
CHANGE_LEVELS = {"1": "Declined Significantly", "2": "Declined", "3": "Maintained", "4": "Increased", "5": "Increased Significantly"}
GRADE_POINTS = {"A+": 4.0, "A": 4.0, "A-": 3.7, "B+": 3.3, "B": 3.0, "B-": 2.7, "C+": 2.3, "C": 2.0, "C-": 1.7, "D+": 1.3, "D": 1.0, "D-": 0.7}
PROGRAM_CODES = ["SE", "SD", "SS", "SM", "SF", "SH"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x: Column | str, n: int = 0) -> Column:
    """Round half away from zero on the binary value, as DuckDB does."""
    x, p = _c(x).cast("double"), float(10**n)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(p) + F.lit(0.5)) / F.lit(p)


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b as double; null where b is 0 or null."""
    return F.lit(scale) * a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def share(flag: Column, digits: int = 2) -> Column:
    """Percent of rows in a group for which ``flag`` holds."""
    return rnd(ratio(F.sum(F.when(flag, 1).otherwise(0)), F.count(F.lit(1)), 100.0), digits)


def mean_tenths(x: Column | str) -> Column:
    """Mean of values with one decimal, summed as integers so that the order of rows can't show."""
    tenths = F.round(_c(x) * 10).cast("long")
    return ratio(F.sum(tenths), F.count(tenths) * 10)


def mean_exact(x: Column | str, digits: int) -> Column:
    """Mean of values with ``digits`` decimals at most, summed as integers so that the order of rows can't show."""
    units = F.round(_c(x) * 10**digits).cast("long")
    return ratio(F.sum(units), F.count(units) * 10**digits)


def sum_if(flag: Column) -> Column:
    """Rows for which ``flag`` holds; null over no rows."""
    return F.sum(F.when(flag, 1).otherwise(0)).cast("long")


def try_int(x: Column | str) -> Column:
    """Integer of a text, decimals rounded half away from zero; null where it isn't a number."""
    return F.round(F.expr(f"try_cast({x} as decimal(38,6))") if isinstance(x, str) else x.try_cast("decimal(38,6)")).cast("long")


def try_double(x: Column | str) -> Column:
    return _c(x).try_cast("double")


def hash_pii(x: Column | str, salt: str) -> Column:
    """sha256 hex of the text (null: empty) and the salt."""
    return F.sha2(F.concat(F.coalesce(_c(x).cast("string"), F.lit("")), F.lit(salt)), 256)


def surrogate_key(*cols: Column | str) -> Column:
    """md5 of the columns joined by '-', nulls replaced by a fixed mark."""
    return F.md5(F.concat_ws("-", *[F.coalesce(_c(c).cast("string"), F.lit("_dbt_utils_surrogate_key_null_")) for c in cols]))


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask_name(x: Column | str, shown: int = 1) -> Column:
    x = _c(x)
    n = F.length(x)
    return F.when(x.isNull(), None).when(n <= shown, _stars(n)).otherwise(F.concat(F.substring(x, 1, shown), _stars(n - shown)))


def mask_email(x: Column | str) -> Column:
    """First two characters of each side of the @ stay; a text without @ is all stars."""
    x = _c(x)
    side = lambda i: F.split_part(x, F.lit("@"), F.lit(i))
    part = lambda i: F.concat(F.substring(side(i), 1, 2), _stars(F.length(side(i)) - 2))
    return F.when(x.isNull(), None).when(~x.contains("@"), _stars(F.length(x))).otherwise(F.concat(part(1), F.lit("@"), part(2)))


def mask_phone(x: Column | str) -> Column:
    x = _c(x)
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    return F.when(x.isNull(), None).when(digits >= 10, F.concat(F.substring(x, 1, 6), F.lit("****"))).otherwise(_stars(F.length(x)))


def mask_address(x: Column | str) -> Column:
    return F.when(_c(x).isNotNull(), F.lit("***REDACTED***"))


def label(x: Column | str, names: dict[str, str], other: Column | str | None = None) -> Column:
    """The name of a code; else ``other`` (by default the code itself)."""
    x = _c(x)
    pairs = [F.lit(v) for item in names.items() for v in item]
    rest = x if other is None else (F.lit(other) if isinstance(other, str) else other)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), rest)


def group_type(x: Column | str) -> Column:
    x = _c(x)
    return reduce(lambda acc, kv: acc.when(x.isin(kv[1]), kv[0]), GROUP_TYPES.items(), F.when(F.lit(False), "")).otherwise("unknown")


def category_flags(x: Column | str) -> dict[str, Column]:
    """Kinds of a reporting category; null counts as none of them."""
    x = _c(x)
    no = F.lit(False)
    return {
        "is_race_ethnicity": F.coalesce(x.like("R%"), no),
        "is_gender": F.coalesce(x.isin("GM", "GF", "GX", "GZ"), no),
        "is_program": F.coalesce(x.isin(PROGRAM_CODES), no),
        "is_grade_span": F.coalesce(x.like("GR%"), no),
    }


def cds_code(county: Column | str, district: Column | str, school: Column | str) -> Column:
    """14 digits: county 2, district 5, school 7."""
    part = lambda x, n: F.lpad(_c(x).cast("string"), n, "0")
    return F.concat(part(county, 2), part(district, 5), part(school, 7))


def suppression_flags(cols: list[str], least: int = 11) -> dict[str, Column]:
    """is_suppressed: any column is '*'; is_small_n: any column is a number below ``least``."""
    either = lambda parts: reduce(lambda a, b: a | b, parts)
    no = F.lit(False)
    return {
        "is_suppressed": either([F.coalesce(F.col(c) == "*", no) for c in cols]),
        "is_small_n": either([F.coalesce(try_int(F.col(c)) < least, no) for c in cols]),
    }


def grade_points(letter: Column | str, other: float | None = 0.0) -> Column:
    pairs = [F.lit(v) for item in GRADE_POINTS.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(letter)), F.lit(other))


def weekday(d: Column | str) -> Column:
    """0 is Sunday, 6 Saturday."""
    return (F.dayofweek(_c(d)) - 1).cast("long")


def is_schoolday(d: Column | str) -> Column:
    return ~F.dayofweek(_c(d)).isin(1, 7)


def age_years(born: Column | str, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, _c(born)) / 12).cast("long")


def grade_band(grade: Column | str) -> Column:
    g = _c(grade)
    return F.when(g.between(1, 5), "Elementary").when(g.between(6, 8), "Middle").when(g.between(9, 12), "High").otherwise("Unknown")


def short_year(year: Column | str) -> Column:
    """2023-2024 becomes 2023-24; others stay."""
    y = _c(year)
    return F.when(y.rlike("^[0-9]{4}-[0-9]{4}$"), F.concat(F.substring(y, 1, 5), F.substring(y, 8, 2))).otherwise(y)


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of pairs; null where one side is constant or fewer than two pairs stand."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    sd = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(sd, F.lit(0.0)))


def bands(x: Column, steps: list[tuple[float, str]], lowest: str, strict: bool = True) -> Column:
    """The name of the first step that ``x`` lies above (or on, if not ``strict``)."""
    over = lambda v: x > v if strict else x >= v
    return reduce(lambda acc, s: acc.when(over(s[0]), s[1]), steps, F.when(F.lit(False), "")).otherwise(lowest)


def week_of_year(d: Column | str) -> Column:
    """Weeks from Sunday, 0 before the first Sunday (strftime's %U)."""
    d = _c(d)
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("long")
