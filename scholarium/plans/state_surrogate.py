"""The driver's tables seen as raw state files: text columns, suppression marks, drifting presence of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.functions import expr as E
from scholarium.operators import accountability as A
from scholarium.operators import state
from scholarium.plans.surrogate import t

CATEGORIES = ["TA", "RH", "RW", "GM", "GF", "GX", "SE", "EL", "SWD", "GR13", "GR46", "ZZ"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """school, year, category and n, line items of each.

    School and year come out as maxima of themselves, so that filters on them stay
    behind the aggregate and all domains read one exchange of one scan.
    """
    school, y, c = F.col("l_suppkey"), F.year("l_shipdate").cast("long"), F.col("l_partkey") % len(CATEGORIES)
    rows = t(spark, sf_dir, "lineitem").groupBy(school.alias("_school"), y.alias("_y"), c.alias("c")).agg(F.max(school).alias("school"), F.max(y).alias("y"), F.count(F.lit(1)).alias("n"))
    return rows.select("school", "y", F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("c") + 1).cast("int")).alias("category"), "n")


BASE = f"""base AS (SELECT l_suppkey AS school, year(l_shipdate)::BIGINT AS y, ({CATEGORIES!r})[(l_partkey % {len(CATEGORIES)} + 1)::INT] AS category, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3)"""
YEAR = "(y::VARCHAR || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0'))"
CDS = "(lpad((school % 58)::VARCHAR, 2, '0') || lpad((school % 1000)::VARCHAR, 5, '0') || lpad(school::VARCHAR, 7, '0'))"


def _held(k: int) -> str:
    """Which rows the k-th domain has, in both dialects."""
    return f"(school * 7 + y + n * 3 + {k}) % 5 <> 0"


def _text(k: int, j: int, fraction: bool) -> Column:
    """The j-th measure of the k-th domain, as text; some are suppressed."""
    v = f"(n * {j + 2} + {k})"
    number = f"concat({v} div 10, '.', {v} % 10)" if fraction else f"cast({v} as string)"
    return F.expr(f"case when (n + {j + k}) % 13 = 0 then '*' else {number} end")


def _value_sql(k: int, j: int, fraction: bool) -> str:
    v = f"(n * {j + 2} + {k})"
    return f"CASE WHEN (n + {j + k}) % 13 = 0 THEN NULL ELSE {f'({v} / 10::DOUBLE)' if fraction else f'{v}::BIGINT'} END"


def _spec(name: str) -> tuple[dict[str, str], set[str]]:
    """Sources of a domain's staged columns, and which of them are fractions."""
    if name == "assessment_caspp":
        return {**{c: c for c in state.CASPP_SUMS}, **{c: c.replace("pct_", "percentage_") for c in state.CASPP_MEANS}}, set(state.CASPP_MEANS)
    d = state.DOMAINS[name]
    rates = state._pairs(d.rates)
    return {**state._pairs(d.counts), **rates, **state._pairs(d.texts)}, set(rates)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The raw file of a domain that accountability uses."""
    k = list(A.SOURCES).index(name)
    sources, fractions = _spec(name)
    year = F.concat(F.col("y").cast("string"), F.lit("-"), F.lpad(((F.col("y") + 1) % 100).cast("string"), 2, "0"))
    rows = base(spark, sf_dir).where(_held(k))
    code = {n: F.col("school") % m for n, m in (("county_code", 58), ("district_code", 1000), ("school_code", 10_000_000))}
    whole = {n: c.cast("string") for n, c in code.items()}
    if name.startswith("assessment_e"):
        whole = {"cds": F.concat(*(F.lpad(c, w, "0") for c, w in zip(whole.values(), (2, 5, 7), strict=True))), "reportingyear": year, "rtype": F.lit("S"), "studentgroup": F.col("category")}
    elif name == "assessment_caspp":
        whole |= {"test_year": year, "test_type": F.lit("B"), "student_group_id": F.col("category")}
    else:
        whole |= {"academic_year": year, "aggregate_level": F.when(F.col("school") % 10 == 9, "D").otherwise("S"), "reporting_category": F.col("category")}
    if name == "frpm":  # no categories
        rows = rows.groupBy("school", "y").agg(F.max("n").alias("n"))
        whole.pop("reporting_category")
    values = {sources[s]: _text(k, j, s in fractions) for j, s in enumerate(A.SOURCES[name].measures.values())}
    return rows.select(*(c.alias(n) for n, c in {**whole, **values}.items()))


def staged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {n: state.stage(raw(spark, sf_dir, n), n) for n in A.SOURCES if n != "assessment_caspp"}
    caspp = state.stage_caspp(raw(spark, sf_dir, "assessment_caspp"))
    return out | {"assessment_caspp": caspp.withColumnRenamed("test_year", "academic_year")}


def schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three schools are mapped."""
    key = F.col("s_suppkey")
    part = lambda m, w: F.lpad((key % m).cast("string"), w, "0")
    return t(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(
        F.concat(part(58, 2), part(1000, 5), part(10_000_000, 7)).alias("cds_code"),
        key.alias("school_id"),
        F.col("s_name").alias("school_name"),
        F.concat(F.lit("District "), (key % 1000).cast("string")).alias("cde_district_name"),
        F.concat(F.lit("County "), F.col("s_nationkey").cast("string")).alias("cde_county"),
        (F.col("s_acctbal") / 100).alias("latitude"),
        (F.col("s_acctbal") / -50).alias("longitude"),
    )


def domain_sql(name: str) -> str:
    """A CTE with the staged rows of a domain, as the accountability table reads them."""
    k = list(A.SOURCES).index(name)
    s = A.SOURCES[name]
    _, fractions = _spec(name)
    texts = set() if name == "assessment_caspp" else set(state._pairs(state.DOMAINS[name].texts))
    value = lambda j, c: f"(CASE WHEN (n + {j + k}) % 13 = 0 THEN '*' ELSE (n * {j + 2} + {k})::VARCHAR END)" if c in texts else _value_sql(k, j, c in fractions)
    columns = ", ".join(f"{value(j, c)} AS {o}" for j, (o, c) in enumerate(s.measures.items()))
    rows = f"(SELECT school, y, max(n) AS n FROM base WHERE {_held(k)} GROUP BY 1, 2)" if name == "frpm" else "base"
    keys = f"{CDS} AS cds_code, {YEAR} AS academic_year" + (", category AS reporting_category" if name != "frpm" else "")
    return f"{name} AS (SELECT {keys}, {columns} FROM {rows} WHERE {'true' if name == 'frpm' else _held(k)}{' AND school % 10 <> 9' if s.level else ''})"


GROUPS = ["ALL", "AA", "AS", "HI", "WH", "EL", "SWD", "ZZ"]


def raw_board(spark: SparkSession, sf_dir: str, board: str) -> DataFrame:
    """The raw file of a dashboard indicator."""
    rows = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("school"), F.year("l_shipdate").cast("long").alias("y"), (F.col("l_partkey") % len(GROUPS)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    text = lambda x: F.expr(f"cast({x} as string)")
    part = lambda m, w: F.lpad(text(f"school % {m}"), w, "0")
    flag = lambda m: F.when(F.col("school") % m == 0, "Y").otherwise("N")
    level = F.when(F.col("school") % 10 == 9, "X").when(F.col("school") % 10 == 8, "D").otherwise("S")
    columns = {
        "cds": F.concat(part(58, 2), part(1000, 5), part(10_000_000, 7)),
        "schoolname": F.concat(F.lit("School "), text("school")),
        "districtname": F.concat(F.lit("District "), text("school % 40")),
        "countyname": F.concat(F.lit("County "), text("school % 58")),
        "rtype": level,
        "studentgroup": F.element_at(F.array(*map(F.lit, GROUPS)), (F.col("g") + 1).cast("int")),
        "reportingyear": text("y"),
        "currdenom": F.when(F.col("n") % 7 == 0, "*").otherwise(text("n * 3")),
        "currnumer": text("n"),
        "currstatus": text("(n * 7 + school) % 100"),
        "priorstatus": text("(n * 5 + y) % 100"),
        "change": text("(n * 7 + school) % 100 - (n * 5 + y) % 100"),
        "statuslevel": text("n % 6"),
        state.BOARDS[board].change_level: text("(n + 1) % 6"),
        "color": text("(n + 2) % 6"),
        "charter_flag": flag(4),
        "dass_flag": flag(6),
        "currstatus_without_prloss": text("(n * 7 + school) % 90"),
        "currprate": text("90 + n % 10"),
        "currprogressed": text("n * 2"),
        "currmaintain_pl4": text("n + 1"),
        "currdeclined": text("n % 4"),
    }
    return rows.select(*(c.alias(n) for n, c in columns.items()))


def board_sql() -> str:
    """A CTE ``board`` with the columns of a dashboard export that the metrics views use."""
    label = lambda x, names, other: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"
    group = f"({GROUPS!r})[g + 1]"
    status, prior = "((n * 7 + school) % 100)", "((n * 5 + y) % 100)"
    return f"""board AS (SELECT {CDS} AS cds_code, 'School ' || school AS school_name, 'District ' || (school % 40) AS district_name, 'County ' || (school % 58) AS county_name,
  CASE WHEN school % 10 = 8 THEN 'District' ELSE 'School' END AS aggregate_level, y::VARCHAR AS academic_year, {label(group, E.GROUP_LABELS, group)} AS student_group,
  CASE WHEN g = 0 THEN 'all' WHEN g < 5 THEN 'race_ethnicity' WHEN g < 7 THEN 'program' ELSE 'unknown' END AS student_group_type, {label("(n + 2) % 6", E.COLORS, "'No Performance Color'")} AS performance_color,
  {label("n % 6", E.STATUS_LEVELS, "'No Data'")} AS status_level, {label("(n + 1) % 6", E.CHANGE_LEVELS, "'No Data'")} AS change_level, school % 4 = 0 AS is_charter, school % 6 = 0 AS is_dass,
  {status}::DOUBLE AS status_value, {prior}::DOUBLE AS prior_status_value, ({status} - {prior})::DOUBLE AS change_value, CASE WHEN n % 7 <> 0 THEN n * 3 END AS curr_denominator, n AS curr_numerator,
  ((n * 7 + school) % 90)::DOUBLE AS status_value_without_prloss, (90 + n % 10)::DOUBLE AS curr_participation_rate, n * 2 AS curr_progressed, n + 1 AS curr_maintain_pl4, n % 4 AS curr_declined
  FROM (SELECT l_suppkey AS school, year(l_shipdate)::BIGINT AS y, l_partkey % {len(GROUPS)} AS g, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) WHERE school % 10 <> 9)"""


# Whole raw files of the staging models.  Both engines run the same text for them.


def raw_columns(name: str) -> dict[str, str]:
    """Text columns of a domain's raw file over ``base``: numbers, suppressed, empty, missing and fractional ones."""
    d, k = state.DOMAINS[name], list(state.DOMAINS).index(name)
    year = "concat(cast(y as string), '-', cast(y + 1 as string))" if d.short_years else "concat(cast(y as string), '-', lpad(cast((y + 1) % 100 as string), 2, '0'))"
    out = {c: f"CASE WHEN n % 3 = 0 THEN NULL ELSE {year} END" if i + 1 < len(d.year) else year for i, c in enumerate(d.year)}
    places = [("school % 58", 2), ("school % 1000", 5), ("school", 7)]
    if len(d.cds) == 1:
        out[d.cds[0]] = "concat(" + ", ".join(f"lpad(cast({x} as string), {w}, '0')" for x, w in places) + ")"
    else:
        out |= {c: f"CASE WHEN school % 31 = {w} THEN NULL ELSE cast({x} as string) END" for c, (x, w) in zip(d.cds, places, strict=True)}
    if d.level:
        out[d.level] = "CASE school % 5 WHEN 0 THEN 'T' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE 'S' END"
    if d.category and not d.category.startswith("="):
        out[d.category] = "CASE WHEN n % 29 = 0 THEN NULL ELSE category END"
    numbers = {**dict.fromkeys(state._pairs(d.counts).values(), False), **dict.fromkeys(state._pairs(d.rates).values(), True), **dict.fromkeys(d.suppressed, False)}
    for j, (c, fraction) in enumerate(numbers.items()):
        v = f"n * {j + 1} + {k}"
        value = f"concat(cast({v} as string), '.', cast(n % 10 as string))" if fraction else f"cast({v} as string)"
        out.setdefault(c, f"CASE WHEN (n + {j + k}) % 13 = 0 THEN '*' WHEN (n + {j}) % 17 = 0 THEN '' WHEN (n + {j}) % 19 = 0 THEN NULL WHEN (n + {j}) % 23 = 0 THEN concat(cast({v} as string), '.5') ELSE {value} END")
    for j, c in enumerate(state._pairs(d.texts).values()):
        out.setdefault(c, f"CASE WHEN (n + {j}) % 11 = 0 THEN NULL ELSE concat('t{j} ', cast(n % 5 as string)) END")
    return out


def raw_file(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return base(spark, sf_dir).select(*(F.expr(x).alias(c) for c, x in raw_columns(name).items()))


def stage_sql(name: str) -> str:
    """The staging model of a domain as SQL over its raw file."""
    d = state.DOMAINS[name]
    raw = "raw AS (SELECT " + ", ".join(f'{x} AS "{c}"' for c, x in raw_columns(name).items()) + " FROM base)"
    label = lambda x, names, other: f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE {other} END"
    year = "coalesce(" + ", ".join(f'"{y}"' for y in d.year) + ")"
    short = f"CASE WHEN regexp_matches({year}, '^[0-9]{{4}}-[0-9]{{4}}$') THEN substr({year}, 1, 5) || substr({year}, 8, 2) ELSE {year} END"
    out = {"academic_year": short if d.short_years else year}
    out["cds_code"] = f'"{d.cds[0]}"' if len(d.cds) == 1 else " || ".join(f"lpad(coalesce(\"{c}\", ''), {w}, '0')" for c, w in zip(d.cds, (2, 5, 7), strict=True))
    if d.level:
        out |= {"aggregate_level": f'"{d.level}"', "aggregate_level_label": label(f'"{d.level}"', E.LEVEL_LABELS, f'"{d.level}"')}
    if d.category:
        x = f"'{d.category[1:]}'" if d.category.startswith("=") else f'"{d.category}"'
        programs = ", ".join(f"'{c}'" for c in E.PROGRAM_CODES)
        out |= {
            "reporting_category": x,
            "reporting_category_label": label(x, E.REPORTING_LABELS, x),
            "is_race_ethnicity_subgroup": f"coalesce({x} LIKE 'R%', false)",
            "is_gender_subgroup": f"coalesce({x} IN ('GM', 'GF', 'GX', 'GZ'), false)",
            "is_atrisk_subgroup": f"coalesce({x} IN ({programs}), false)",
        }
    out |= {o: f'"{c}"' for o, c in state._pairs(d.texts).items()}
    out |= {o: f'TRY_CAST("{c}" AS BIGINT)' for o, c in state._pairs(d.counts).items()}
    out |= {o: f'TRY_CAST("{c}" AS DOUBLE)' for o, c in state._pairs(d.rates).items()}
    if d.suppressed:
        out["is_suppressed"] = " OR ".join(f"coalesce(\"{c}\" = '*', false)" for c in d.suppressed)
    if d.small:
        out["is_small_n"] = f'coalesce(TRY_CAST("{d.small}" AS BIGINT) < 11, false)'
    if d.grade_groups:
        out["grade_level_group"] = label(f'"{d.category}"', state.GRADE_GROUPS, "NULL")
    return f"WITH {BASE}, {raw} SELECT " + ", ".join(f'{x} AS "{o}"' for o, x in out.items()) + " FROM raw"
