"""Registered normalisers, refined tables and their views over the orders seen as raw school tables, each with SQL of its own."""

from __future__ import annotations

from scholarium.operators import normalize as N
from scholarium.operators import refine as R
from scholarium.plans.catalog import QUERIES, SQL
from scholarium.plans.surrogate import mean_sql, r, t


def raw_columns(name: str) -> dict[str, str]:
    """Raw columns over an order's key ``k`` and date ``d``, with codes, nulls and values outside their ranges; both engines run the same text."""
    e = N.ENTITIES[name]
    out = {}
    for j, key in enumerate(e.keys):
        out[key] = f"CASE WHEN k % {101 + 2 * j} = 0 THEN NULL ELSE k * {j + 1} END"
    for o, codes in e.codes.items():
        names = [*codes.names, "ZZ"]
        out[e.source(o)] = f"CASE k % {len(names) + 1} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(names)) + " END"
    for j, (o, d) in enumerate(e.defaults.items()):
        value = f"k % {j + 2} = 0" if isinstance(d, bool) else f"k % {j + 2}" if isinstance(d, int) else f"concat('t', CAST(k % {j + 5} AS STRING))"
        out[e.source(o)] = f"CASE WHEN k % {j + 3} = 0 THEN NULL ELSE {value} END"
    for o in e.trimmed.split():
        out[o] = "CASE WHEN k % 4 = 0 THEN NULL ELSE concat(' ', CAST(k % 9 AS STRING), ' ') END"
    for j, (o, span) in enumerate(e.ranges.items()):
        whole = f"k * {j + 3} % 17 - 2" if span.digits is None else f"CAST(k * {j + 3} % 997 AS DOUBLE) / 997 * {span.high * 1.3} - {span.high / 10}"
        out[o] = f"CASE WHEN k % {j + 11} = 0 THEN NULL ELSE {whole} END"
    for o in e.allowed:
        out[o] = "CASE k % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'F' WHEN 2 THEN 'Z' WHEN 3 THEN 'W' END"
    for j, o in enumerate([*e.days.split(), *N.pairs(e.weeks).values()]):
        out[o] = f"CASE WHEN k % {j + 7} = 0 THEN NULL ELSE CAST(d AS DATE) + CAST(k * {j} % 11 - {j} AS INT) END"
    for o in N.pairs(e.kept):
        out.setdefault(o, "concat('k', CAST(k % 3 AS STRING))")
    if name == "academic_records":
        out["on_time"] = "CASE WHEN k % 2 = 0 THEN NULL ELSE k % 3 = 0 END"
    return out


def _raw(spark, sf_dir: str, name: str):
    columns = ", ".join(f"{x} AS {c}" for c, x in raw_columns(name).items())
    return spark.sql(f"SELECT {columns} FROM (SELECT o_orderkey AS k, o_orderdate AS d FROM {{rows}}) x", rows=t(spark, sf_dir, "orders"))


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)


def normal_sql(name: str) -> str:
    e = N.ENTITIES[name]
    raw = ", ".join(f"{x} AS {c}" for c, x in raw_columns(name).items())
    out = {k: k for k in e.keys} | N.pairs(e.kept)
    for o, codes in e.codes.items():
        s = e.source(o)
        other = f"'{codes.default}'" if codes.closed else f"coalesce({s}, '{codes.default}')"
        out[o] = f"CASE {s} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in codes.names.items()) + f" ELSE {other} END"
    out |= {o: f"coalesce({e.source(o)}, {_literal(d)})" for o, d in e.defaults.items()}
    out |= {o: f"trim(coalesce({o}, ''))" for o in e.trimmed.split()}
    out |= {o: f"CASE WHEN {o} NOT BETWEEN {s.low} AND {s.high} THEN {_literal(s.otherwise)} ELSE {o if s.digits is None else r(o, s.digits)} END" for o, s in e.ranges.items()}
    out |= {o: f"CASE WHEN {o} NOT IN {a} THEN NULL ELSE {o} END" for o, a in e.allowed.items()}
    out |= {o: f"{o}::DATE" for o in e.days.split()}
    out |= {o: f"date_trunc('week', {s})::DATE" for o, s in N.pairs(e.weeks).items()}
    if name == "students":
        out |= {"birth_year": "year(date_of_birth)::INT", "birth_month": "month(date_of_birth)::INT"}
    if name == "courses":
        out["capacity_percent"] = f"CASE WHEN capacity = 0 THEN 0 ELSE {r('100.0::DOUBLE * enrollment_count::DOUBLE / nullif(capacity::DOUBLE, 0)', 1)} END"
    if name == "academic_records":
        a, b, c, d, x = N.TIMELINESS
        out["submission_timeliness"] = f"""CASE WHEN submission_date < assignment_date THEN '{a}' WHEN submission_date = assignment_date THEN '{b}' WHEN submission_date <= assignment_date + INTERVAL 3 DAYS THEN '{c}'
          WHEN submission_date <= assignment_date + INTERVAL 7 DAYS THEN '{d}' ELSE '{x}' END"""
        out["on_time"] = "coalesce(on_time, late_days = 0)"
    held = " AND ".join(f"{k} IS NOT NULL" for k in e.keys)
    return f"SELECT {', '.join(f'{x} AS {o}' for o, x in out.items())} FROM (SELECT {raw} FROM (SELECT o_orderkey AS k, o_orderdate AS d FROM orders) x) y WHERE {held}"


def _register(name: str) -> None:
    QUERIES[f"normal_{name}"] = lambda spark, sf_dir: N.normalize(_raw(spark, sf_dir, name), name)
    SQL[f"normal_{name}"] = normal_sql(name)


for _name in N.ENTITIES:
    _register(_name)


def _counts(name: str) -> str:
    e = N.ENTITIES[name]
    columns = ", ".join(f"{x} AS {c}" for c, x in raw_columns(name).items() if c in e.keys)
    whole = " AND ".join(f"{k} IS NOT NULL" for k in e.keys)
    return f"SELECT '{name}' AS entity, count(*) FILTER (WHERE {whole}) AS normalized_count, count({e.keys[0]}) AS source_count FROM (SELECT {columns} FROM (SELECT o_orderkey AS k FROM orders) x) y"


QUERIES["normal_completeness"] = lambda spark, sf_dir: N.completeness({n: _raw(spark, sf_dir, n) for n in N.ENTITIES})
SQL["normal_completeness"] = f"SELECT *, {r('100.0::DOUBLE * normalized_count::DOUBLE / nullif(source_count::DOUBLE, 0)', 1)} AS percent_transformed FROM ({' UNION ALL '.join(map(_counts, N.ENTITIES))}) z"


# Refined tables and views

SALT = "example-salt"


def _refined(spark, sf_dir: str, name: str):
    return R.refine(N.normalize(_raw(spark, sf_dir, name), name), name, SALT)


def _mask_sql(x: str, shown: int = 1) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN length({x}) <= {shown} THEN '*' ELSE substr({x}, 1, {shown}) || repeat('*', length({x}) - {shown}) END"


def refined_sql(name: str) -> str:
    hash_ = lambda x: f"CASE WHEN {x} IS NOT NULL THEN sha256({x}::VARCHAR || '{SALT}') END"
    hashed, masked = N.pairs(R.HASHED[name]), R.MASKED.get(name, {})
    out = {o: hash_(s) for o, s in hashed.items()} | {f"{s}_masked": _mask_sql(s, n) for s, n in masked.items()}
    gone = {*hashed.values(), *masked, *R.DROPPED.get(name, "created_date updated_date").split()}
    if e := R.EMAILS.get(name):
        local, domain = f"(substr({e}, 1, strpos({e}, '@') - 1))", f"(substr({e}, strpos({e}, '@') + 1))"
        out[f"{e}_masked"] = f"CASE WHEN {e} IS NULL THEN NULL WHEN {e} NOT LIKE '%@%' THEN {_mask_sql(e, 2)} ELSE ({_mask_sql(local, 2)}) || '@' || ({_mask_sql(domain, 2)}) END"
        gone.add(e)
    if p := R.PHONES.get(name):
        out[f"{p}_masked"] = f"CASE WHEN {p} IS NULL THEN NULL WHEN length(regexp_replace({p}, '[^0-9]', '', 'g')) >= 10 THEN substr({p}, 1, strpos({p}, '-') + 3) || '****' ELSE {_mask_sql(p, 1)} END"
        gone.add(p)
    if name == "students":
        out |= {"birth_year_generalized": "birth_year", "withdrawn_flag": "withdrawal_date IS NOT NULL"}
        gone.add("birth_year")
    if name == "attendance":
        x = "reason_description"
        out["reason_category"] = f"CASE WHEN {x} LIKE '%medical%' OR {x} LIKE '%doctor%' THEN 'Health-related' WHEN {x} LIKE '%appointment%' THEN 'Medical appointment' WHEN {x} LIKE '%family%' THEN 'Family matter' WHEN {x} <> '' THEN 'Absence notification' ELSE 'Unknown' END"
        gone.add(x)
    return f"SELECT {', '.join(f'{x} AS {o}' for o, x in out.items())}, n.* EXCLUDE ({', '.join(sorted(gone))}), 'FERPA Compliant' AS privacy_classification FROM ({normal_sql(name)}) n"


def _register_refined(name: str) -> None:
    QUERIES[f"refined_{name}"] = lambda spark, sf_dir: _refined(spark, sf_dir, name)
    SQL[f"refined_{name}"] = refined_sql(name)


for _name in N.ENTITIES:
    _register_refined(_name)


def _with(names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({refined_sql(n)})" for n in names.split())


_N = "count(CASE WHEN {} THEN 1 END)"
QUERIES["student_enrollment_view"] = lambda spark, sf_dir: R.student_enrollment(*(_refined(spark, sf_dir, n) for n in ("students", "enrollment", "courses", "attendance")))
SQL["student_enrollment_view"] = f"""{_with("students enrollment courses attendance")} SELECT sr.student_id_hashed, er.enrollment_id_hashed, er.student_id_hashed AS enr_student_id_hashed, cr.course_id, cr.course_name, cr.department, er.term, er.letter_grade,
  er.final_grade_percent, sr.grade_level, sr.special_education, sr.gpa, ar.attendance_rate, ar.chronically_absent, ar.warning_level
  FROM students sr LEFT JOIN enrollment er ON sr.student_id_hashed = er.student_id_hashed LEFT JOIN courses cr ON er.course_id = cr.course_id
  LEFT JOIN (SELECT student_id_hashed, term, {mean_sql("attendance_rate", 4)} AS attendance_rate, max(chronically_absent) AS chronically_absent, max(warning_level) AS warning_level FROM attendance GROUP BY 1, 2) ar
  ON sr.student_id_hashed = ar.student_id_hashed AND er.term = ar.term"""
QUERIES["course_performance_summary"] = lambda spark, sf_dir: R.course_performance(_refined(spark, sf_dir, "enrollment"), _refined(spark, sf_dir, "courses"))
SQL["course_performance_summary"] = f"""{_with("enrollment courses")} SELECT cr.course_id, cr.course_name, cr.department, er.term, count(DISTINCT er.student_id_hashed) AS enrollment_count, {r(mean_sql("final_grade_percent", 1), 1)} AS avg_grade_percent,
  {r(mean_sql("gpa_contribution", 2), 2)} AS avg_gpa_contribution, {_N.format("letter_grade IN ('A', 'A-', 'B+')")} AS high_achiever_count, {_N.format("letter_grade IN ('D', 'D-', 'F')")} AS struggling_count,
  {r("100.0::DOUBLE * count(CASE WHEN flag_for_intervention THEN 1 END)::DOUBLE / count(*)::DOUBLE", 1)} AS intervention_flag_percent FROM enrollment er LEFT JOIN courses cr ON er.course_id = cr.course_id GROUP BY 1, 2, 3, 4"""
QUERIES["privacy_verification"] = lambda spark, sf_dir: R.verification({n: _refined(spark, sf_dir, n) for n in N.ENTITIES})
SQL["privacy_verification"] = f"""{_with(" ".join(N.ENTITIES))} SELECT 'students' AS entity, count(*) AS total_records, count(student_id_hashed) AS hashed_pii, count(first_name_masked) AS masked_pii FROM students
  UNION ALL SELECT 'courses', count(*), count(DISTINCT instructor_id_hashed), count(instructor_name_masked) FROM courses UNION ALL SELECT 'enrollment', count(*), count(enrollment_id_hashed), count(student_id_hashed) FROM enrollment
  UNION ALL SELECT 'attendance', count(*), count(attendance_id_hashed), count(student_id_hashed) FROM attendance UNION ALL SELECT 'academic_records', count(*), count(record_id_hashed), count(student_id_hashed) FROM academic_records"""
