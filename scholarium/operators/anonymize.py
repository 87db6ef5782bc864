"""Keyed pseudonyms for whole sets of files, with a scan of the output for what must not be there.

Equal ids get equal pseudonyms in every file, so joins survive; students and
staff have salts of their own, so the two cannot be linked.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.sources.convert import write_checked

# Columns of the source system by what happens to them.
STUDENT_IDS = "StudentID Admin_StudentID OldStudentID StateStudentID StudentNumber".split()
STAFF_IDS = "CounselorNumber HomeRoomTeacherNumber ElementaryTeacherNumber TeacherNumber MP_PrimaryStaffID".split()
DROPPED = (
    "LastName FirstName MiddleName LastNameAlias FirstNameAlias MiddleNameAlias NameSuffix ParentGuardianName ElementaryTeacherName Birthdate "
    "MailingAddress MailingAddressCity MailingAddressState MailingAddressZipCode MailingAddressZipExt "
    "ResidenceAddress ResidenceAddressCity ResidenceAddressState ResidenceAddressZipCode ResidenceAddressZipExt "
    "HomePhone StudentMobilePhone StudentPersonalEmailAddress ParentEmailAddress StudentEmailAddress NetworkLoginID LockerNumber FamilyKey"
).split()
EMPTIED = "Comment ShortDescription ReferredByOther Initials MP_Comment1Code MP_Comment2Code MP_Comment3Code".split()


@dataclass(frozen=True)
class Rules:
    student_salt: str
    staff_salt: str
    student_ids: frozenset[str] = frozenset(STUDENT_IDS)
    staff_ids: frozenset[str] = frozenset(STAFF_IDS)
    #: Columns of unknown content go too.
    dropped: frozenset[str] = field(default_factory=lambda: frozenset([*DROPPED, *(f"UserCode{k}" for k in range(1, 14))]))
    emptied: frozenset[str] = frozenset(EMPTIED)

    def __post_init__(self):
        if not self.student_salt or not self.staff_salt or self.student_salt == self.staff_salt:
            raise ValueError("students and staff need salts of their own")


def pseudonym(value: Column, salt: str) -> Column:
    """32 hex digits of the salted SHA-256 of the trimmed text; blank and null become empty."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text == "", F.lit("")).otherwise(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), text), 256), 1, 32))


def anonymize(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` with ids replaced, direct personal data dropped, free text emptied and other texts trimmed."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        if name in rules.dropped:
            continue
        if name in rules.student_ids or name in rules.staff_ids:
            c = pseudonym(c, rules.student_salt if name in rules.student_ids else rules.staff_salt)
        elif name in rules.emptied:
            c = F.lit("")
        elif kind == "string":
            c = F.trim(c)
        out.append(c.alias(name))
    return rows.select(*out)


def raw_ids(tables: list[DataFrame], rules: Rules, shortest: int = 5) -> DataFrame:
    """Distinct ids of the sources; shorter ones than ``shortest`` stand for too much else to look for."""
    ids = rules.student_ids | rules.staff_ids
    parts = [t.select(F.explode(F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in t.columns if c in ids])).alias("value")) for t in tables if ids & set(t.columns)]
    if not parts:
        return tables[0].sparkSession.createDataFrame([], "value string")
    return reduce(DataFrame.unionAll, parts).where(F.length("value") >= shortest).distinct()


def leaks(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(column, value_count) where values of ``rows`` are raw ids, whole or as a word of a text; empty if none leaks."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in rows.columns])
    words = rows.select(F.explode(cells).alias("x")).select("x.column", F.explode(F.array_union(F.array("x.v"), F.split("x.v", "[^A-Za-z0-9]+"))).alias("value")).where("value <> ''").distinct()
    return words.join(ids, "value").groupBy("column").agg(F.count(F.lit(1)).alias("value_count"))


def anonymize_tables(tables: dict[str, DataFrame], folder: str, rules: Rules) -> dict:
    """Writes each table anonymized under ``folder``, checked and scanned, and a manifest beside them.

    The manifest says for each table how many rows and columns came and went and
    what happened to which.  A table with a leak is reported, and ``clean`` is
    false; its files stay for inspection.
    """
    spark = next(iter(tables.values())).sparkSession
    ids = raw_ids(list(tables.values()), rules)
    manifest: dict = {"tables": {}, "clean": True}
    for name, rows in tables.items():
        out = anonymize(rows, rules)
        report = write_checked(out, f"{folder}/{name}")
        found = {r["column"]: r["value_count"] for r in leaks(spark.read.schema(out.schema).parquet(report.path), ids).collect()}  # a row a column
        of = lambda names: [c for c in rows.columns if c in names]  # noqa: B023, E731
        manifest["tables"][name] = {
            "rows": report.rows,
            "columns_in": len(rows.columns),
            "columns_out": len(out.columns),
            "dropped": of(rules.dropped),
            "student_ids": of(rules.student_ids),
            "staff_ids": of(rules.staff_ids),
            "emptied": of(rules.emptied),
            "leaks": found,
        }
        manifest["clean"] &= not found
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest
