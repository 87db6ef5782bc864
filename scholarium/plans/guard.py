"""Running untrusted SQL text: extraction, checks, bounded execution, result matching."""

from __future__ import annotations

import json
import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.functions.expr import rnd

FENCE = re.compile(r"```(?:sql)?\s*\n?(.*?)```", re.S | re.I)
# What a read-only query never holds as a word.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "MERGE", "COPY", "ATTACH", "GRANT", "SET", "REFRESH", "CACHE", "ADD")


class Refused(ValueError):
    """A query that the guard does not run."""


def extract_sql(text: str) -> str:
    """The SQL in a JSON envelope (also inside prose), a fenced block or the bare text, without a closing semicolon."""
    text = text.strip()
    decoder = json.JSONDecoder()
    for at in (i for i, c in enumerate(text) if c == "{"):
        try:
            got, _ = decoder.raw_decode(text[at:])
        except ValueError:
            continue
        if isinstance(got, dict) and isinstance(got.get("sql"), str):
            text = got["sql"]
            break
    else:
        if m := FENCE.search(text):
            text = m[1]
    return text.strip().rstrip(";").strip()


def _bare(sql: str) -> str:
    """The text without comments, strings and quoted names."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", " ", sql, flags=re.S)


# Expressions that tell of the machine, its files or its users, and plan leaves without stored rows of their own.
FORBIDDEN_EXPRESSIONS = {"CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "SessionUser", "CurrentDatabase", "CurrentCatalog", "SparkVersion"}
ROWLESS_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


@dataclass(frozen=True)
class Guard:
    """Runs queries in a session of their own, which knows the allowed relations only, without their hidden columns.

    The text is checked first (one SELECT, no other statement's words).  What
    decides is the analyzed plan: every leaf, also of subqueries, must stand
    under one of the session's own views or hold no stored rows.  So it makes no
    difference how a relation is named: quoted, by TABLE, by an IDENTIFIER
    clause, by path, in a pipe or a subquery.  A hidden column does not exist in
    the session, so no star or struct can reach it, and the session reads no
    files by path.
    """

    allowed: frozenset[str]
    hidden_columns: frozenset[str] = frozenset()
    max_rows: int = 1000
    timeout_s: float = 10.0
    #: Relations by name, where they are not tables or views of the session.
    frames: dict[str, DataFrame] | None = field(default=None, compare=False)
    #: Settings of the guarded session.
    settings: dict[str, str] = field(default_factory=dict, compare=False)

    def session(self, spark: SparkSession) -> SparkSession:
        """A session with a temporary view for each allowed relation."""
        own = spark.newSession()
        for k, v in {**self.settings, "spark.sql.runSQLOnFiles": "false"}.items():
            own.conf.set(k, v)
        for name in self.allowed:
            shared = f"guard_{uuid.uuid4().hex}"
            (self.frames[name] if self.frames is not None else spark.table(name)).createGlobalTempView(shared)
            own.table(f"global_temp.{shared}").drop(*self.hidden_columns).createTempView(name)
            spark.catalog.dropGlobalTempView(shared)
        return own

    def _check_text(self, sql: str) -> None:
        if not sql:
            raise Refused("the query is empty")
        bare = _bare(sql)
        if ";" in bare:
            raise Refused("only one statement is run")
        if word := next((w for w in FORBIDDEN if re.search(rf"\b{w}\b", bare, re.I)), None):
            raise Refused(f"{word} is not allowed")
        if not re.match(r"\s*\(*\s*(SELECT|WITH)\b", bare, re.I):
            raise Refused("the query must be a SELECT")

    def _check_plan(self, plan) -> None:
        """Refuses a plan with a leaf that is neither below one of the own views nor without stored rows."""
        allowed = {a.lower() for a in self.allowed}
        todo = [plan]
        while todo:
            node = todo.pop()
            kind = _kind(node)
            if kind == "View" and node.isTempView() and node.desc().identifier().table().lower() in allowed:
                continue
            children = _items(node.children())
            if not children and kind not in ROWLESS_LEAVES:
                raise Refused(f"a relation that is not allowed ({kind})")
            expressions = _items(node.expressions())
            while expressions:
                e = expressions.pop()
                if _kind(e) in FORBIDDEN_EXPRESSIONS:
                    raise Refused(f"{e.prettyName()} reaches outside the allowed relations")
                expressions += _items(e.children())
            todo += children + _items(node.subqueries())

    def _frame(self, spark: SparkSession, sql: str) -> DataFrame:
        self._check_text(sql)
        own = self.session(spark)
        try:
            frame = own.sql(sql)
        except Exception as e:
            raise Refused(f"the query does not {'parse' if isinstance(e, ParseException) else 'analyze'}: {next(filter(None, str(e).splitlines()), '')}") from e
        self._check_plan(frame._jdf.queryExecution().analyzed())
        return frame

    def validate(self, spark: SparkSession, sql: str) -> str:
        """The SQL, if it is one read-only query over allowed relations; else Refused."""
        self._frame(spark, sql)
        return sql

    def frame(self, spark: SparkSession, text: str) -> DataFrame:
        """The query's rows, at most ``max_rows``, not yet run."""
        return self._frame(spark, extract_sql(text)).limit(self.max_rows)

    def schema(self, spark: SparkSession) -> dict[str, list[tuple[str, str]]]:
        """Column names and types of the allowed relations, hidden columns left out, for prompts and pickers."""
        own = self.session(spark)
        return {name: own.table(name).dtypes for name in sorted(self.allowed)}

    def validate_pairs(self, spark: SparkSession, pairs: list[tuple[str, str]], rows: int = 10) -> DataFrame:
        """(question, sql, valid, message) of each pair: whether its SQL passes the guard, names an allowed relation and runs.

        A query is run for at most ``rows`` rows; one without any is valid.
        """
        names = [a.lower() for a in self.allowed]
        out = []
        for question, text in pairs:
            try:
                sql = extract_sql(text)
                frame = self._frame(spark, sql)
                if not any(re.search(rf"\b{re.escape(n)}\b", sql, re.I) for n in names):
                    raise Refused("no known relation is named")
                found = len(frame.limit(rows).collect())
                out.append((question, sql, True, f"{found} rows returned" if found else "no rows"))
            except Exception as e:  # what fails in running is a finding too
                out.append((question, text, False, str(e).splitlines()[0][:200]))
        return spark.createDataFrame(out, "question string, sql string, valid boolean, message string")

    def execute(self, spark: SparkSession, text: str) -> list:
        """Run within ``timeout_s``; the job is cancelled beyond it."""
        frame, tag = self.frame(spark, text), f"guard-{uuid.uuid4().hex}"
        own = frame.sparkSession
        timer = threading.Timer(self.timeout_s, lambda: own.interruptTag(tag))
        own.addTag(tag)
        timer.start()
        try:
            return frame.collect()
        finally:
            timer.cancel()
            own.removeTag(tag)


def is_percent(name: str) -> bool:
    name = name.lower()
    return "percent" in name or "%" in name or name.endswith(("_pct", "_rate", "_ratio"))


def format_result(df: DataFrame) -> DataFrame:
    """``df`` for display: fractions with two decimals; numbers named as a percentage as text with a '%'.

    Of these, values from 0 to 1 are proportions and scaled, others percentages
    already.  Integers that are no percentage, and all that is no number, stay.
    """
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        whole = kind in ("tinyint", "smallint", "int", "bigint")
        if not whole and kind not in ("float", "double") and not kind.startswith("decimal"):
            pass
        elif is_percent(name):
            v = c.cast("double")
            c = F.when(v.isNull() | F.isnan(v), None).otherwise(F.format_string("%.2f%%", rnd(F.when(v.between(0, 1), v * 100).otherwise(v), 2)))
        elif not whole:
            c = rnd(c, 2)
        out.append(c.alias(name))
    return df.select(*out)


def execution_match(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows, as multisets, whatever their column names."""
    if len(a.columns) != len(b.columns):
        return False
    names = [f"c{i}" for i in range(len(a.columns))]
    a, b = (x.selectExpr(*[f"cast(`{c}` as string) as {n}" for c, n in zip(x.columns, names, strict=True)]) for x in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def exact_match(a: str, b: str) -> bool:
    norm = lambda s: re.sub(r"\s+", " ", s.strip().rstrip(";")).strip().lower()
    return norm(a) == norm(b)
