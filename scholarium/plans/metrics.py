"""Metrics views: named dimensions and measures over a DataFrame, by name or by SQL text."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BadQuery(ValueError):
    """SQL text that is no query over a metrics view."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _names(e) -> set[str]:
    """Column names in an unresolved expression; those of subqueries are refused."""
    if _kind(e) in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        raise BadQuery("a metrics view does not take subqueries")
    if _kind(e) == "UnresolvedAttribute":
        return {_items(e.nameParts())[-1].lower()}
    return set().union(*(_names(c) for c in _items(e.children())))


def _conjuncts(e) -> list:
    return [x for c in _items(e.children()) for x in _conjuncts(c)] if _kind(e) == "And" else [e]


@dataclass(frozen=True)
class MetricsView:
    source: DataFrame
    dimensions: dict[str, Column]
    measures: dict[str, Column] = field(default_factory=dict)

    def query(
        self,
        dimensions: list[str],
        measures: list[str],
        where: Column | None = None,
        order: list[Column] | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        unknown = [n for n in dimensions if n not in self.dimensions] + [n for n in measures if n not in self.measures]
        if unknown:
            raise KeyError(f"not in the view: {', '.join(unknown)}")
        rows = self.source.where(where) if where is not None else self.source
        out = rows.groupBy(*[self.dimensions[d].alias(d) for d in dimensions]).agg(*[self.measures[m].alias(m) for m in measures])
        if order:
            out = out.orderBy(*order)
        return out.limit(limit) if limit is not None else out

    def compare(self, dimension: str, by: str, values: list, measure: str) -> DataFrame:
        """One column of ``measure`` for each value of ``by``, in one aggregation."""
        rows = self.query([dimension, by], [measure])
        return rows.groupBy(dimension).agg(*[F.max(F.when(F.col(by) == v, F.col(measure))).alias(f"{measure}_{v}") for v in values])

    def _rows(self) -> DataFrame:
        """The source with each dimension as a column; filters on plain columns still reach the scan."""
        columns = {c.lower() for c in self.source.columns}
        new = {}
        for name, column in self.dimensions.items():
            if name.lower() not in columns:
                new[name] = column
            elif str(column) != f"Column<'{name}'>":
                raise ValueError(f"dimension {name} hides another column of the source")
        return self.source.withColumns(new) if new else self.source

    def sql(self, text: str, name: str = "metrics_view") -> DataFrame:
        """A SELECT over the view called ``name``: dimensions and measures stand as if they were columns.

        The dimensions selected (or grouped by) are the groups.  Spark's parser
        reads the text; of its plan, conditions on dimensions go before the
        aggregation, those that name a measure after it; select items, order and
        limit apply to its result.  Joins, subqueries, aggregate functions,
        stars and names that the view lacks are refused.
        """
        try:
            return self._sql(text, name)
        except AnalysisException as e:
            raise BadQuery(str(e).splitlines()[0]) from e

    def _sql(self, text: str, name: str) -> DataFrame:
        spark = self.source.sparkSession
        try:
            node = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception as e:
            raise BadQuery(str(e).splitlines()[0]) from e
        limit, order, items, conditions, grouped, distinct, alias = None, [], None, [], [], False, name
        while _kind(node) != "UnresolvedRelation":
            kind = _kind(node)
            if kind in ("GlobalLimit", "LocalLimit"):
                limit = int(node.limitExpr().sql())
            elif kind == "Sort" and items is None:
                order = _items(node.order())
            elif kind == "Distinct" and items is None:
                distinct = True
            elif kind in ("Project", "Aggregate") and items is None:
                items = _items(node.projectList() if kind == "Project" else node.aggregateExpressions())
                grouped = _items(node.groupingExpressions()) if kind == "Aggregate" else []
            elif kind == "UnresolvedHaving" and items is None or kind == "Filter" and items is not None:
                conditions += _conjuncts(node.havingCondition() if kind == "UnresolvedHaving" else node.condition())
            elif kind == "SubqueryAlias" and items is not None:
                alias = node.alias()
            else:
                raise BadQuery(f"a metrics view does not take {kind}")
            children = _items(node.children())
            if len(children) != 1:
                raise BadQuery(f"a metrics view does not take {kind}")
            (node,) = children
        if _items(node.multipartIdentifier())[-1].lower() != name.lower() or items is None:
            raise BadQuery(f"the query must select from {name}")
        dimensions = {d.lower(): d for d in self.dimensions}
        measures = {m.lower(): m for m in self.measures}
        selected, used = {}, set()
        for e in items:
            if _kind(e) in ("UnresolvedStar", "UnresolvedRegex"):
                raise BadQuery("name the dimensions and measures")
            inner = e.child() if _kind(e) in ("Alias", "UnresolvedAlias") else e
            label = e.name() if _kind(e) == "Alias" else _items(inner.nameParts())[-1] if _kind(inner) == "UnresolvedAttribute" else inner.sql()
            label = dimensions.get(label.lower(), measures.get(label.lower(), label))
            if label in selected:
                raise BadQuery(f"{label} stands twice")
            selected[label] = inner
            used |= _names(inner)
        for e in grouped:
            used |= _names(e)
        labels = {x.lower() for x in selected}
        used |= {n for o in order for n in _names(o) if n not in labels} | {n for c in conditions for n in _names(c) if n in measures}
        if unknown := sorted({n for n in used if n not in dimensions and n not in measures} | {n for c in conditions for n in _names(c) if n not in dimensions and n not in measures}):
            raise BadQuery(f"not in the view: {', '.join(unknown)}")
        groups = {n for e in [*selected.values(), *grouped] for n in _names(e) if n in dimensions}
        if stray := sorted(n for n in used if n in dimensions and n not in groups):
            raise BadQuery(f"not selected: {', '.join(stray)}")

        early = [c for c in conditions if not _names(c) & set(measures)]
        late = [c for c in conditions if _names(c) & set(measures)]
        if stray := sorted(n for c in late for n in _names(c) if n in dimensions and n not in groups):
            raise BadQuery(f"not selected: {', '.join(stray)}")
        both = lambda parts: reduce(lambda a, b: a & b, [F.expr(c.sql()) for c in parts])
        rows = self._rows().alias(alias)
        rows = rows.where(both(early)) if early else rows
        keys = [dimensions[n] for n in dimensions if n in groups]
        named = [measures[n] for n in measures if n in used]
        if named:
            out = rows.groupBy(*keys).agg(*[self.measures[m].alias(m) for m in named])
        else:
            out = rows.select(*keys).distinct()
        out = out.alias(alias)
        out = out.where(both(late)) if late else out
        hidden = {n: F.col(n) for n in (*keys, *named) if n.lower() not in labels}
        out = out.select(*[F.expr(e.sql()).alias(n) for n, e in selected.items()], *hidden.values())
        if _kind(out._jdf.queryExecution().analyzed()) != "Project":
            raise BadQuery("measures are aggregates already")
        if distinct:
            if hidden:
                raise BadQuery("DISTINCT takes what is selected only")
            out = out.distinct()
        if order:
            ways = {("ASC", "NULLS FIRST"): "asc_nulls_first", ("ASC", "NULLS LAST"): "asc_nulls_last", ("DESC", "NULLS FIRST"): "desc_nulls_first", ("DESC", "NULLS LAST"): "desc_nulls_last"}
            by = [(F.col(list(selected)[int(o.child().sql()) - 1]) if o.child().sql().isdigit() else F.expr(o.child().sql()), ways[o.direction().sql(), o.nullOrdering().sql()]) for o in order]
            out = out.orderBy(*[getattr(c, way)() for c, way in by])
        out = out.limit(limit) if limit is not None else out
        return out.select(*[f"`{n}`" for n in selected]) if hidden else out
